"""Prediction by partial matching over bytes, learned from and applied to a corpus.

The model is a trie of byte contexts up to ORDER, kept as sorted arrays of
grams (context and symbol) with counts. It grows with the corpus, so no task
and no broadcast holds it whole: texts are dealt into blocks; each block sends
its distinct grams, with their counts in training texts, to the shard of their
last three context bytes; the shard has every context that ends so, counts, and
answers each block with the log probability of each of its grams; the block
adds them up along its texts. Shards are as many as the blocks make useful, so a
task keeps its size at any corpus size. Contexts of two bytes or fewer have at
most 2^24 counts, which are summed apart and shared. Word counts for the base
score go the same way, by hash of the word.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import drop, ship, table

ORDER = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 4_000_000
#: Blocks for each shard of grams and of words, and the least number of either.
BLOCKS_A_SHARD, LEAST_SHARDS = 2, 32
#: Nearest context bytes that key a shard; contexts shorter than that are shared.
KEY = 3
END = b"\n"


def tokens(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()


def stream(words: list[bytes]) -> bytes:
    """What is scored: the words, a space between them, then the end."""
    return b" ".join(words) + END


def gram_codes(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): a code for each byte of each stream, in order.

    A code has the nearest context byte highest, the farthest of ORDER context
    bytes next to last and the symbol lowest. Before a stream's first byte
    stand ends, so nothing depends on another text.
    """
    pad = END * ORDER
    raw = np.frombuffer(pad + pad.join(streams), np.uint8)
    lengths = np.array([len(x) for x in streams], np.int64)
    n = len(raw) - ORDER
    code = np.zeros(n, np.uint64)
    for back in range(1, ORDER + 1):
        code = (code << np.uint64(8)) | raw[ORDER - back : ORDER - back + n]
    code = (code << np.uint64(8)) | raw[ORDER:]
    own = np.ones(n, bool)
    ends = np.cumsum(lengths + ORDER)[:-1] - ORDER
    for i in range(ORDER):
        own[ends + i] = False
    return code[own], lengths


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether it is there)."""
    if not len(table_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return at, table_[at] == keys


def places(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in table_ (distinct) of each of many keys that are all in it.

    By open addressing in an array at most a quarter full, all keys at once;
    much cheaper than a search or a sort for each of millions of keys.
    """
    bits = max(4, (4 * len(table_)).bit_length())
    mask, shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
    slot = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    held = np.full(1 << bits, -1, np.int32)
    at, left = slot(table_), np.arange(len(table_), dtype=np.int32)
    while len(left):
        free = held[at] < 0
        held[at[free]] = left[free]
        lost = held[at] != left
        left, at = left[lost], (at[lost] + 1) & mask
    at = slot(keys)
    out = held[at]
    left = np.flatnonzero(table_[out] != keys)
    at = at[left]
    while len(left):
        at = (at + 1) & mask
        out[left] = held[at]
        wrong = table_[out[left]] != keys[left]
        left, at = left[wrong], at[wrong]
    return out


class Level:
    """Contexts of one order: grams and counts; per context total, distinct and
    what its symbols have one order below (for exclusion)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        contexts = grams >> np.uint64(8)
        self.at = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(grams) else np.zeros(0, np.int64)
        self.contexts = contexts[self.at]
        self.total = np.add.reduceat(counts, self.at) if len(grams) else counts
        self.distinct = np.diff(np.append(self.at, len(grams)))
        self.below = np.zeros(len(self.at), np.int64)

    def lower(self) -> tuple[np.ndarray, np.ndarray]:
        """Grams one order below, the farthest context byte dropped, with counts."""
        return summed(((self.grams >> np.uint64(16)) << np.uint64(8)) | (self.grams & np.uint64(255)), self.counts)

    def exclude(self, low: Level) -> None:
        at, _ = _find(low.grams, ((self.grams >> np.uint64(16)) << np.uint64(8)) | (self.grams & np.uint64(255)))
        if len(self.at):
            self.below = np.add.reduceat(low.counts[at], self.at)


class Shared:
    """Contexts of fewer than KEY bytes: the same for all shards."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """grams: distinct codes of KEY - 1 context bytes and a symbol, ascending."""
        self.levels = {KEY - 1: Level(grams, counts)}
        for k in range(KEY - 2, -1, -1):
            self.levels[k] = Level(*self.levels[k + 1].lower())
        for k in range(KEY - 1, 0, -1):
            self.levels[k].exclude(self.levels[k - 1])


class Trie:
    """A shard's contexts of ORDER down to KEY, on top of the shared ones."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shared: Shared):
        """grams: distinct codes, ascending, with their counts."""
        keep = counts > 0
        self.levels = {ORDER: Level(grams[keep], counts[keep].astype(np.int64))}
        for k in range(ORDER - 1, KEY - 1, -1):
            self.levels[k] = Level(*self.levels[k + 1].lower())
        self.levels |= shared.levels
        for k in range(ORDER, KEY - 1, -1):
            self.levels[k].exclude(self.levels[k - 1])

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of each code.

        Escapes by method D: of a context's T occurrences of D symbols, half an
        occurrence of each goes to the escape. Symbols of the longer contexts
        are excluded from T and D. A context not seen passes on for nothing.
        Symbols never seen share the last escape evenly.
        """
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        gone_t, gone_d = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for k in range(ORDER, -1, -1):
            level, c = self.levels[k], codes[open_]
            context = c >> np.uint64(8 * (ORDER - k) + 8)
            i, seen = _find(level.contexts, context)
            gram = (context << np.uint64(8)) | (c & np.uint64(255))
            j, hit = _find(level.grams, gram)
            if not len(level.contexts):
                continue
            t = np.where(seen, level.total[i], 0) - gone_t[open_]
            d = np.where(seen, level.distinct[i], 0) - gone_d[open_]
            w = open_[hit]
            out[w] += np.log10((level.counts[j[hit]] - 0.5) / t[hit])
            escape = seen & ~hit & (d > 0)
            w = open_[escape]
            out[w] += np.log10(0.5 * d[escape] / t[escape])
            gone_t[open_] = np.where(seen, level.below[i], 0)
            gone_d[open_] = np.where(seen, level.distinct[i], 0)
            open_ = open_[~hit]
        if len(open_):
            out[open_] -= np.log10(256 - len(self.levels[0].grams))
        return out


def pack(a: np.ndarray) -> bytes:
    """Bytes of like weight together, so that small numbers compress."""
    if not len(a):
        return zlib.compress(b"")
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def gram_shards(codes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each code, by its KEY nearest context bytes."""
    return (((codes >> np.uint64(8 * (ORDER - KEY) + 8)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def word_shard(word: bytes, shards: int) -> int:
    return xxhash.xxh32_intdigest(word) % shards


class Block:
    """The texts of one block: words, grams and their shards, always in one order."""

    def __init__(self, pdf: pd.DataFrame):
        self.words = [tokens(x) for x in pdf["data"]]
        self.held = pdf["held_out"].to_numpy(bool)
        self.codes, self.lengths = gram_codes([stream(w) for w in self.words])

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes and their counts in training texts."""
        held = np.repeat(self.held, self.lengths)
        keys = np.sort((self.codes << np.uint64(1)) | held)
        codes = keys >> np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[at], np.add.reduceat((keys & np.uint64(1)) == 0, at, dtype=np.uint32)

    def word_lists(self, shards: int) -> dict[int, list[bytes]]:
        """Distinct words of each word shard that the block touches, sorted."""
        out: dict[int, list[bytes]] = {}
        for w in sorted(set().union(*self.words)):
            out.setdefault(word_shard(w, shards), []).append(w)
        return out


def _ask(shards: int):
    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's messages: grams and words for the shards, short grams, totals."""
        block, b = Block(pdf), int(pdf["block"].iloc[0])
        codes, counts = block.grams()
        shard = gram_shards(codes, shards)
        order = np.argsort(shard, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
        rows = [("gram", int(shard[mine[0]]), b, pack_sorted(codes[mine]), pack(counts[mine]), 0, 0) for mine in np.split(order, at[1:])]
        known = Counter()
        for words, held in zip(block.words, block.held.tolist(), strict=True):
            if not held:
                known.update(words)
        for s, words in block.word_lists(shards).items():
            rows.append(("word", s, b, zlib.compress(END.join(words), 1), pack(np.array([known[w] for w in words], np.uint32)), 0, 0))
        drop = np.uint64(8 * (ORDER - KEY + 1) + 8)
        short, times = summed(((codes >> drop) << np.uint64(8)) | (codes & np.uint64(255)), counts.astype(np.uint64))
        docs = int((~block.held).sum())
        rows.append(("short", b % shards, b, pack_sorted(short), pack(times), known.total() + docs, docs))
        return pd.DataFrame(rows, columns=["kind", "shard", "block", "keys", "counts", "tokens", "docs"])

    return ask


def _answer_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for each block of a word shard; a last row has how many words are known."""
    keys = [zlib.decompress(k).split(END) for k in pdf["keys"]]
    known: Counter = Counter()
    for words, counts in zip(keys, pdf["counts"], strict=True):
        for w, c in zip(words, unpack(counts, np.uint32).tolist(), strict=True):
            if c:
                known[w] += c
    rows = [("word", s, b, pack(np.array([known[w] for w in words], np.uint64)), 0) for s, b, words in zip(pdf["shard"], pdf["block"], keys, strict=True)]
    rows.append(("known", pdf["shard"].iloc[0], -1, b"", len(known)))
    return pd.DataFrame(rows, columns=["kind", "shard", "block", "values", "known"])


def _answer_grams(short: tuple[bytes, bytes]):
    made: list[Shared] = []

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Shared(unpack_sorted(short[0]), unpack(short[1], np.uint64).astype(np.int64)))
        keys = [unpack_sorted(k) for k in pdf["keys"]]
        counts = [unpack(c, np.uint32).astype(np.int64) for c in pdf["counts"]]
        grams, total = summed(np.concatenate(keys), np.concatenate(counts))
        log10 = Trie(grams, total, made[0]).log10(grams).astype(np.float32)
        rows = [("gram", s, b, pack(log10[np.searchsorted(grams, k)]), 0) for s, b, k in zip(pdf["shard"], pdf["block"], keys, strict=True)]
        return pd.DataFrame(rows, columns=["kind", "shard", "block", "values", "known"])

    return answer


def _short_grams(asked: DataFrame) -> tuple[bytes, bytes]:
    """Grams of KEY - 1 context bytes that occur in training texts, and their counts, packed.

    There are at most 2^24 of them; every task sends those it has, summed.
    """

    def add(batches):
        grams, counts = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for pdf in batches:
            for k, c in zip(pdf["keys"], pdf["counts"], strict=True):
                grams, counts = summed(np.concatenate([grams, unpack_sorted(k)]), np.concatenate([counts, unpack(c, np.uint64)]))
        yield pd.DataFrame({"keys": [pack_sorted(grams)], "counts": [pack(counts)]})

    sums = asked.where("kind = 'short'").select("keys", "counts").mapInPandas(add, "keys binary, counts binary").repartition(16).mapInPandas(add, "keys binary, counts binary")
    grams, counts = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for k, c in sums.collect():
        grams, counts = summed(np.concatenate([grams, unpack_sorted(bytes(k))]), np.concatenate([counts, unpack(bytes(c), np.uint64)]))
    return pack_sorted(grams[counts > 0]), pack(counts[counts > 0])


def _score(shards: int):
    return lambda docs, answers: _added(docs, answers, shards)


def _added(docs: pd.DataFrame, answers: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Adds a block's answers up along its texts."""
    columns = ["doc_id", "held_out", "n_tokens", "words_known", "words_log10", "score"]
    if docs.empty:
        return pd.DataFrame({c: [] for c in columns})
    block = Block(docs)
    codes = np.unique(block.codes)
    place = places(codes, block.codes)
    shard, log10 = gram_shards(codes, shards), np.zeros(len(codes))
    order = np.argsort(shard, kind="stable")
    met, first = np.unique(shard[order], return_index=True)
    spans = dict(zip(met.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))
    lists, seen = block.word_lists(shards), {}
    for kind, s, values in zip(answers["kind"], answers["shard"], answers["values"], strict=True):
        if kind == "gram":
            log10[order[slice(*spans[s])]] = unpack(values, np.float32)
        else:
            seen.update(zip(lists[s], unpack(values, np.uint64).tolist(), strict=True))
    at = np.cumsum(block.lengths) - block.lengths
    score = np.add.reduceat(log10[place], at)
    rows = []
    for doc_id, held, words, total in zip(docs["doc_id"], block.held.tolist(), block.words, score.tolist(), strict=True):
        c = np.fromiter(map(seen.__getitem__, words), np.float64, len(words))
        rows.append((doc_id, held, len(words) + 1, int((c > 0).sum()), float(np.log10(c + 0.5).sum()), total))
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def score(docs: DataFrame, held_out) -> DataFrame:
    """Learns from docs(doc_id, text) where not `held_out` and scores all of docs.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. A null or empty text is its end alone. Equal rows are scored each
    for itself. With no training text the model is uniform over bytes and the
    base over one unseen token; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    shards = max(LEAST_SHARDS, blocks // BLOCKS_A_SHARD)
    # equal rows are dealt out too; the deal is written, as blocks are read twice
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "data", F.monotonically_increasing_id()), F.lit(blocks)))
    docs = table(dealt, "blocks")
    asked = table(docs.groupBy("block").applyInPandas(_ask(shards), "kind string, shard int, block bigint, keys binary, counts binary, tokens bigint, docs bigint"), "grams")
    short = _short_grams(asked)
    totals = asked.agg(F.sum("tokens"), F.sum("docs")).first()
    train_tokens, ends = int(totals[0] or 0), int(totals[1] or 0)
    schema = "kind string, shard int, block bigint, values binary, known bigint"
    grams = asked.where("kind = 'gram'").groupBy("shard").applyInPandas(_answer_grams(short), schema)
    words = asked.where("kind = 'word'").groupBy("shard").applyInPandas(_answer_words, schema)
    answers = table(grams.unionByName(words), "answers")
    drop(asked)
    distinct = int(answers.agg(F.sum("known")).first()[0] or 0) + (ends > 0)
    scored = docs.groupBy("block").cogroup(answers.where("block >= 0").select("kind", "shard", "values", "block").groupBy("block")).applyInPandas(_score(shards), "doc_id bigint, held_out boolean, n_tokens bigint, words_known bigint, words_log10 double, score double")
    per_token = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("words_known") + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("words_log10") + float(np.log10(ends + 0.5)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )


def op1_ppm_score(spark, sf_dir) -> DataFrame:
    """The contract's query: learns where crc32(doc_id) mod 5 is not 1, scores all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
