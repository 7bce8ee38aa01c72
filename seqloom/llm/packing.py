"""Hierarchical multi-length packing of token ids into windows of several sizes.

A document is cut at multiples of the longest window only. Whole windows are
sequences of their own; each remainder goes to the smallest tier that holds it.
What is packed is the table of lengths: how many remainders have each of the
(at most 4096) lengths. It has a fixed size whatever the corpus, so a plan of
window patterns is made from it in one place; then every remainder finds its
seat by its rank within its length, with joins only.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.units import Memory
from seqloom.session import ship, table

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
RANK_SALTS = 256
STEP = 64


class Ids:
    """Token ids by the tokenizers library, which sees each distinct unit once.

    For a tokenizer that drops white space, folds case and marks word ends.
    """

    PLAIN = re.compile(rb"[a-z]+|[0-9]|[^\x80-\xff'\sa-z0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memory = Memory(self._learn, (np.uint32,))

    def _learn(self, units: list[bytes]) -> tuple[list[np.ndarray]]:
        """Units that are one pre-token each go many to a call; word ends part their ids."""
        out: list = [None] * len(units)
        plain = [i for i, u in enumerate(units) if self.PLAIN.fullmatch(u) and b"<|" not in u]
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            ids = np.array(self.tokenizer.encode(b" ".join([units[i] for i in part]).decode(), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part) and stop[-1] == len(ids):
                for i, x in zip(part, np.split(ids, stop[:-1]), strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return (out,)

    def batch(self, texts: list[bytes]):
        """The ids of each text."""
        return (x for (x,) in self.memory.texts(texts, fold=True))


_LOADED: dict[str, Ids] = {}


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of docs(doc_id, text).

    Cuts lie at multiples of the window, so every piece but a document's last
    fills a window. A null text counts as empty; each document has the end id.
    """

    def run(batches):
        at = path
        if at is None:
            import public_tokenizers

            at = public_tokenizers.path("word_bpe_49k.json")
        if at not in _LOADED:
            _LOADED[at] = Ids(at)
        end = np.array([end_id], np.uint32)
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], _LOADED[at].batch([x or b"" for x in pdf["data"]]), strict=True):
                ids = np.concatenate([ids, end])
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    rows.append((doc_id, s, len(part), zlib.crc32(part.astype("<u4", copy=False)), len(ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int]], int]]:
    """Window patterns [(tier, [(length, how many), ...], repeats)] for a table of lengths.

    Tiers are packed from the longest. A window opens with the longest length
    left in its tier; its gap is filled by the longest lengths that fit, from
    its own tier and then from shorter ones. A shorter tier keeps only the
    windows that come out full, as those alone need no padding; its other
    heads open windows of the longest tier. One pattern repeats as often as the
    lengths last, so work follows the number of lengths and not of documents.
    Every length of counts is seated exactly once.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    alive = sorted(left)
    top, found = max(tiers), []

    def fill(head: int, size: int) -> tuple[dict[int, int], int]:
        pattern, gap, at = {}, size, bisect_right(alive, head) - 1
        while gap and at >= 0:
            n = alive[at]
            if use := min(gap // n, left[n]):
                pattern[n] = use
                gap -= use * n
            at = min(at, bisect_right(alive, gap)) - 1
        return pattern, gap

    while alive:
        head = alive[-1]
        tier = min(t for t in tiers if t >= head)
        pattern, gap = fill(head, tier)
        if gap and tier < top:
            tier = top
            pattern, gap = fill(head, top)
        repeats = min(left[n] // use for n, use in pattern.items())
        for n, use in pattern.items():
            left[n] -= use * repeats
            if not left[n]:
                del alive[bisect_left(alive, n)]
        found.append((tier, sorted(pattern.items(), reverse=True), repeats))
    return found


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rank: a gapless number from 0 within the key, without a task per key.

    Rows are numbered within (key, salt) and shifted by what the salts before
    hold; the salt is a hash of the order columns.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(RANK_SALTS)).cast("int"))
    so_far = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most RANK_SALTS rows for each key
    before = salted.groupBy(key, "salt").agg(F.count("*").alias("n")).select(key, "salt", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("shift"))
    numbered = salted.withColumn("rn", F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1)
    return numbered.join(before, [key, "salt"]).withColumn("rank", F.col("rn") + F.col("shift")).drop("salt", "rn", "shift")


def pack(parts: DataFrame, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """Adds sequence_id, offset, tier and step_group to pieces().

    Sequences are numbered gaplessly; of a step group's `step` consecutive
    sequences each tier has about its share, so steps carry like loads.
    Zero rows in, zero rows out.
    """
    spark = parts.sparkSession
    # at most as many rows as the longest window has tokens
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").agg(F.count("*")).collect()}
    patterns = plan(counts, tiers)
    total = sum(r for _, _, r in patterns)
    seats, seen, first = [], {n: 0 for n in counts}, 0
    for tier, pattern, repeats in patterns:
        offset = 0
        for n, use in pattern:
            seats.append((n, seen[n], seen[n] + use * repeats, use, first, repeats, offset, tier))
            seen[n] += use * repeats
            offset += n * use
        first += repeats
    schema = "length bigint, from bigint, to bigint, use bigint, first bigint, repeats bigint, base bigint, tier int"
    # patterns are bounded by the number of lengths, so this side is broadcast whatever the corpus
    by_length = spark.createDataFrame(seats or [], schema).groupBy("length").agg(F.sort_array(F.array_agg(F.struct("from", "to", "use", "first", "repeats", "base", "tier"))).alias("seats"))
    found = ranked(parts, "length", ["doc_id", "start", "ids_crc32"]).join(F.broadcast(by_length), "length")
    found = found.withColumn("seat", F.expr("filter(seats, s -> s.from <= rank AND rank < s.to)[0]")).drop("seats")
    at = F.col("rank") - F.col("seat.from")
    # the k-th window of a pattern takes seats k, k + repeats, ...
    spread = F.col("seat.first") + at % F.col("seat.repeats")
    # a fixed stride that shares no factor with the total deals the tiers over the step groups
    stride = next((s for s in range(max(1, int(total * 0.6180339887)), 2 * total + 3) if np.gcd(s, max(1, total)) == 1), 1)
    placed = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", ((spread.cast("decimal(38,0)") * F.lit(stride)) % F.lit(max(1, total))).cast("bigint").alias("sequence_id"), (F.col("seat.base") + F.floor(at / F.col("seat.repeats")).cast("bigint") * F.col("length")).alias("offset"), F.col("seat.tier").alias("tier"))
    return placed.withColumn("step_group", F.floor(F.col("sequence_id") / step).cast("bigint"))


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokenize, cut and pack docs(doc_id, text); one row per piece.

    Pieces are a written table, as they are read three times. Documents with
    equal or null ids are packed each for itself.
    """
    return pack(table(pieces(docs, path), "pieces"))


def op5_packing(spark, sf_dir) -> DataFrame:
    """The contract's query over all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), os.environ.get("SEQLOOM_WORD_BPE"))
