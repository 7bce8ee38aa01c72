"""Phrase collocations by marginalising the longest windows.

Each word leads one window: itself and the words after it in its piece, up to
`longest` of them, padded with nulls. Only these windows are counted. A ROLLUP over
their columns then gives the count of every shorter phrase as the sum over
the windows that it begins, so that no order but the longest is ever exploded.

A window ends early where two neighbours occur together fewer than `least` times, as
no phrase that is frequent enough goes on from there. Which pairs those are is told
by a sieve: pairs are counted in buckets of a hash, and a pair in a bucket with fewer
than `least` is too rare for certain. Buckets that several pairs share only
leave a few windows longer, so the counts are exact whatever the hash does. The
sieve is a bitmap of a size that follows the input up to SIEVE_BITS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import ship, table

#: Words that a task gathers before it counts them.
GATHER = 1_000_000
#: Buckets of the sieve: one for so many bytes of text, between two bounds (as powers of two).
BUCKET_BYTES, SIEVE_BITS = 64, (20, 28)
#: Buckets of a part of the sieve, as a power of two.
PART_BITS = 16
#: Shares of a language's phrases that are ranked apart before they are ranked together.
RANK_SHARES = 64

_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")


def tokens(data: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and a word \\xff for each character that ends a piece."""
    return data.lower().translate(_SPLIT).replace(b"\xff", b" \xff ").split(b" ")


class Gathered:
    """Word numbers of many texts of one language, 0 where a piece ends."""

    def __init__(self, lang: str):
        self.lang = lang
        self.known: dict[bytes, int] = {b"\xff": 0, b"": -1}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        known = self.known
        words = tokens(data)
        ids = np.fromiter([known.setdefault(w, len(known) - 1) for w in words], np.int32, len(words))
        self.parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        self.size += len(words) + 1

    def take(self):
        """(ids, words, pair hash of each place with the next; 0 at the last)."""
        ids = np.concatenate(self.parts)
        # numbers count from 1 in order of first sight; the first two keys mark breaks and blanks
        words = list(self.known)[2:]
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        h = np.concatenate([np.zeros(1, np.uint64), h])
        pair = np.zeros(len(ids), np.uint64)
        seed = np.uint64(xxhash.xxh64_intdigest(self.lang.encode()))
        x = (h[ids[:-1]] ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31)) ^ h[ids[1:]]) * np.uint64(0xBF58476D1CE4E5B9)
        pair[:-1] = x ^ (x >> np.uint64(32))
        together = np.zeros(len(ids), bool)
        together[:-1] = (ids[:-1] > 0) & (ids[1:] > 0)
        return ids, words, pair, together


def _gathered(batches):
    """Texts of Arrow batches (lang, data), in lots of about GATHER words of one language."""
    held: dict[str, Gathered] = {}
    size = 0
    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data"), strict=True):
            g = held.setdefault(lang, Gathered(lang))
            before = g.size
            g.add(data.as_py())
            size += g.size - before
            if size >= GATHER:
                yield from held.values()
                held, size = {}, 0
    yield from held.values()


def _sieve(docs: DataFrame, bits: int, least: int) -> bytes:
    """Bitmap of the buckets with `least` pairs or more.

    Tasks send, for each part of the buckets, which of them they met and how often (up
    to `least` at a time); a part is summed in an array of its own as its messages come.
    """
    low = min(bits, PART_BITS)
    size = 1 << low
    kind = np.uint8 if least < 256 else np.uint32

    def count(batches):
        for g in _gathered(batches):
            _, _, pair, together = g.take()
            bucket, n = np.unique(pair[together] >> np.uint64(64 - bits), return_counts=True)
            n = np.minimum(n, least).astype(kind)
            part = (bucket >> np.uint64(low)).astype(np.int32)
            within = (bucket & np.uint64(size - 1)).astype(np.uint16)
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
            rows = [(int(part[s]), within[s:e].tobytes(), n[s:e].tobytes()) for s, e in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "met", "n"])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for part, met, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != now:
                    if now is not None:
                        yield bitmap(now, total)
                    now, total = part, np.zeros(size, np.int64)
                total[np.frombuffer(met, np.uint16)] += np.frombuffer(n, kind)
        if now is not None:
            yield bitmap(now, total)

    def bitmap(part, total):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    messages = docs.mapInArrow(count, "part int, met binary, n binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((1 << bits) // 8, np.uint8)
    # 2^bits bits in all, at most, one part at a time
    for part, found in messages.mapInArrow(add, "part int, bits binary").toLocalIterator():
        out[part * size // 8 : (part + 1) * size // 8] = np.frombuffer(bytes(found), np.uint8)
    return out.tobytes()


def windows(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, w0 .. w<longest - 1>, n): windows led by each word, partly counted."""
    size = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # a bitmap has whole bytes
    bits = max(min(max((size // BUCKET_BYTES).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1]), 3)
    sieve = _sieve(docs, bits, least)
    names = [f"w{k}" for k in range(longest)]

    def lead(batches):
        frequent = np.frombuffer(sieve, np.uint8)
        for g in _gathered(batches):
            ids, words, pair, together = g.take()
            bucket = pair >> np.uint64(64 - bits)
            goes_on = together & ((frequent[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            alone = np.bincount(ids[(ids > 0) & ~goes_on], minlength=len(words) + 1)
            one = np.flatnonzero(alone)
            start = np.flatnonzero(goes_on)
            columns = [ids[start].astype(np.int64)]
            live = np.ones(len(start), bool)
            for k in range(1, longest):
                live = live & goes_on[np.minimum(start + k - 1, len(ids) - 1)]
                columns.append(np.where(live, ids[np.minimum(start + k, len(ids) - 1)], 0).astype(np.int64))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            if len(order):
                new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            at = np.flatnonzero(new)
            n = np.concatenate([alone[one], np.diff(np.append(at, len(order)))])
            columns = [np.concatenate([one, columns[0][at]]), *[np.concatenate([np.zeros(len(one), np.int64), c[at]]) for c in columns[1:]]]
            text = pa.array([None, *[w.decode() for w in words]], pa.string())
            for a in range(0, len(n), 1 << 18):
                part = [text.take(pa.array(c[a : a + (1 << 18)])) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([g.lang] * len(part[0]), pa.string()), *part, pa.array(n[a : a + (1 << 18)].astype(np.int64))], ["lang", *names, "n"])

    return docs.mapInArrow(lead, "lang string, " + ", ".join(f"{c} string" for c in names) + ", n bigint")


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, words array, n): a row of no words with the words of each language, and each phrase that occurs `least` times or more."""
    names = [f"w{k}" for k in range(longest)]
    top = table(windows(docs, longest, least).groupBy("lang", *names).agg(F.sum("n").alias("n")), "windows")
    # grouping_id has a bit for each column summed over; a phrase of k words leaves longest - k of them
    rolled = top.where("w1 IS NOT NULL").rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # a window of one word has nothing but the word to sum to
    alone = top.where("w1 IS NULL").rollup("lang", "w0").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    whole = (1 << longest) - 1
    words = lambda k: F.array(*[F.col(c) for c in names[:k]]).cast("array<string>")
    low = alone.where("lang IS NOT NULL AND (level = 1 OR (level = 0 AND w0 IS NOT NULL))").select("lang", F.when(F.col("level") == 1, words(0)).otherwise(words(1)).alias("words"), "n")
    low = low.unionByName(rolled.where(f"level = {whole} OR level = {whole >> 1}").where("lang IS NOT NULL").select("lang", F.when(F.col("level") == whole, words(0)).otherwise(words(1)).alias("words"), "n"))
    low = low.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(f"size(words) = 0 OR n >= {least}")
    longer = rolled.where(" OR ".join(f"(level = {whole >> k} AND w{k - 1} IS NOT NULL)" for k in range(2, longest + 1))).where(F.col("n") >= least)
    return low.unionByName(longer.select("lang", F.expr(f"filter(array({', '.join(names)}), w -> w IS NOT NULL)").alias("words"), "n"))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of docs(text, lang).

    A phrase has 2 to `longest` words of one piece and occurs a >= `least` times. Cut
    into a first part that occurs l times and a rest that occurs r times, it
    scores floor(1000 * a * n / (l * r)), n being all words of the language; the cut
    that scores least counts, the earliest of equal ones. A phrase within a longer one
    that occurs as often is dropped. Ranks go by score, a, then the phrase's
    bytes. A null text counts as empty, a null lang as `und`; repeated rows count each
    time; very long texts are taken whole. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    counts = table(phrase_counts(rows, longest, least), "phrases")
    all_words = counts.where("size(words) = 0").select("lang", F.col("n").alias("all_n"))
    named = counts.where("size(words) > 0").select("lang", F.array_join("words", " ").alias("phrase"), "n")
    found = counts.where("size(words) > 1").select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"))
    inner = "flatten(transform(sequence(2, size(words)), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))"
    longer = found.select("lang", "a", "phrase", F.explode(F.expr(inner)).alias("part")).where("part <> phrase").groupBy(F.col("lang").alias("in_lang"), "part").agg(F.max("a").alias("most"))
    alone = found.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")), "left").where("most IS NULL OR 100 * most < 100 * a").drop("in_lang", "part", "most")
    cuts = alone.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("rest"))
    part = lambda name, n: named.select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(name + "_is"), F.col("n").alias(n))
    for name, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part(name, n), (F.col("lang") == F.col(f"{n}_lang")) & (F.col(name) == F.col(name + "_is")))
    cuts = cuts.join(all_words.withColumnRenamed("lang", "n_lang"), F.col("lang") == F.col("n_lang"))
    exact = lambda c: f"cast({c} as decimal(17, 0))"
    # counts under 10^17, so that each product is exact in 38 digits
    score = f"(1000BD * {exact('a')} * {exact('all_n')}) div ({exact('l')} * {exact('r')})"
    cuts = cuts.withColumn("score", F.expr(score))
    best = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("all_n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES))).orderBy(*order)
    first = best.withColumn("_at", F.row_number().over(share)).where(F.col("_at") <= top).drop("_at")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir) -> DataFrame:
    """The contract's query: phrases of 2 to 5 words that occur 100 times, the first 2000 of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, p FROM (SELECT lang, unnest(p) AS p FROM texts)),
words AS MATERIALIZED (
    SELECT lang, piece, i, w FROM (SELECT lang, piece, unnest(string_split_regex(p, '[\x20\x09]+')) AS w, generate_subscripts(string_split_regex(p, '[\x20\x09]+'), 1) AS i FROM pieces)
    WHERE w <> ''),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
leads AS (
    SELECT lang, w AS p1, p1 || ' ' || lead(w, 1) OVER p AS p2, p2 || ' ' || lead(w, 2) OVER p AS p3, p3 || ' ' || lead(w, 3) OVER p AS p4, p4 || ' ' || lead(w, 4) OVER p AS p5
    FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
counted AS (
    SELECT lang, p, count(*) AS f
    FROM (SELECT lang, p1 AS p FROM leads UNION ALL SELECT lang, p2 FROM leads UNION ALL SELECT lang, p3 FROM leads UNION ALL SELECT lang, p4 FROM leads UNION ALL SELECT lang, p5 FROM leads)
    WHERE p IS NOT NULL GROUP BY lang, p HAVING count(*) >= 100),
grams AS (SELECT lang, string_split(p, ' ') AS p, len(string_split(p, ' ')) AS k, f FROM counted),
longer AS (
    SELECT g.lang, g.p[s.i : s.i + s.k - 1] AS p, max(g.f) AS f
    FROM grams g, (SELECT i, k FROM range(1, 5) AS a(i), range(2, 5) AS b(k)) s
    WHERE s.k < g.k AND s.i + s.k - 1 <= g.k GROUP BY ALL),
cuts AS (
    SELECT g.lang, g.p, g.f AS a, c.k AS cut_at, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * g.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM grams g JOIN range(1, 5) AS c(k) ON c.k < g.k
    JOIN grams l ON l.lang = g.lang AND l.p = g.p[1 : c.k]
    JOIN grams r ON r.lang = g.lang AND r.p = g.p[c.k + 1 : g.k]
    JOIN totals t ON t.lang = g.lang
    WHERE g.k > 1 AND NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = g.lang AND o.p = g.p AND 100 * o.f >= 100 * g.f)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut_at) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
    array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
