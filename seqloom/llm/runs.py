"""Periodic runs of words by Lyndon roots.

The longest Lyndon word that starts at each place comes straight out of the
grouping phase of a suffix sorter (after Baier), once under the order of the
words and once under the reverse order. Every run has such a word as its root
in one of the two orders, so each root that repeats is extended to both sides
by longest common extensions, and what is long enough is a run.

Before that a text is cut to the stretches that can hold runs. A run of length
l and period p with l >= 2p + 4 has each of its places covered by five words in a
row that occur elsewhere in the text too, so a maximal stretch of such places
holds the whole run. Stretches come from hashes, which can only add places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

#: Words in a row that a run repeats, in each of its places.
GRAM = 5
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def lyndon_lengths(s: list[int]) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place of s.

    Suffixes stand in groups of equal context, lowest group first. The highest
    group not done yet is taken; the last place before each of its suffixes whose
    group is lower gets the context of the group appended, as often as
    suffixes of the group follow it, and moves to a group right above its own.
    In the end the context of a suffix is its longest Lyndon prefix.
    """
    n = len(s)
    order = np.argsort(np.asarray(s), kind="stable")
    by_value = np.asarray(s)[order]
    first = np.flatnonzero(np.concatenate([[True], by_value[1:] != by_value[:-1]])) if n else np.empty(0, np.int64)
    at, place, group = order.tolist(), [0] * n, [0] * n
    last_of = [0] * n
    for g, e in zip(first.tolist(), [*(first[1:] - 1).tolist(), n - 1], strict=False):
        last_of[g] = e
        for i in range(g, e + 1):
            place[at[i]] = i
            group[at[i]] = g
    length, before = [1] * n, [-1] * n
    end = n - 1
    while end >= 0:
        g = group[at[end]]
        members = at[g : end + 1] if g < end else [at[g]]
        if g < end:
            members.sort()
        by = length[members[0]]
        follows: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                follows[j] = follows.get(j, 0) + 1
        end = g - 1
        times = sorted(set(follows.values()), reverse=True)
        for k in times:
            moved: dict[int, list[int]] = {}
            for j, c in follows.items():
                if c == k:
                    old = group[j]
                    moved.setdefault(old, []).append(j)
            for old, js in moved.items():
                top = last_of[old]
                new = top - len(js) + 1
                for j in js:
                    # j changes places with the last of its group
                    other, p, t = at[last_of[old]], place[j], last_of[old]
                    at[p], place[other] = other, p
                    at[t], place[j] = j, t
                    last_of[old] = t - 1
                    length[j] += k * by
                for j in js:
                    group[j] = new
                last_of[new] = top
    return np.array(length, np.int64)


class Extensions:
    """Longest common extensions between places of s, by ranks of blocks of 1, 2, 4 .. symbols."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.ranks = [s]
        width = 1
        while 2 * width <= self.n:
            low = self.ranks[-1]
            pair = low[:-width].astype(np.int64) * (int(low.max()) + 1) + low[width:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1])
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a on equal those from b on; a < b."""
        total = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, width = self.ranks[level], 1 << level
            for _ in range(2 if level == len(self.ranks) - 1 else 1):
                fits = np.flatnonzero(b + total + width <= self.n)
                same = fits[r[a[fits] + total[fits]] == r[b[fits] + total[fits]]]
                total[same] += width
        return total

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a equal those before b; a < b."""
        total = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            r, width = self.ranks[level], 1 << level
            for _ in range(2 if level == len(self.ranks) - 1 else 1):
                fits = np.flatnonzero(a - total - width >= 0)
                same = fits[r[a[fits] - total[fits] - width] == r[b[fits] - total[fits] - width]]
                total[same] += width
        return total


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Half-open stretches, each covered by GRAM-grams that occur twice or more in ids."""
    m = len(ids) - GRAM + 1
    if m < 2:
        return []
    h = np.zeros(m, np.uint64)
    for k in range(GRAM):
        h = (h ^ ids[k : k + m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return []
    again = np.zeros(m, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + GRAM - 1).tolist(), strict=True))


def find_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of ids, by start, then period.

    A run is maximal, its period the smallest, its length at least `least` and
    `times` periods. times is 4 or more, and least 6 or more, which stretches() needs.
    """
    if times < 4 or least < 6:
        raise ValueError("runs are of 4 periods and 6 words at least")
    found = []
    for start, end in stretches(ids):
        part = np.unique(ids[start:end], return_inverse=True)[1]
        whole = Extensions(part)
        starts, periods = [], []
        for s in (part, part.max() - part):
            p = lyndon_lengths(s.tolist())
            i = np.flatnonzero(np.arange(len(p)) + 2 * p <= len(p))
            starts.append(i)
            periods.append(p[i])
        i, p = np.concatenate(starts), np.concatenate(periods)
        ahead = whole.right(i, i + p)
        twice = ahead >= p
        i, p, ahead = i[twice], p[twice], ahead[twice]
        back = whole.left(i, i + p)
        rows = np.stack([i - back, back + p + ahead, p], 1)
        rows = np.unique(rows[rows[:, 1] >= np.maximum(least, times * p)], axis=0)
        rows[:, 0] += start
        found.append(rows)
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, but for those in a run after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of docs(doc_id, text).

    Words are what ASCII white space separates. A run is a maximal stretch whose
    words `period` apart are equal, of `least` words and `times` periods at least;
    `collapsed` is the text with one period of each run, a space between words. A
    null or empty text has no words, no runs and an empty collapsed text. Each row
    is answered for itself, so repeated rows give repeated answers, whatever
    doc_id is. Very long texts are handled whole, in memory linear in their words times
    the logarithm of their longest repeating stretch. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            n_words, offsets, rows, texts = [], [0], [], []
            for text in batch.column("data"):
                words = (text.as_py() or b"").split()
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                found = find_runs(ids, least, times) if len(known) < len(words) else np.empty((0, 3), np.int64)
                rows.append(found)
                offsets.append(offsets[-1] + len(found))
                n_words.append(len(words))
                texts.append(collapsed(words, found).decode())
            flat = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth crc32(doc_id) words from g % n on repeat with a period.

    A null doc_id leaves its text alone.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    a, p = "g % size(w)", "1 + (size(w) - g % size(w)) div (3 + g % 8)"
    # transform(array(x), v -> ...)[0] takes x once and calls it v
    edited = f"transform(array({words}), w -> IF(size(w) = 0, '', array_join(transform(w, (x, i) -> IF(i < {a}, x, w[cast({a} + (i - {a}) % ({p}) as int)])), ' ')))[0]"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.expr("h div 10").alias("g")).select("doc_id", F.expr(f"IF(h % 10 = 0, {edited}, text)").alias("text"))


def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    """The contract's query: runs of four periods and six words, as counts and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs))
    none = f"cast(null as {RUN})"
    # lengths and periods are under 2^31, so products of two fit
    best = f"aggregate(runs, {none}, (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"
    lines = r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"
    return found.withColumn("best", F.expr(best)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
