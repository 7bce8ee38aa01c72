"""Candidate overlaps of sequences: minimizer seeds and chains of colinear anchors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.session import drop, ship, table

#: The order of k-mers: their value in base four times this odd number, modulo 2^64.
MIX = 0x9E3779B97F4A7C15
#: Characters hashed at a time; longer texts go in pieces.
PIECE = 1 << 20
#: Characters of short texts that are hashed together.
GROUP = 1 << 17
#: Seeds or anchors that a block sends and that a bucket holds on average; buckets at least.
BLOCK, BUCKETS = 1 << 19, 128
SEED = np.dtype([("hash", "<u8"), ("id", "<i8"), ("place", "<u4")])
MEMBER = np.dtype([("id", "<i8"), ("place", "<u4")])
ANCHOR = np.dtype([("a", "<i8"), ("b", "<i8"), ("at", "<i8")])
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_CODE[np.frombuffer(b"acgt", np.uint8)] = range(4)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def spelled(letters: str, bases: str):
    """Arrow function (text, turned): translate(text, letters, bases), and its reverse complement where turned.

    Letters and bases are ASCII, so whole texts go through tables of bytes.
    """
    to, away, turn = bytes.maketrans(letters[: len(bases)].encode("ascii"), bases.encode("ascii")), letters[len(bases) :].encode("ascii"), bytes.maketrans(b"ACGTacgt", b"TGCAtgca")

    def one(text: str | None, turned: bool) -> str | None:
        if text is None:
            return None
        dna = text.encode().translate(to, away)
        return dna.translate(turn).decode()[::-1] if turned else dna.decode()

    @F.pandas_udf("string")
    def spell(text: pd.Series, turned: pd.Series) -> pd.Series:
        return pd.Series([one(t, b) for t, b in zip(text, turned)], dtype=object)

    # else a filter on the result would have it made twice
    return spell.asNondeterministic()


def _kmers(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all k-mers in base four, and whether each has four-letter symbols only, by doubled lengths."""
    n = len(code) - k + 1
    value, good, at = np.zeros(n, np.uint64), np.ones(n, bool), 0
    part, fine, size = (code & 3).astype(np.uint64), code < 4, 1
    while True:
        if k & size:
            value = (value << np.uint64(2 * size)) | part[at : at + n]
            good &= fine[at : at + n]
            at += size
        if 2 * size > k:
            return value, good
        part, fine = (part[:-size] << np.uint64(2 * size)) | part[size:], fine[:-size] & fine[size:]
        size *= 2


def _hashes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the lesser strand, is it the reverse one) of each k-mer; none for other letters and palindromes."""
    ahead, good = _kmers(code, k)
    back, _ = _kmers(np.where(code < 4, 3 - code, 4).astype(np.uint8)[::-1], k)
    ahead, back = ahead * np.uint64(MIX), back[::-1] * np.uint64(MIX)
    return np.where(good & (ahead != back), np.minimum(ahead, back), _NONE), back < ahead


def _lows(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least hash of each window of w (leftmost of equal ones)."""
    at, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        size += step
    return at


def _least(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of windows without repeats, and without those of no hash."""
    at = at[h[at] != _NONE]
    return at[np.diff(at, prepend=-1) != 0]


def minimizers_of(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, reverse) of a text's minimizers."""
    code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    windows = max(1, len(code) - k + 1 - w + 1)
    found: list[tuple] = []
    last = -1
    for s in range(0, windows, PIECE) if len(code) >= k else ():
        h, back = _hashes(code[s : min(s + PIECE, windows) + w + k - 2], k)
        at = _least(h, _lows(h, min(w, len(h))))
        at = at[at + s > last]
        if len(at):
            last = int(at[-1]) + s
            found.append((at + s, h[at].view(np.int64), back[at]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in zip(*found))


def _minimizers_of_all(part: np.ndarray, sizes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, ...]:
    """(lines, places, hashes, reverse) of texts that lie one behind the other in part, of the given sizes."""
    starts = np.cumsum(sizes + w) - sizes - w
    # w others after each text, so that no k-mer joins two texts
    code = np.full(int((sizes + w).sum()), 4, np.uint8)
    code[np.arange(len(part)) + np.repeat(w * np.arange(len(sizes)), sizes)] = _CODE[part]
    grams = sizes - k + 1
    windows = np.where(grams > 0, np.maximum(1, grams - w + 1), 0)
    if not windows.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
    h, back = _hashes(code, k)
    first = np.arange(windows.sum()) + np.repeat(starts - np.cumsum(windows) + windows, windows)
    at = _least(h, _lows(h, w)[first])
    lines = np.searchsorted(starts, at, side="right") - 1
    return lines, at - starts[lines], h[at].view(np.int64), back[at]


def _scanned(texts: pa.Array, k: int, w: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(lines, places, hashes, reverse) of a batch of texts, some texts at a time."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + GROUP, side="right")) - 1)
        if ends[j] - ends[i] > PIECE:
            at, h, back = minimizers_of(texts[i].as_py(), k, w)
            yield np.full(len(at), i), at, h, back
        else:
            part, cuts = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            letter = (part & 0xC0) != 0x80  # one byte of each character
            if not letter.all():
                part, cuts = part[letter], np.concatenate([[0], np.cumsum(letter)])[cuts]
            lines, *rest = _minimizers_of_all(part, np.diff(cuts), k, w)
            yield lines + i, *rest
        i = j


def minimizers(texts: DataFrame, id_: str, seq: str, k: int, w: int) -> DataFrame:
    """(id_, pos, hash, reverse): the (k, w) minimizers of each sequence, both strands alike.

    Of every w neighbouring k-mers the one of least hash is kept, a k-mer's hash
    being the lesser of its own and its reverse complement's. K-mers with other
    letters than ACGT and palindromes are left out. A sequence of fewer than w
    k-mers is one window; one of fewer than k letters, or null, has none.
    """
    _check(k)
    ship(texts.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines, at, h, back in _scanned(batch.column("_seq"), k, w):
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(lines)), pa.array(at), pa.array(h), pa.array(back)], ["id", "pos", "hash", "reverse"])

    kind = texts.schema[id_].dataType.simpleString()
    rows = texts.where(F.col(seq).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).alias("_id"), F.col(seq).alias("_seq"))
    return rows.mapInArrow(scan, f"id {kind}, pos bigint, hash bigint, reverse boolean").toDF(id_, "pos", "hash", "reverse")


def _check(k: int) -> None:
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def _runs(*sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal values."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sorted_], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.diff(starts, append=len(new))


def _blocks(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= BLOCK:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _dealt(rows: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """(bucket, rows): a block's records, one binary for each bucket."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    starts, sizes = _runs(to)
    return pa.RecordBatch.from_arrays([pa.array(to[starts], pa.int32()), pa.array([rows[s : s + n].tobytes() for s, n in zip(starts, sizes)], pa.binary())], ["bucket", "rows"])


def _joined(t: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in t.column("rows").to_pylist()])


@lru_cache(maxsize=8)
def _couples(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _anchors(members: np.ndarray) -> np.ndarray:
    """Anchors of seeds, one a line, between members of different texts; a < b, and the complement of `at` if b is turned."""
    i, j = _couples(members.shape[1])
    one, other, p, q = members["id"][:, i], members["id"][:, j], members["place"][:, i].astype(np.int64), members["place"][:, j].astype(np.int64)
    swap, apart = one > other, one != other
    p, q = np.where(swap, q, p)[apart], np.where(swap, p, q)[apart]
    turned = ((p ^ q) & 1).astype(bool)
    rows = np.empty(len(p), ANCHOR)
    rows["a"], rows["b"] = np.minimum(one, other)[apart], np.maximum(one, other)[apart]
    at = ((p >> 1) << 32) + np.where(turned, -(q >> 1), q >> 1) + (1 << 31)
    rows["at"] = np.where(turned, ~at, at)
    return rows


def _pair_key(rows: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(rows["a"].astype(np.uint64)) + rows["b"].astype(np.uint64))


def may_chain(pair: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, band: int, min_score: int) -> np.ndarray:
    """Whether a chain of a pair's anchors may reach min_score; pairs are numbered from 0.

    A chain's steps change diagonals by at most `band`, so it stays in one run of
    near diagonals; and it scores at most the letters that this run's anchors
    cover in x, and in y.
    """
    if not len(pair):
        return np.zeros(0, bool)
    order = np.lexsort((x - y, pair))
    pair, x, y = pair[order], x[order], y[order]
    part = np.cumsum((np.diff(pair, prepend=-1) != 0) | (np.diff(x - y, prepend=0) > band)) - 1
    fits = np.ones(part[-1] + 1, bool)
    for v in (x, y):
        order = np.lexsort((v, part))
        step = np.minimum(np.diff(v[order], prepend=0), k)
        step[np.diff(part[order], prepend=-1) != 0] = k
        fits &= np.bincount(part[order], step) >= min_score
    out = np.zeros(pair[-1] + 1, bool)
    out[pair[fits[part]]] = True
    return out


def best_chains(x: list[np.ndarray], y: list[np.ndarray], k: int, gap: int, band: int, back: int) -> np.ndarray:
    """(score, anchors, x and y of the first, x and y of the last) of each pair's best chain.

    Anchors come by (x, y). All pairs of a batch take a step at once; each anchor
    looks at the `back` before it, so pairs of fewer anchors need no more places.
    """
    sizes = np.array([len(a) for a in x])
    out = np.empty((len(x), 6), np.int64)
    low = 0
    for high in (8, 16, 32, max(33, *sizes)):
        lines = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(lines):
            out[lines] = _chains([x[i] for i in lines], [y[i] for i in lines], k, gap, band, min(back, high))
        low = high
    return out


def _chains(x: list[np.ndarray], y: list[np.ndarray], k: int, gap: int, band: int, back: int) -> np.ndarray:
    order = np.argsort([-len(a) for a in x], kind="stable")
    sizes = np.array([len(x[i]) for i in order])
    flat_x, flat_y = np.concatenate([x[i] for i in order]), np.concatenate([y[i] for i in order])
    first = np.cumsum(sizes) - sizes
    n = len(order)
    # ring of the last anchors: x, y, score, anchors, x and y of the chain's first
    ring = np.zeros((6, n, back), np.int64)
    ring[2] = -(1 << 60)
    best = np.zeros((n, 6), np.int64)
    for step in range(sizes[0]):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        ax, ay = flat_x[first[:live] + step], flat_y[first[:live] + step]
        px, py, ps, pn, sx, sy = ring[:, :live]
        dx, dy = ax[:, None] - px, ay[:, None] - py
        off = np.abs(dx - dy)
        cost = off * k // 100 + np.frexp(off.astype(np.float64))[1] // 2
        gain = ps + np.minimum(np.minimum(dx, dy), k) - cost
        gain[(dx <= 0) | (dy <= 0) | (dx > gap) | (dy > gap) | (off > band) | (ps < 0)] = -1
        # of equal gains the latest anchor's
        age = (step - 1 - np.arange(back)) % back
        pick = np.argmax(gain * back + (back - 1 - age), axis=1)
        lines = np.arange(live)
        won = gain[lines, pick]
        on = won > k
        new = np.stack([ax, ay, np.where(on, won, k), np.where(on, pn[lines, pick] + 1, 1), np.where(on, sx[lines, pick], ax), np.where(on, sy[lines, pick], ay)])
        ring[:, :live, step % back] = new
        more = new[2] > best[:live, 0]
        best[:live][more] = new[[2, 3, 4, 5, 0, 1]].T[more]
    out = np.empty_like(best)
    out[order] = best
    return out


def overlaps(texts: DataFrame, id_: str, seq: str, k: int = 25, w: int = 17, top: float = 0.0002, min_score: int = 100, min_occ: int = 10, max_occ: int = 1000, gap: int = 5000, band: int = 150, back: int = 64) -> DataFrame:
    """(a, b, reverse, score, anchors, a_start, a_end, b_start, b_end): the best chain of each pair and strand, a < b.

    Seeds are minimizers that occur at least twice and no more often than the
    cut-off: the frequency that a fraction `top` of all seeds passes, but at
    least min_occ and at most max_occ. Seeds shared by two sequences are anchors.
    A chain adds for each anchor min(k, step in a, step in b), less
    floor(k * d / 100) + floor(bits(d) / 2) for d letters between their
    diagonals; steps are at most `gap`, d at most `band`, and an anchor follows
    one of the `back` before it by places in a and b. Chains of min_score or
    more are given; places are half-open, of b's own strand.

    Equal sequences are searched once, as their least id; each other id is a pair
    (least id, id) with null places. Seeds go to buckets by hash and anchors to
    buckets by pair, as blocks of records; of a seed a block sends one more than
    max_occ at most, which tells that it is too frequent. A pair's anchors are
    one row, so it is the cut-off that bounds rows: by occurrences, not by
    sequences.
    """
    _check(k)
    spark = texts.sparkSession
    ship(spark)
    kind = texts.schema[id_].dataType
    rows = texts.where(F.col(id_).isNotNull() & F.col(seq).isNotNull()).select(F.col(id_).alias("_id"), F.col(seq).alias("_seq"))
    rows = table(rows.select("*", F.sha2("_seq", 256).alias("_key"), F.octet_length("_seq").alias("_size"), F.monotonically_increasing_id().alias("_row")), "sequences")
    # copies, and rows that are not searched
    known = rows.select("_id", "_key", "_row")
    known = known.join(known.groupBy(F.col("_key").alias("_lead")).agg(F.min("_id").alias("a")), F.col("_key") == F.col("_lead"))
    copies = table(known.where("a <> _id").select("a", F.col("_id").alias("b")).distinct(), "copies")
    kept = known.where("a = _id").groupBy("a").agg(F.min_by("_row", F.struct("_key", "_row")).alias("_row"))
    spare = table(rows.select("_row").join(kept, "_row", "left_anti"), "spare")
    one = rows.join(spare, "_row", "left_anti")
    if isinstance(kind, T.IntegralType):
        names, one = None, one.withColumn("_n", F.col("_id").cast("bigint"))
    else:
        # numbers in the order of ids
        names = table(one.select("_id").repartitionByRange("_id").sortWithinPartitions("_id").withColumn("_n", F.monotonically_increasing_id()), "names")
        one = one.join(names, "_id")
    letters = rows.agg(F.sum("_size")).first()[0] or 0
    buckets = max(BUCKETS, 2 * letters // ((w + 1) * BLOCK))

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids = batch.column("_n").to_numpy()
            for lines, at, h, reverse in _scanned(batch.column("_seq"), k, w):
                part = np.empty(len(at), SEED)
                part["hash"], part["id"], part["place"] = h.view(np.uint64), ids[lines], 2 * at + reverse
                yield part

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(minima(batches)):
            part = part[np.argsort(part["hash"])]
            starts, n = _runs(part["hash"])
            part = part[np.arange(len(part)) - np.repeat(starts, n) <= max_occ]
            yield _dealt(part, (_mixed(part["hash"]) % np.uint64(buckets)).astype(np.int32))

    def gather(t: pa.Table) -> pa.Table:
        part = _joined(t, SEED)
        part = part[np.argsort(part["hash"])]
        starts, n = _runs(part["hash"])
        n = np.minimum(n, max_occ + 1)
        members = np.empty(len(part), MEMBER)
        members["id"], members["place"] = part["id"], part["place"]
        sizes, seeds = np.unique(n, return_counts=True)
        lists = [members[(starts[n == m][:, None] + np.arange(m)).ravel()].tobytes() if 2 <= m <= max_occ else None for m in sizes]
        return pa.table({"n": pa.array(sizes, pa.int64()), "seeds": pa.array(seeds, pa.int64()), "rows": pa.array(lists, pa.binary())})

    # a row has all the bucket's seeds of n members
    seeds = table(one.select("_n", "_seq").mapInArrow(scan, "bucket int, rows binary").groupBy("bucket").applyInArrow(gather, "n bigint, seeds bigint, rows binary"), "seeds")
    drop(rows, spare)
    counts = seeds.groupBy("n").agg(F.sum("seeds").alias("seeds"))
    histogram = {r["n"]: r["seeds"] for r in counts.collect()}
    most = _cut(histogram, top, min_occ, max_occ)
    anchors = sum(n * (n - 1) // 2 * c for n, c in histogram.items() if n <= most)
    pair_buckets = max(BUCKETS, anchors // BLOCK)
    least = -(-min_score // k)  # each anchor adds k at most

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("rows")):
                members = np.frombuffer(blob.as_py(), MEMBER).reshape(-1, n)
                step = max(1, 2 * BLOCK // (n * n))
                for s in range(0, len(members), step):
                    yield _anchors(members[s : s + step])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(meetings(batches)):
            yield _dealt(part, (_pair_key(part) % np.uint64(pair_buckets)).astype(np.int32))

    def pair(t: pa.Table) -> pa.Table:
        part = _joined(t, ANCHOR)
        key = _pair_key(part)
        order = np.argsort(key)
        _, n = _runs(key[order])
        # pairs of too few anchors go before the rest is sorted
        part = part[order[np.repeat(n >= least, n)]]
        turned = part["at"] < 0
        at = np.where(turned, ~part["at"], part["at"])
        order = np.lexsort((at, turned, part["b"], part["a"]))
        a, b, turned, at = part["a"][order], part["b"][order], turned[order], at[order]
        starts, n = _runs(a, b, turned)
        fits = may_chain(np.repeat(np.arange(len(n)), n), at >> 32, (at & 0xFFFFFFFF) - (1 << 31), k, band, min_score)
        starts, n = starts[fits], n[fits]
        lists = [at[s : s + m].tobytes() for s, m in zip(starts, n)]
        return pa.table({"a": pa.array(a[starts], pa.int64()), "b": pa.array(b[starts], pa.int64()), "reverse": pa.array(turned[starts], pa.bool_()), "x": pa.array(lists, pa.binary())})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            packed = [np.frombuffer(v, np.int64) for v in pdf["x"]]
            best = best_chains([v >> 32 for v in packed], [(v & 0xFFFFFFFF) - (1 << 31) for v in packed], k, gap, band, back)
            score, n, sx, sy, ex, ey = best.T
            back_to = pdf["reverse"].to_numpy()
            out = pdf[["a", "b", "reverse"]].assign(score=score, anchors=n, a_start=sx, a_end=ex + k, b_start=np.where(back_to, -ey, sy), b_end=np.where(back_to, -sy, ey) + k)
            yield out[out["score"] >= min_score]

    ints = ("score", "anchors", "a_start", "a_end", "b_start", "b_end")
    met = seeds.where(F.col("n").between(2, most)).select("n", "rows").mapInArrow(meet, "bucket int, rows binary")
    met = met.groupBy("bucket").applyInArrow(pair, "a bigint, b bigint, reverse boolean, x binary")
    found = met.mapInPandas(chain, "a bigint, b bigint, reverse boolean, " + ", ".join(f"{c} bigint" for c in ints))
    if names is None:
        found = found.withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})
    else:
        for c in ("a", "b"):
            found = found.withColumnRenamed(c, "_n").join(names.withColumnRenamed("_id", c), "_n").drop("_n")
        found = found.select("a", "b", "reverse", *ints)
    return found.unionByName(copies.select("a", "b", F.lit(False).alias("reverse"), *[F.lit(None).cast("bigint").alias(c) for c in ints]))


def cut_off(counts: DataFrame, top: float, min_occ: int, max_occ: int) -> int:
    """The frequency that a fraction `top` of all rows of counts(n) passes, within min_occ and max_occ."""
    by_n = counts.groupBy(F.least("n", F.lit(max_occ)).alias("n")).agg(F.count("*").alias("seeds"))
    # at most max_occ rows
    return _cut({r["n"]: r["seeds"] for r in by_n.collect()}, top, min_occ, max_occ)


def _cut(histogram: dict[int, int], top: float, min_occ: int, max_occ: int) -> int:
    passed, cut = int(sum(histogram.values()) * top), max_occ
    for n, c in sorted(histogram.items(), reverse=True):
        cut = n
        passed -= c
        if passed < 0:
            break
    return max(min_occ, min(cut, max_occ))
