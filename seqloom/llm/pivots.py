"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the reference points (pivots) nearest to it, in order of
nearness. It stands in the inverted lists of the first LISTS of them. Two
vectors of a list are candidates when they share SHARED of their first PREFIX
pivots, and a candidate is verified by its cosine in double precision. A pair that
meets in several lists counts in one: that of the least pivots that both are
listed under.

Equal vectors are one entry with a number of copies. A list with many entries is
dealt out as pairs of blocks, so that no task holds a whole list, and nothing
is capped. Tasks hand on numbers of links and a spanning forest, never the pairs.

Lists are named by one pivot at every size of the input, so a pair that is found among few
vectors is sought the same way among many. Pivots are spread out over a bounded
sample by taking the farthest next; every vector is indexed whatever the sample holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.session import drop, ship, table

#: Lists a vector stands in, pivots of its prefix, and those that two candidates share.
LISTS, PREFIX, SHARED = 3, 8, 3
#: Pivots, at least and at most; between, about the square root of the entries.
PIVOTS = (64, 4096)
#: Entries of a block of a long list, at most; no result depends on it.
LONG_LIST = 32768
#: The sample that pivots are taken from: rows a pivot, and bytes in all.
SAMPLE_ROWS, SAMPLE_BYTES = 4, 64_000_000
#: Lengths of vector that get pivots of their own, most frequent first; others have one list a label.
LENGTHS = 4
TILE = 1024


def farthest(rows: np.ndarray, count: int) -> np.ndarray:
    """`count` of the unit rows, or all: each the one whose nearest taken row is farthest away, the first row first."""
    taken = [0]
    nearest = rows @ rows[0]
    while len(taken) < min(count, len(rows)):
        nxt = int(np.argmin(nearest))
        if nearest[nxt] > 1 - 1e-9:
            break
        taken.append(nxt)
        nearest = np.maximum(nearest, rows @ rows[nxt])
    return rows[taken]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares don't overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def prefixes(rows: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each unit row, nearest first, equal ones by number."""
    near = rows @ pivots.T
    if near.shape[1] <= k:
        return np.argsort(-near, axis=1, kind="stable").astype(np.int32)
    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


class Index:
    """Pivots of one length of vector."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots

    def describe(self, rows: np.ndarray):
        """(listed pivots, their lists, mask of the prefix) of each row.

        Listed pivots ascend. A list is named by its pivot. The mask has a bit for each pivot of the prefix; of more than 128
        pivots some share a bit, which only adds candidates.
        """
        near = prefixes(unit(rows), self.pivots, PREFIX)
        listed = np.sort(near[:, :LISTS], axis=1)
        lists = listed.astype(np.int64)
        mask = np.zeros((len(rows), 2), np.uint64)
        for c in range(near.shape[1]):
            bit = near[:, c] % 128
            np.bitwise_or.at(mask, (np.arange(len(rows)), bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        return listed, lists, mask


def fit(classes: DataFrame) -> dict[int, Index]:
    """An index for each of the most frequent lengths of classes(vec, d1)."""
    out = {}
    lengths = classes.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    for dim, n in lengths:
        count = min(max(1 << (int(n**0.5) - 1).bit_length(), PIVOTS[0]), PIVOTS[1])
        rows = min(SAMPLE_ROWS * count, max(SAMPLE_BYTES // (8 * dim), 64))
        # the digest is a hash of the vector, so its order draws at random and alike every time
        sample = classes.where(F.size("vec") == dim).orderBy("d1", "d2").limit(rows).select("vec").collect()
        pivots = farthest(unit(np.array([r.vec for r in sample], np.float64)), count)
        out[dim] = Index(pivots)
    return out


def _listed(classes: DataFrame, index: dict[int, Index], narrow: bool) -> DataFrame:
    """classes with `listed`, `lists` and `mask`; narrow: only the label, the digest and the lists."""
    kept = ["label", "d1"] if narrow else [c for c in classes.columns]

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            sizes = pc.list_value_length(vec).to_numpy()
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            listed = [np.full(1, -1, np.int32)] * len(sizes)
            lists = [np.full(1, -1, np.int64)] * len(sizes)
            mask = np.full((len(sizes), 2), np.uint64(2**64 - 1))
            for dim, ix in index.items():
                who = np.flatnonzero(sizes == dim)
                for at in range(0, len(who), 2048):
                    w = who[at : at + 2048]
                    a, b, m = ix.describe(flat[(ends[w] - dim)[:, None] + np.arange(dim)])
                    mask[w] = m
                    for i, x, y in zip(w.tolist(), a, b, strict=True):
                        listed[i], lists[i] = x, y
            found = [pa.array(lists, pa.list_(pa.int64()))]
            if not narrow:
                found += [pa.array(listed, pa.list_(pa.int32())), pa.array(list(mask.view(np.int64)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], [*kept, "lists", *([] if narrow else ["listed", "mask"])])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema if f.name in kept) + ", lists array<bigint>" + ("" if narrow else ", listed array<int>, mask array<bigint>")
    return classes.mapInArrow(run, schema)


def _union(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in owner, which points to the least member of each set."""
    while True:
        ra, rb = owner[a], owner[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(owner, np.maximum(ra, rb), np.minimum(ra, rb))
        while (owner[owner] != owner).any():
            owner[:] = owner[owner]


class List:
    """Entries of one list, or of two blocks of it, ordered by representative."""

    def __init__(self, rep, copies, vec, listed, mask, top):
        self.rep, self.copies, self.vec, self.listed, self.mask = rep, copies, vec, listed, mask
        self.norm = np.sqrt((vec * vec).sum(axis=1))
        self.top = top

    def _first_list(self, a, b) -> np.ndarray:
        """Whether this list is the least that entries a and b (of equal shape) are both in."""
        if self.top < 0:
            return np.ones(a.shape, bool)
        n = np.zeros(a.shape, np.int8)
        for i in range(self.listed.shape[1]):
            x = self.listed[a, i]
            for j in range(self.listed.shape[1]):
                n += (x == self.listed[b, j]) & (x <= self.top)
        return n == 1

    def links(self, side: np.ndarray | None, least: float):
        """(links of each entry with copies counted, owner of each entry) by verified candidates.

        side: of which of two blocks an entry is; only entries of both sides meet. None: all meet.
        """
        n = len(self.rep)
        linked, owner = np.zeros(n, np.int64), np.arange(n)
        left, right = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for s in range(0, len(left), TILE):
            a = left[s : s + TILE]
            for t in range(s if side is None else 0, len(right), TILE):
                b = right[t : t + TILE]
                shared = np.bitwise_count(self.mask[a, 0][:, None] & self.mask[b, 0]) + np.bitwise_count(self.mask[a, 1][:, None] & self.mask[b, 1])
                near = shared >= min(SHARED, int(shared.max(initial=0)) or SHARED)
                if side is None and s == t:
                    near &= np.arange(len(a))[:, None] < np.arange(len(b))
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                if len(i) * 16 > near.size:
                    cos = (self.vec[a] @ self.vec[b].T)[i, j]
                    hit = cos / (self.norm[a[i]] * self.norm[b[j]]) >= least
                    i, j = i[hit], j[hit]
                    own = self._first_list(a[i], b[j])
                    i, j = a[i[own]], b[j[own]]
                else:
                    i, j = a[i], b[j]
                    own = self._first_list(i, j)
                    i, j = i[own], j[own]
                    hit = np.zeros(len(i), bool)
                    for at in range(0, len(i), 8192):
                        x, y = i[at : at + 8192], j[at : at + 8192]
                        hit[at : at + 8192] = np.einsum("ij,ij->i", self.vec[x], self.vec[y]) / (self.norm[x] * self.norm[y]) >= least
                    i, j = i[hit], j[hit]
                linked += np.bincount(i, self.copies[j], n).astype(np.int64) + np.bincount(j, self.copies[i], n).astype(np.int64)
                _union(owner, i, j)
        return linked, owner


def links(classes: DataFrame, index: dict[int, Index], least: float, block_rows: int = 512) -> DataFrame:
    """(d1, d2, linked, a, b): for entries with links in a list, how many, and an edge of the forest.

    classes: (label, d1, d2, rep, copies, vec), one row for each entry. Lists of
    over block_rows entries are dealt in blocks, of block_rows or, if more, 32 times the root
    of the list's length.
    """
    sizes = _listed(classes, index, narrow=True).select("label", F.size("lists").alias("of"), F.explode("lists").alias("list"))
    hot = table(sizes.groupBy("label", "list").count().where(F.col("count") > block_rows).select(F.col("label").alias("_label"), F.col("list").alias("_list"), F.expr(f"cast(ceil(count / greatest({block_rows}, least(32 * sqrt(count), {LONG_LIST}))) as int)").alias("parts")), "hot")
    # few lists are hot; were they many, the join would shuffle
    met = F.broadcast(hot) if hot.count() <= 100_000 else hot
    dealt = _listed(classes, index, narrow=False).withColumn("list", F.explode("lists")).drop("lists")
    dealt = dealt.join(met, F.col("label").eqNullSafe(F.col("_label")) & (F.col("list") == F.col("_list")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod("d2", F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.concat_ws("|", F.size("vec"), "list", F.least("own", "other"), F.greatest("own", "other"), "label").alias("shard"), "list", F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "d1", "d2", "rep", "copies", "vec", "listed", "mask")

    def matrix(column, kind):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype(kind, copy=False)

    def linked(part: pa.Table):
        part = part.combine_chunks()
        get = lambda c: part.column(c).combine_chunks()
        rep, d1, d2 = (get(c).to_numpy() for c in ("rep", "d1", "d2"))
        order = np.lexsort((d2, d1, rep))
        name = get("list")[0].as_py()
        side = get("side").to_numpy()[order]
        entries = List(rep[order], get("copies").to_numpy()[order], matrix(get("vec"), np.float64)[order], matrix(get("listed"), np.int32)[order], matrix(get("mask"), np.int64).view(np.uint64)[order], name)
        # a list in one block meets itself, two blocks only each other
        n, owner = entries.links(None if (side == -1).all() else side, least)
        got = np.flatnonzero(n)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[order][got], d2[order][got], n[got], entries.rep[got], entries.rep[owner[got]])], ["d1", "d2", "linked", "a", "b"])

    def shards(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")
            if held and held[-1].column("shard")[-1].as_py() != shard[0].as_py():
                yield from linked(pa.Table.from_batches(held))
                held = []
            cuts = np.flatnonzero(pc.not_equal(shard.slice(1), shard.slice(0, len(shard) - 1)).to_numpy(zero_copy_only=False)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                held.append(batch.slice(s, e - s))
                if e < len(shard):
                    if sum(b.num_rows for b in held) > 1:
                        yield from linked(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from linked(pa.Table.from_batches(held))

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(shards, "d1 bigint, d2 bigint, linked bigint, a bigint, b bigint")


def near_vectors(vectors: DataFrame, least: float = 0.98, block_rows: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of vectors(vec_id, embedding, label).

    Rows link when their labels are equal, their lengths are equal and the cosine of
    their embeddings, in double precision, is `least` or more. n_links counts the
    rows linked directly, copies of the row's own vector too; component_id is the
    least vec_id reachable. Rows with a null vec_id, label, embedding or component, a
    component that is not finite, or only zeros link with nothing; component_id is
    their own vec_id. A vec_id names one vector; rows of one id with different vectors
    have the links of their own vector, and meet in a component where that id
    leads their copies. An empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    kind = dict(vectors.dtypes)["embedding"]
    sound = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.expr(f"cast(transform(embedding, x -> IF(x = 0, 0, x)) as {kind})").alias("vec"), F.coalesce(F.expr(sound), F.lit(False)).alias("sound"))
    rows = rows.withColumn("d1", F.when(F.col("sound"), F.xxhash64(F.lit(1), "label", "vec"))).withColumn("d2", F.when(F.col("sound"), F.xxhash64(F.lit(2), "vec", "label")))
    classes = table(rows.where("sound").groupBy("label", "d1", "d2", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    found = table(links(classes, fit(classes), least, block_rows), "links")
    joined = components(found.select("a", "b"))
    by_class = found.groupBy(F.col("d1").alias("f1"), F.col("d2").alias("f2")).agg(F.sum("linked").alias("linked"))
    named = classes.select("d1", "d2", "rep", "copies").join(by_class, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2")), "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = table(named.select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("first")), "classes")
    drop(classes, found)
    out = rows.select("vec_id", "d1", "d2").join(named, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))


def op11_pivot_links(spark, sf_dir) -> DataFrame:
    """The contract's query: links of all embeddings at cosine 0.98."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.node = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""
