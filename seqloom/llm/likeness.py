"""Near duplicates: SimHash candidates, then the exact Jaccard likeness of word shingles.

First the BK-trees of simhash.py propose pairs of near fingerprints, which joins
most groups by as many pairs as they have members. What a fingerprint can't tell
comes from a prefix filter, which loses no pair: with all shingles in one fixed
order, two sets of likeness t or more share one among the first n - ceil(t n) + 1
of each. Every candidate of either kind is checked on the whole sets before it
links. The order puts shingles that a sample shows to be common last; it decides
how many candidates there are and never which pairs are found.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.llm.simhash import _lanes, links, majority, sampled_keys, shingle_hashes
from seqloom.session import drop, ship, table

#: Documents that common shingles are learned from: 1 in 16, or about so many.
SAMPLE = 4096
#: Common shingles known to the workers, the most frequent ones.
COMMON = 200_000
#: Rounds in which a shared shingle offers only pairs with one leader.
LEADERS = 1
#: SimHash: 64-bit lanes of a fingerprint, radius in bits, draws of bits that key shards and bits a draw.
LANES, RADIUS, TABLES, DRAWN_BITS = 2, 24, 10, 16


def shingles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles array<bigint>): distinct shingles of each text, ascending."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shingles": [np.unique(shingle_hashes(x or b"", k)).view(np.int64) for x in pdf["data"]]})

    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, shingles array<bigint>")


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least three sampled documents, ascending, and their counts."""
    one_in = max(1, min(16, docs.count() // SAMPLE))
    drawn = shingles(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0), k)
    often = drawn.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    found = often.orderBy(F.desc("n"), "s").limit(COMMON).toPandas().sort_values("s")
    return found["s"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefixes(docs: DataFrame, k: int, least: float) -> DataFrame:
    """(doc_id, sig, fp, n, keys): a digest of the set of shingles, its SimHash, size and prefix."""
    often, counts = common_shingles(docs, k)

    def one(data: bytes):
        distinct = np.unique(shingle_hashes(data, k))
        s, n = distinct.view(np.int64), len(distinct)
        sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        rank = np.zeros(n, np.int64)
        if len(often) and n:
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            rank = np.where(often[at] == s, counts[at], 0)
        take = n - math.ceil(least * n - 1e-9) + 1 if n else 0
        return sig, majority(distinct, LANES), n, s[np.lexsort((s, rank))[:take]]

    def run(batches):
        for pdf in batches:
            rows = [one(x or b"") for x in pdf["data"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("sig", "fp", "n", "keys"))}})

    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, sig binary, fp binary, n int, keys array<bigint>")


def simhash_pairs(same: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of same(id, fp, n) that the BK-trees find near and whose sizes allow `least`.

    Texts of one fingerprint hang on the least id of it.
    """
    least_id = same.groupBy("fp").agg(F.min("id").alias("id"))
    nodes = least_id.select("id", _lanes(LANES).alias("lanes"))
    near = links(nodes, sampled_keys(LANES, TABLES, DRAWN_BITS), RADIUS, stars=False)
    equal = same.join(least_id.select(F.col("fp").alias("_fp"), F.col("id").alias("b")), F.col("fp") == F.col("_fp")).where("id > b").select(F.col("id").alias("a"), "b")
    sizes = lambda side: same.select(F.col("id").alias(side), F.col("n").alias(f"_{side}"))
    pairs = near.unionByName(equal).distinct().join(sizes("a"), "a").join(sizes("b"), "b")
    return pairs.where(F.least("_a", "_b") >= least * F.greatest("_a", "_b") - 1e-6).select("a", "b")


def _passes(least: float) -> str:
    """What x and y of a true pair meet at their first common shingle: sizes and places."""
    return f"least(x.n, y.n) >= {least}D * greatest(x.n, y.n) - 1e-6D AND least(x.n - x.pos, y.n - y.pos) >= {least / (1 + least)!r}D * (x.n + y.n) - 1e-6D"


def _able(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """The pairs whose prefixes share enough for the whole sets to be alike.

    What two sets share outside both prefixes lies past the end of one prefix,
    in at most ceil(least n) - 1 shingles of that set. So no true pair goes.
    """
    one = members.select(F.col("id").alias("a"), "key", F.col("n").alias("_x"))
    two = members.select(F.col("id").alias("b"), "key", F.col("n").alias("_y"))
    met = pairs.join(one, "a").join(two, ["b", "key"]).groupBy("a", "b", "_x", "_y").agg(F.count("*").alias("_both"))
    return met.where(f"_both + ceil({least}D * greatest(_x, _y) - 1e-9D) - 1 >= {least / (1 + least)!r}D * (_x + _y) - 1e-6D").select("a", "b").distinct()


def _checked(pairs: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """A written table of the pairs (a, b) whose whole sets are alike by `least` or more."""
    pairs = table(pairs, "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    sets = table(shingles(docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi"), k), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    found = table(both.where(F.col("_both") >= least * (F.size("_a") + F.size("_b") - F.col("_both")) - 1e-6).select("a", "b"), "linked")
    drop(pairs, sets)
    return found


def near_components(docs: DataFrame, k: int, least: float) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text) that has a doc_id.

    Rows link when the Jaccard likeness of their distinct k-word shingles is
    `least` or more; component_id is the least doc_id reachable. Texts without
    words are alike. SimHash pairs come first. Then a shared shingle offers
    pairs with one leader only, so a large group joins by as many pairs as it
    has members; then every pair that is still apart is checked.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = table(prefixes(docs, k, least), "prefixes")
    same = table(sets.groupBy("sig").agg(F.min(F.struct("doc_id", "fp", "n")).alias("x")).select("sig", F.col("x.doc_id").alias("id"), F.col("x.fp").alias("fp"), F.col("x.n").alias("n")), "same")
    found = _checked(simhash_pairs(same, least), docs, k, least)
    heads = sets.join(same, (sets["sig"] == same["sig"]) & (sets["doc_id"] == same["id"])).select("id", sets["n"], F.posexplode("keys").alias("pos", "key"))
    shared = heads.groupBy("key").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select("key")
    members = table(heads.join(shared, "key"), "members")
    texts = docs.join(members.select(F.col("id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    linked = found
    for turn in range(LEADERS + 1):
        joined = table(components(linked), "joined")
        apart = members.join(joined, members["id"] == joined["node"], "left").select("id", "n", "pos", "key", F.coalesce("component", "id").alias("comp"))
        # shingles all of whose documents are joined already have nothing to offer
        split = apart.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min_by(F.struct("id", "n", "pos", "comp"), F.struct(F.xxhash64("comp", F.lit(turn)), "id")).alias("lead")).where("_lo < _hi")
        if turn < LEADERS:
            y = split.select(F.col("key").alias("_key"), "lead.*")
        else:
            apart = table(apart.join(split.select("key"), "key"), "apart")
            y = apart.withColumnRenamed("key", "_key")
        met = apart.alias("x").join(y.alias("y"), F.expr(f"x.key = y._key AND x.comp <> y.comp AND {'true' if turn < LEADERS else 'x.id < y.id'} AND {_passes(least)}"))
        pairs = met.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()
        found = _checked(_able(pairs, members, least), texts, k, least)
        drop(joined, apart)
        linked = linked.unionByName(found)
    drop(members)
    joined = components(linked)
    named = same.join(joined, same["id"] == joined["node"], "left").select(same["sig"], F.coalesce("component", "id").alias("component_id"))
    return sets.select("doc_id", "sig").join(named, "sig").select("doc_id", "component_id")
