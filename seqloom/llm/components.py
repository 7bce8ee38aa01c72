"""Connected components as DataFrame joins, for graphs that grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import drop, table

MAX_ROUNDS = 60


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with a > b."""
    return pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of u are linked to the least of them and u.

    The least neighbour comes from an aggregation and a join, not from a
    window, so a node with very many neighbours stays splittable.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("k"))
    if large:
        return _edges(met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
    return _edges(met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of pairs(a, b); component is its least node.

    Alternates large-star and small-star contraction until the edges stop
    changing; each round is a written table. Null ends and self loops are
    ignored, repeated pairs count once, no pairs give no rows.
    """
    now = table(_edges(pairs), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, last = mark, now
        now = table(_star(_star(now, True), False), "edges")
        drop(last)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
