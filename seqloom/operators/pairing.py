"""Neighbours along a channel and pairs of reads that followed one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a pair in milliseconds, bases and quality.
MAX_GAP_MS, MIN_LENGTH, MIN_QUALITY = 10_000, 500, 8
EARLY_GAP_MS, EARLY_RATIO, EARLY_LENGTH = 100, 0.98, 5_000


def neighbours(reads: DataFrame, keys: list[str], order: list[str], id_: str) -> DataFrame:
    """Adds prev_read and next_read along `order` within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return reads.withColumns({"prev_read": F.lag(id_).over(w), "next_read": F.lead(id_).over(w)})


def adjacent_pairs(reads: DataFrame, keys: list[str], start: str, end: str, id_: str, length: str, quality: str | None = None, max_gap: int = MAX_GAP_MS, min_length: float = MIN_LENGTH, early_gap: int = EARLY_GAP_MS, early_ratio: float = EARLY_RATIO, early_length: float = EARLY_LENGTH) -> DataFrame:
    """(keys, template, complement, gap, ratio, early) of reads and their successors in keys.

    A pair needs 0 <= gap < max_gap between one's end and the next's start and
    enough bases (and quality) on both. early: accepted without a look at the
    overlap. Ties of start go by id. A read may pair on both sides.
    """
    w = Window.partitionBy(*keys).orderBy(start, id_)
    cols = {"_id": F.lead(id_).over(w), "_start": F.lead(start).over(w), "_length": F.lead(length).over(w)}
    if quality:
        cols["_quality"] = F.lead(quality).over(w)
    out = reads.withColumns(cols).where("_id IS NOT NULL").withColumn("gap", F.col("_start") - F.col(end))
    ok = (F.col("gap") >= 0) & (F.col("gap") < max_gap) & (F.least(length, "_length") >= min_length)
    if quality:
        ok &= F.least(quality, "_quality") >= MIN_QUALITY
    ratio = F.try_divide(F.least(length, "_length"), F.greatest(length, "_length"))
    out = out.where(ok).withColumn("ratio", ratio)
    early = (F.col("gap") <= early_gap) & (F.col("ratio") >= early_ratio) & (F.least(length, "_length") >= early_length)
    return out.select(*keys, F.col(id_).alias("template"), F.col("_id").alias("complement"), "gap", "ratio", F.coalesce(early, F.lit(False)).alias("early"))


def adjacency_holds(template: str = "template", complement: str = "complement"):
    """Whether recorded neighbours join two read structs (id, parent, prev_read, next_read).

    One of the two links suffices, as splitting mends only the split read's own;
    of two reads split from different parents both links name the parents.
    """
    t, c = template, complement
    return F.expr(f"coalesce({t}.id = {c}.prev_read, false) OR coalesce({t}.next_read = {c}.id, false) OR coalesce({t}.parent = {c}.prev_read AND {t}.next_read = {c}.parent, false)")


def accept_by_overlap(pairs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Early pairs, and others whose overlap is confident, reverse, long and anchored.

    overlaps: template, complement, mapq, reverse, t_start, t_end, t_len,
    c_start, c_end, c_len. It must cover over 0.8 of one read and over 50 bases,
    and lie within 500 bases of the template's end and the complement's start.
    The cheap half never waits for the join.
    """
    early = pairs.where("early")
    rest = pairs.where("NOT early").join(overlaps, ["template", "complement"])
    share = F.greatest(F.try_divide(F.col("t_end") - F.col("t_start"), F.col("t_len")), F.try_divide(F.col("c_end") - F.col("c_start"), F.col("c_len")))
    anchored = F.col("c_start") + F.col("t_len") - F.col("t_end") <= 500
    long_ = F.least(F.col("t_end") - F.col("t_start"), F.col("c_end") - F.col("c_start")) > 50
    rest = rest.where((F.col("mapq") >= 50) & F.col("reverse") & (share > 0.8) & anchored & long_)
    return early.unionByName(rest.select(*early.columns))
