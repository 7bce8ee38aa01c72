"""Interval joins by bins, islands, merged ranges and tiles.

Intervals are half-open unless a function says otherwise. A bare range join
plans as a nested loop; here both sides are dealt to fixed-width bins of their
group, so it is an equi-join with a residual condition. An interval longer than
WIDE bins would be copied too often: such are matched at a coarser bin width,
each width being its own equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import scans
from seqloom.session import drop, table

#: Bins an interval may span before it goes to the next coarser width.
WIDE = 64


def _binned(df: DataFrame, start: str, end: str, width: int, inclusive: bool) -> DataFrame:
    last = F.col(end) if inclusive else F.col(end) - 1
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), last) / width))))


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str], width: int, inclusive: bool = False, levels: int = 3, residual: Column | None = None) -> DataFrame:
    """Pairs of rows of a(keys, start, end, ...) and b(keys, b_start, b_end, ...) that overlap.

    Each pair comes once: it is reported in the bin where the later of the two
    starts lies. b is split by length over `levels` widths, each WIDE times the
    one before; the last takes all that are longer. inclusive: ends count as
    covered. Nulls in keys or bounds match nothing; empty intervals overlap
    nothing unless inclusive.
    """
    a = a.where("start IS NOT NULL AND end IS NOT NULL")
    b = b.where("b_start IS NOT NULL AND b_end IS NOT NULL")
    out = None
    for level in range(levels):
        w = width * WIDE**level
        span = F.col("b_end") - F.col("b_start")
        low, high = (F.lit(True) if level == 0 else span > width * WIDE**level), (F.lit(True) if level == levels - 1 else span <= width * WIDE ** (level + 1))
        left, right = _binned(a, "start", "end", w, inclusive), _binned(b.where(low & high), "b_start", "b_end", w, inclusive)
        for k in keys:
            right = right.withColumnRenamed(k, f"_b_{k}")
        on = (left["_bin"] == right["_bin"])
        for k in keys:
            on &= left[k] == right[f"_b_{k}"]
        hit = (F.col("start") <= F.col("b_end")) & (F.col("b_start") <= F.col("end")) if inclusive else (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & (F.col("start") < F.col("end")) & (F.col("b_start") < F.col("b_end"))
        met = left.join(right, on & hit & (left["_bin"] == F.floor(F.greatest("start", "b_start") / w)))
        if residual is not None:
            met = met.where(residual)
        met = met.drop("_bin", *[f"_b_{k}" for k in keys])
        out = met if out is None else out.unionByName(met)
    return out


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str], id_: str, width: int, inclusive: bool = False, stranded: bool = False) -> DataFrame:
    """(id_, hits) for every row of a; with `stranded` b's strand must be a's or `.`."""
    side = (F.col("strand") == F.col("b_strand")) | (F.col("b_strand") == ".") if stranded else None
    hits = overlap_pairs(a, b, keys, width, inclusive, residual=side).groupBy(id_).agg(F.count("*").alias("hits"))
    return a.select(id_).join(hits, id_, "left").select(id_, F.coalesce("hits", F.lit(0)).alias("hits"))


def inside(a: DataFrame, b: DataFrame, keys: list[str], id_: str, width: int, shrink: int = 0, negate: bool = False) -> DataFrame:
    """Rows of a within (or, negated, meeting none of) the intervals of b shrunk by `shrink` at both sides.

    Within means that one interval holds the row wholly. Rows of a whose keys b
    doesn't have are dropped either way.
    """
    known = b.select(*keys).distinct()
    a = a.join(known, keys, "left_semi")
    b = b.withColumns({"b_start": F.col("b_start") + shrink, "b_end": F.col("b_end") - shrink})
    whole = None if negate else (F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end"))
    ids = overlap_pairs(a, b, keys, width, residual=whole).select(id_).distinct()
    return a.join(ids, id_, "left_anti" if negate else "left_semi")


def _opened(marked: DataFrame, keys: list[str], order: list[str], name: str, width: int) -> DataFrame:
    """Adds `name`: how many rows up to this one have _old = 0; of rows in one place those come first."""
    counted = scans.before(marked, keys, [*order, "_old"], {"_seen": ("sum", 1 - F.col("_old"))}, width)
    return counted.withColumn(name, F.coalesce("_seen", F.lit(0)) + 1 - F.col("_old")).drop("_seen", "_old")


def merge_ranges(df: DataFrame, keys: list[str], distance: int = 0, width: int = scans.TILE) -> DataFrame:
    """(keys, start, end, n): ranges joined while the next starts within `distance` of the last end."""
    order = ["start", "end"]
    marked = scans.before(df.select(*keys, *order), keys, order, {"_so_far": ("max", F.col("end"))}, width)
    marked = marked.withColumn("_old", F.when(F.col("start") <= F.col("_so_far") + distance, 1).otherwise(0)).drop("_so_far")
    island = _opened(marked, keys, order, "_island", width)
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = scans.TILE) -> DataFrame:
    """(keys, run, first, last, value, n): islands of equal values along `order`; nulls equal each other."""
    rows = df.select(*dict.fromkeys([*keys, *order, value]))
    marked = scans.before(rows, keys, order, {"_prev": ("last", F.struct(F.col(value).alias("v")))}, width)
    same = F.col("_prev").isNotNull() & F.col(value).eqNullSafe(F.col("_prev.v"))
    marked = _opened(marked.withColumn("_old", same.cast("int")).drop("_prev"), keys, order, "run", width)
    return marked.groupBy(*keys, "run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.first(value).alias(value), F.count("*").alias("n"))


def split_on_gap(df: DataFrame, keys: list[str], position: str, gap: int = 1, width: int = scans.TILE) -> DataFrame:
    """Adds `part`: a new one begins where position rises by more than gap."""
    marked = scans.before(df, keys, [position], {"_prev": ("last", F.col(position))}, width)
    marked = marked.withColumn("_old", F.coalesce(F.col(position) - F.col("_prev") <= gap, F.lit(False)).cast("int")).drop("_prev")
    return _opened(marked, keys, [position], "part", width)


def tiles(df: DataFrame, length: str, size: int, overlap: int) -> DataFrame:
    """Adds tile_start, tile_end, start_no_overlap, end_no_overlap for windows over [0, length).

    Windows step by size - overlap; neighbours share their overlap half and
    half; the last ends at length. Rejects an overlap of half a window or more.
    """
    if overlap * 2 >= size:
        raise ValueError("the overlap must be less than half a window")
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.col(length) - overlap) / F.lit(step))).cast("int")
    out = df.where(F.col(length) > 0).withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("_i").cast("bigint") * step
    out = out.withColumns({"tile_start": start, "tile_end": F.least(start + size, F.col(length).cast("bigint"))})
    half = overlap // 2
    return out.withColumns({
        "start_no_overlap": F.when(F.col("_i") == 0, F.lit(0).cast("bigint")).otherwise(F.col("tile_start") + half),
        "end_no_overlap": F.when(F.col("_i") == F.col("_n") - 1, F.col("tile_end")).otherwise(F.col("tile_start") + step + half),
    }).drop("_n", "_i")


def equal_windows(df: DataFrame, length: str, size: int, step: int) -> DataFrame:
    """Adds win_start, win_end: windows of one size, the last shifted back to end at length."""
    out = df.where(F.col(length) > 0).withColumn("_last", F.greatest(F.lit(0), F.col(length) - size).cast("bigint"))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), F.col("_last"), F.lit(step).cast("bigint")), F.array("_last")))
    return out.withColumn("win_start", F.explode(starts)).withColumn("win_end", F.least(F.col("win_start") + size, F.col(length).cast("bigint"))).drop("_last")


def region_violations(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, start, end, reason) of regions(name, start, end) against contigs(name, length).

    An open end is null: it stands for 0 or the contig's length.
    """
    known = regions.join(contigs.select("name", "length"), "name", "left").withColumns({"start": F.coalesce("start", F.lit(0)), "end": F.coalesce("end", "length")})
    before = F.max("end").over(Window.partitionBy("name").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(F.col("length").isNull(), "unknown contig").when((F.col("start") < 0) | (F.col("end") > F.col("length")) | (F.col("start") >= F.col("end")), "out of bounds").when(F.col("start") < before, "overlaps another")
    return known.withColumn("reason", reason).where("reason IS NOT NULL").select("name", "start", "end", "reason")


def batches(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Adds `batch`: blocks of about `limit` of running size within keys.

    Blocks follow the running total and not the greedy rule, which
    greedy_batches() has; a block exceeds the limit by less than one row.
    """
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("batch", F.floor(F.coalesce(before, F.lit(0)) / limit).cast("bigint"))


def greedy_batches(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int, width: int = scans.TILE) -> DataFrame:
    """Adds `batch`, from 0: rows are taken in order until their sizes come to `limit` or more, then a new one begins.

    Each row points to the row that would open the next batch if it opened one: the first
    before which the total is `limit` more. Which rows are opened is found by
    following pointers from the first row of a key, all that are known at once and
    twice as far each time, so the rounds are the logarithm of the number of batches. Sizes must be
    0 or more, `limit` over 0, and order total; a null size counts as 0.
    """
    if limit <= 0:
        raise ValueError("the limit of a batch must be over 0")
    amount = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    rows = scans.before(df, keys, order, {"_at": ("sum", amount), "_no": ("sum", F.lit(1))}, width)
    rows = table(rows.withColumns({"_at": F.coalesce("_at", F.lit(0)).cast("bigint"), "_no": F.coalesce("_no", F.lit(0)).cast("bigint")}), "batch-rows")
    # by falling totals: a row that asks for a total meets the last row that has it or more; of equal totals the first row
    stands = rows.select(*keys, (-F.col("_at")).alias("_v"), F.lit(0).alias("_asks"), (-F.col("_no")).alias("_o"), F.col("_no").alias("_row"))
    asks = rows.select(*keys, (-(F.col("_at") + limit)).alias("_v"), F.lit(1).alias("_asks"), (-F.col("_no")).alias("_o"), F.col("_no").alias("_row"))
    met = scans.before(stands.unionByName(asks), keys, ["_v", "_asks", "_o"], {"_to": ("last", F.when(F.col("_asks") == 0, F.col("_row")))}, max(width, limit))
    jumps = table(met.where("_asks = 1 AND _to IS NOT NULL").select(*keys, "_row", "_to"), "jumps")
    opened = table(rows.where("_no = 0").select(*keys, "_no"), "opened")
    known = opened.count()
    while True:
        ahead = opened.withColumnRenamed("_no", "_row").join(jumps, [*keys, "_row"]).select(*keys, F.col("_to").alias("_no"))
        grown = table(opened.unionByName(ahead).distinct(), "opened")
        now = grown.count()
        drop(opened)
        opened = grown
        if now == known:
            break
        known = now
        further = jumps.select(*keys, F.col("_row").alias("_to"), F.col("_to").alias("_then"))
        longer = table(jumps.join(further, [*keys, "_to"]).select(*keys, "_row", F.col("_then").alias("_to")), "jumps")
        drop(jumps)
        jumps = longer
    marked = rows.join(opened.withColumn("_opens", F.lit(1)), [*keys, "_no"], "left")
    counted = scans.before(marked, keys, order, {"_before": ("sum", F.coalesce("_opens", F.lit(0)))}, width)
    return counted.withColumn("batch", (F.coalesce("_before", F.lit(0)) + F.coalesce("_opens", F.lit(0)) - 1).cast("bigint")).drop("_at", "_no", "_opens", "_before")


def even_parts(df: DataFrame, items: str, parts: int) -> DataFrame:
    """Adds part, start, end: `items` things dealt to that many parts, the first ones of one more; parts of none are left out."""
    each = F.expr(f"{items} div {parts}")
    more = F.expr(f"{items} % {parts}")
    out = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    start = F.col("part") * each + F.least("part", more)
    end = start + each + (F.col("part") < more).cast("int")
    return out.withColumns({"start": start.cast("bigint"), "end": end.cast("bigint")}).where("start < end")
