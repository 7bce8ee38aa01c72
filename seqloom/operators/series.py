"""Long-form series: clusters, chunks, scaling, steps and plateaus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import ship


def threshold_clusters(df: DataFrame, keys: list[str], index: str, value: str, threshold: float, distance: int, ignore_prefix: int = 0) -> DataFrame:
    """(keys, start, end, peak, top): values above the threshold, clustered while gaps are at most distance.

    peak is where the top is; of equal tops the last. Indexes under
    ignore_prefix take no part.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    high = df.where((F.col(value) > threshold) & (F.col(index) >= ignore_prefix))
    new = F.when(F.col(index) - F.lag(index).over(w) <= distance, 0).otherwise(1)
    marked = high.withColumn("_new", new).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_c").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end"), F.max_by(index, F.struct(value, index)).alias("peak"), F.max(value).alias("top")).drop("_c")


def split_at_spacers(reads: DataFrame, spacers: DataFrame, id_: str, length: str) -> DataFrame:
    """(id_, part, start, end): what lies between the spacers(id_, s_start, s_end) of each read; empty parts go."""
    from seqloom.functions.scalars import derived_uuid

    cuts = spacers.groupBy(id_).agg(F.sort_array(F.array_agg(F.struct("s_start", "s_end"))).alias("_s"))
    out = reads.join(cuts, id_, "left")
    edges = F.expr(f"transform(sequence(0, coalesce(size(_s), 0)), i -> struct(if(i = 0, 0, _s[i - 1].s_end) AS start, if(i = coalesce(size(_s), 0), {length}, _s[i].s_start) AS end))")
    out = out.withColumn("_e", F.filter(edges, lambda e: e["end"] > e["start"])).select(*reads.columns, F.posexplode("_e").alias("part", "_x")).select(*reads.columns, "part", F.col("_x.start").alias("start"), F.col("_x.end").alias("end"))
    return out.withColumn("part_id", derived_uuid(id_, "part"))


def top_regions(regions: DataFrame, keys: list[str], quality: str, peak: str, start: str, end: str, max_quality: float = 10, max_span: int = 500, k: int = 10) -> DataFrame:
    """The k highest of the regions with low quality and a short span."""
    ok = regions.where((F.col(quality) <= max_quality) & (F.col(end) - F.col(start) <= max_span))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(peak), start))).where(F.col("rank") <= k)


def chunk_offsets(df: DataFrame, length: str, size: int, overlap: int, stride: int = 1) -> DataFrame:
    """Adds chunk_start, chunk_end: chunks step by size - overlap; the last ends at the
    length rounded down to the stride and is shifted back to full size."""
    if size <= overlap or size % stride or overlap % stride:
        raise ValueError("the chunk must exceed the overlap and both be multiples of the stride")
    out = df.where(F.col(length) > 0).withColumn("_last", F.expr(f"greatest(0L, cast({length} - {size} AS bigint) div {stride} * {stride})"))
    starts = F.expr(f"array_distinct(array_append(sequence(0L, _last, {size - overlap}L), _last))")
    return out.withColumn("chunk_start", F.explode(starts)).withColumn("chunk_end", F.least(F.col("chunk_start") + size, F.col(length).cast("bigint"))).drop("_last")


def balanced_chunks(df: DataFrame, length: str, max_size: int, stride: int = 1) -> DataFrame:
    """Adds chunk_start, chunk_end: as few chunks as max_size allows, near equal, at strides."""
    out = df.where(F.col(length) > 0).withColumn("_n", F.expr(f"cast(ceil({length} / {max_size}) AS int)")).withColumn("_i", F.explode(F.expr("sequence(0, _n - 1)")))
    edge = lambda i: f"cast(if({i} = _n, {length}, (cast({length} AS bigint) * ({i}) div _n) div {stride} * {stride}) AS bigint)"
    return out.withColumns({"chunk_start": F.expr(edge("_i")), "chunk_end": F.expr(edge("_i + 1"))}).drop("_n", "_i")


def stitch_chunks(chunks: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """(key, text): chunks joined, each border at the middle of the neighbours' overlap."""
    w = Window.partitionBy(key).orderBy(start)
    c = chunks.withColumns({"_pe": F.lag(end).over(w), "_ns": F.lead(start).over(w)})
    a, b = f"if(_pe > {start}, ({start} + _pe) div 2, {start})", f"if(_ns < {end}, (_ns + {end}) div 2, {end})"
    c = c.withColumn("_p", F.expr(f"substr({text}, cast({a} - {start} AS int) + 1, cast({b} - {a} AS int))"))
    return c.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.array_agg(F.struct(start, "_p"))), lambda x: x["_p"]), "").alias(text))


def lower_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys, each of qs): the order statistic at floor(q (n - 1)), without interpolation.

    Values are counted first, so the sort is over distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    run = counted.withColumns({"_upto": F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    at = lambda q: F.floor(F.lit(q) * (F.col("_all") - 1)) + 1
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= at(q), F.col(value))).alias(n) for n, q in qs.items()])


def quantile_scaling(df: DataFrame, keys: list[str], value: str, qa: float = 0.2, qb: float = 0.9, shift: float = 0.51, scale: float = 0.53) -> DataFrame:
    """(keys, shift, scale): max(10, m (a + b)) and max(1, s (b - a)) of two lower quantiles."""
    q = lower_quantiles(df, keys, value, {"qa": qa, "qb": qb})
    return q.select(*keys, F.greatest(F.lit(10.0), shift * (F.col("qa") + F.col("qb"))).alias("shift"), F.greatest(F.lit(1.0), scale * (F.col("qb") - F.col("qa"))).alias("scale"))


def med_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, med, mad): lower median and 1.4826 times the lower median deviation (plus float epsilon)."""
    med = lower_quantiles(df, keys, value, {"med": 0.5})
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    return med.join(lower_quantiles(dev, keys, "_d", {"_mad": 0.5}), keys).select(*keys, "med", (F.col("_mad") * 1.4826 + 1.1920929e-07).alias("mad"))


def signal_start(df: DataFrame, keys: list[str], index: str, value: str, threshold: float, window: int = 40, min_above: int = 3, least: int = 10) -> DataFrame:
    """(keys, start): where the signal of each key begins, after a peak has ended.

    Whole windows are looked at from place `least` on. From the first with over min_above samples
    above the threshold, the first window that ends at or below it gives its end,
    but `least` if that is not before the number of samples less `least`. Without such windows
    it is `least` too. Places count from 0 without gaps.
    """
    wins = df.withColumn("_w", F.floor((F.col(index) - least) / window)).groupBy(*keys, "_w").agg(F.count_if(F.col(value) > threshold).alias("above"), F.max_by(value, index).alias("tail"), (F.max(index) + 1).alias("stop"), F.count("*").alias("n"))
    whole = (F.col("_w") >= 0) & (F.col("n") == window)
    lead = wins.groupBy(*keys).agg(F.max("stop").alias("_all"), F.min(F.when(whole & (F.col("above") > min_above), F.col("_w"))).alias("_f"))
    ended = wins.where(whole & (F.col("tail") <= threshold)).join(lead.where("_f IS NOT NULL"), keys).where("_w >= _f").groupBy(*keys).agg(F.min("stop").alias("_stop"))
    end = F.when(F.col("_stop") < F.col("_all") - least, F.col("_stop")).otherwise(least)
    return lead.join(ended, keys, "left").select(*keys, end.cast("bigint").alias("start"))


#: Fixed values of the search for a step: first place, median that counts as signal, rises with and without it.
STEP_FROM, STEP_LEVEL, STEP_RISE, STEP_RISE_ALONE = 1000, 700, 125, 150


def step_up(df: DataFrame, keys: list[str], index: str, value: str, window: int = 250, stride: int = 50, ring: int = 5, first: int = STEP_FROM, level: float = STEP_LEVEL, rise: float = STEP_RISE, rise_alone: float = STEP_RISE_ALONE) -> DataFrame:
    """(keys, at): start of the window at which the median has stepped up, 0 where none has.

    Windows begin every `stride` places from `first` on and before three quarters of the samples; the last
    may be shorter. Their lower medians of the last `ring` windows are looked at once more than `ring` have
    been seen: the greatest must stand after the least, and be over `level` and `rise`
    higher, or be over rise_alone higher. Of equal medians the one in the lowest slot of the ring is the least
    and the one in the highest slot the greatest.
    """
    size = df.groupBy(*keys).agg((F.max(index) + 1).alias("_all"))
    dealt = df.where(F.col(index) >= first).withColumn("_s", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(index) - first - window + 1) / F.lit(stride))), F.floor((F.col(index) - first) / stride))))
    meds = dealt.groupBy(*keys, "_s").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("med"))
    meds = meds.join(size, keys).where(F.col("_s") * stride + first < F.floor(F.col("_all") * 3 / 4))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(-(ring - 1), 0)
    slot = F.struct("med", (F.col("_s") % ring).alias("slot"), F.col("_s").alias("s"))
    seen = meds.withColumns({"low": F.min(slot).over(w), "high": F.max(slot).over(w)}).where(F.col("_s") >= ring)
    up = F.col("high.med") - F.col("low.med")
    hit = seen.where((F.col("high.s") > F.col("low.s")) & (((F.col("high.med") > level) & (up > rise)) | (up > rise_alone)))
    found = hit.groupBy(*keys).agg((F.min("_s") * stride + first).alias("_at"))
    return size.join(found, keys, "left").select(*keys, F.coalesce("_at", F.lit(0)).cast("bigint").alias("at"))


def plateaus(df: DataFrame, key: str, index: str, value: str, window: int = 25, max_sd: float = 0.3, low: float = -10.0, high: float = 10.0, gap: int = 50, samples_per_base: float = 1.0) -> DataFrame:
    """(key, start, end, bases): the longest flat stretch of each series, for tails of one base.

    Windows pass by mean and deviation in SQL; their runs are merged over gaps
    until nothing changes, which is a loop over one series' few runs.
    """
    w = Window.partitionBy(key).orderBy(index).rowsBetween(0, window - 1)
    stats = df.withColumns({"_m": F.avg(value).over(w), "_sd": F.stddev_pop(value).over(w), "_n": F.count("*").over(w)})
    flat = stats.where((F.col("_n") == window) & (F.col("_sd") <= max_sd) & F.col("_m").between(low, high))
    o = Window.partitionBy(key).orderBy(index)
    runs = flat.withColumn("_r", F.col(index) - F.row_number().over(o)).groupBy(key, "_r").agg(F.min(index).alias("start"), (F.max(index) + window).alias("end"))
    kind = runs.schema[key].dataType.simpleString()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = sorted(zip(pdf["start"].tolist(), pdf["end"].tolist(), strict=True))
        while True:
            out = []
            for s, e in spans:
                if out and s - out[-1][1] <= min(gap, (out[-1][1] - out[-1][0] + e - s) // 2):
                    out[-1] = (out[-1][0], max(e, out[-1][1]))
                else:
                    out.append((s, e))
            if out == spans:
                break
            spans = out
        s, e = max(spans, key=lambda x: (x[1] - x[0], -x[0]))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "start": [s], "end": [e]})

    ship(df.sparkSession)
    return runs.groupBy(key).applyInPandas(merged, f"{key} {kind}, start bigint, end bigint").withColumn("bases", F.round((F.col("end") - F.col("start")) / samples_per_base).cast("bigint"))


def min_pool(df: DataFrame, keys: list[str], index: str, value: str, reach: int = 2) -> DataFrame:
    """Adds pooled: the least value within `reach` places."""
    return df.withColumn("pooled", F.min(value).over(Window.partitionBy(*keys).orderBy(index).rowsBetween(-reach, reach)))
