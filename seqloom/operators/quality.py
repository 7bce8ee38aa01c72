"""Distributions, rates, histories and comparisons of result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("_all")).alias("share"))


def classified_rate(df: DataFrame, key: str) -> DataFrame:
    return df.agg((1 - F.try_divide(F.count_if(F.col(key) == "unclassified"), F.count("*"))).alias("classified"))


def duplex_rate(df: DataFrame) -> DataFrame:
    """One row from bases(kind, bases, filtered): twice the duplex share of simplex bases, in percent."""
    took = lambda k: F.sum(F.when(F.col("kind") == k, F.col("bases") - F.col("filtered")))
    return df.agg((F.try_divide(took("duplex") * 2, took("simplex")) * 100).alias("duplex_rate"))


def tail_summary(df: DataFrame, length: str, longest: int) -> DataFrame:
    """One row: called (0 < n < longest), not called, mean and modal length."""
    ok = (F.col(length) > 0) & (F.col(length) < longest)
    return df.agg(F.count_if(ok).alias("called"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("not_called"), F.avg(F.when(ok, F.col(length))).alias("mean_length"), F.mode(F.when(ok, F.col(length)), deterministic=True).alias("modal_length"))


def quantiles_and_fit(df: DataFrame, keys: list[str], y: str, x: str, qs: list[float]) -> DataFrame:
    """(keys, quantiles of y by linear interpolation, slope, intercept, r)."""
    return df.groupBy(*keys).agg(*[F.percentile(y, q).alias(f"q{round(q * 100)}") for q in qs], F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def history(df: DataFrame, keys: list[str], date: str, since: str, value: str, outlier: float) -> DataFrame:
    """(keys, day, n, outliers, q1, median, q3) of rows since a date; values over outlier are counted apart."""
    day = F.to_date(date)
    rows = df.where(F.col(date) >= F.lit(since).cast("timestamp"))
    ok = F.when(F.col(value) <= outlier, F.col(value))
    return rows.groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col(value) > outlier).alias("outliers"), *[F.percentile(ok, q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


#: The usual tolerance in percent, and the factor for some columns.
TOLERANCE, LOOSER, LOOSE_COLUMNS = 0.08, 12.5, ("barcode_", "alignment_", "adapter_", "primer_")


def compare_frames(a: DataFrame, b: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(column, only_a, only_b, compared, mean_ratio, differing, within) for each shared column.

    Numbers: mean of |a - b| relative to the larger, in percent, against the
    tolerance; text: how many differ. Two nulls are equal.
    """
    shared = [c for c in a.columns if c in b.columns and c != key]
    numeric = {c for c, t in a.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    m = a.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"a_{c}") for c in shared]).join(b.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"b_{c}") for c in shared]), F.col("_ka") == F.col("_kb"), "full")
    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    aggs = [F.count_if(F.col("_kb").isNull()).alias("only_a"), F.count_if(F.col("_ka").isNull()).alias("only_b"), F.count_if(both).alias("compared")]
    for c in shared:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in numeric:
            aggs.append(F.avg(F.when(both, F.coalesce(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))), F.lit(0.0)) * 100)).alias(f"r_{c}"))
        aggs.append(F.count_if(both & ~x.eqNullSafe(y)).alias(f"d_{c}"))
    one = m.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"r_{c}") if c in numeric else F.lit(None).cast("double")).alias("mean_ratio"), F.col(f"d_{c}").alias("differing"), F.lit(tolerance * (LOOSER if c.startswith(LOOSE_COLUMNS) else 1)).alias("limit")) for c in shared])
    out = one.select("only_a", "only_b", "compared", F.explode(rows).alias("x")).select("x.column", "only_a", "only_b", "compared", "x.mean_ratio", "x.differing", "x.limit")
    return out.withColumn("within", F.coalesce(F.col("mean_ratio") <= F.col("limit"), F.col("differing") == 0)).drop("limit")


def compare_records(a: DataFrame, b: DataFrame, key: str, skip_tags: list[str]) -> DataFrame:
    """(key, problem) of records(key, seq, qual, tags): missing on a side, or a difference; tag order is no matter."""
    tags = lambda c: F.array_sort(F.map_entries(F.map_filter(c, lambda k, v: ~k.isin(skip_tags or [""]))))
    m = a.select(F.col(key).alias("_k"), *[F.col(c).alias(f"a_{c}") for c in ("seq", "qual", "tags")]).join(b.select(F.col(key).alias("_l"), *[F.col(c).alias(f"b_{c}") for c in ("seq", "qual", "tags")]), F.col("_k") == F.col("_l"), "full")
    problem = F.when(F.col("_l").isNull(), "only in the first").when(F.col("_k").isNull(), "only in the second").when(~F.col("a_seq").eqNullSafe(F.col("b_seq")), "seq").when(~F.col("a_qual").eqNullSafe(F.col("b_qual")), "qual").when(~tags(F.col("a_tags")).eqNullSafe(tags(F.col("b_tags"))), "tags")
    return m.select(F.coalesce("_k", "_l").alias(key), problem.alias("problem")).where("problem IS NOT NULL")


def consistency(records: DataFrame, selected_group: str | None = None) -> DataFrame:
    """(problem) rows: several read groups without a selection, a selection that is absent, several models, no dwell tags."""
    one = records.agg(F.count_distinct("read_group").alias("groups"), F.count_if(F.col("read_group") == (selected_group or "")).alias("chosen"), F.count_distinct("model").alias("models"), F.count_if(F.col("has_moves")).alias("dwell"))
    found = F.filter(F.array(F.when((F.col("groups") > 1) & F.lit(selected_group is None), "several read groups"), F.when(F.lit(selected_group is not None) & (F.col("chosen") == 0), "selected read group is absent"), F.when(F.col("models") > 1, "several models"), F.when(F.col("dwell") == 0, "no dwell tags")), lambda x: x.isNotNull())
    return one.select(F.explode(found).alias("problem"))


def homogeneous(df: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys, and whether there is just one."""
    return df.agg(F.count_distinct(key).alias("keys")).withColumn("ok", F.col("keys") == 1)


def merge_sorted(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of frames whose columns may differ, in order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order)
