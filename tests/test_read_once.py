from pyspark.sql import functions as F

from seqloom.operators import variants


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_joined_samples_make_their_columns_once(spark):
    rows = spark.range(40).select(F.lit("c").alias("contig"), F.expr("id div 10").alias("sample"), F.col("id").alias("major"), F.lit(0).alias("minor"), F.lit("A").alias("ref"), F.array(F.lit("A")).alias("calls"), F.array(F.lit(-0.1)).alias("logp"), F.lit(-0.1).alias("ref_logp"))
    out = variants.join_samples(rows, ["contig"])
    assert "Range" not in _plan(out)
    assert out.count() == 40 and out.select("sample").distinct().count() == 5


def test_trimmed_samples_make_their_columns_once(spark):
    rows = spark.range(30).select(F.lit("c").alias("contig"), F.expr("id div 10").alias("sample"), F.expr("id % 10 + 8 * (id div 10)").alias("major"), F.lit(0).alias("minor"))
    out = variants.trim_samples(rows, ["contig"], (2, 20), True)
    assert "Range" not in _plan(out)
    assert sorted((r.sample, r.start, r.end) for r in out.collect()) == [(0, 2, 9), (1, 1, 9), (2, 1, 4)]
