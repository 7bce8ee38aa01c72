"""Progress of a stream over the events, cut to files by their ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.plans.registry import query
from seqloom.session import read, shared_dir
from seqloom.streaming.progress import run_reported

_FILES = 8


# files come in any order, so reports are told by the set of their intervals and by the last
@query("engine_progress", f"""WITH f AS (SELECT event_id % {_FILES} AS file, count(*) AS n FROM events GROUP BY 1)
SELECT 'interval' AS report, n AS reads, NULL AS total_estimate, NULL AS percent FROM f UNION ALL SELECT 'end', sum(n)::BIGINT, sum(n)::BIGINT, 100 FROM f""")
def engine_progress(spark, d):
    """One file a micro-batch; the reads of each and the final report, as the engine counted them."""
    folder = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    events = read(spark, d, "events").withColumn("file", F.col("event_id") % _FILES)
    events.repartition("file").write.partitionBy("file").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    files = len(stream.sparkSession.read.parquet(f"{folder}/in").inputFiles())
    start = lambda s: s.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    found = run_reported(stream, start, files, 1).frame(spark)
    each = found.select(F.lit("interval").alias("report"), F.col("interval_reads").alias("reads"), F.lit(None).cast("bigint").alias("total_estimate"), F.lit(None).cast("int").alias("percent"))
    end = found.agg(F.max_by(F.struct("total_reads", "total_estimate", "percent"), "batch").alias("e")).select(F.lit("end").alias("report"), F.col("e.total_reads").alias("reads"), F.col("e.total_estimate").alias("total_estimate"), F.col("e.percent").alias("percent"))
    return each.unionByName(end)
