"""Streaming pairing, gates and progress; each has a batch twin with the same result."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.session import shared_dir, ship

#: Rows held for a key; older ones can't pair any more.
DEPTH = 10


def run_to_table(stream: DataFrame, name: str, mode: str = "append", once: bool = True) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote.

    Each micro-batch overwrites its own folder, so a repeated batch adds
    nothing; a complete-mode stream overwrites the whole.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def stream_pairs(stream: DataFrame, key: str, time: str, id_: str, value: str, max_gap_ms: int, late: str = "10 seconds") -> DataFrame:
    """(key, template, complement, gap_ms) of neighbours in a key, as they become known.

    State: the newest rows of a key, at most DEPTH. A row before the newest one
    that already has a successor comes too late to pair. Keys are forgotten
    once the watermark is past the longest gap.
    """
    kind = stream.schema[key].dataType.simpleString()

    def pair(keys, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        newest = held[-1] if held else None
        rows = []
        for pdf in batches:
            rows += list(zip((pdf[time].astype("datetime64[us]").astype("int64")).tolist(), pdf[id_].astype("int64").tolist(), strict=True))
        rows = sorted(r for r in rows if newest is None or r > newest)
        chain = ([newest] if newest else []) + rows
        found = [(keys[0], a[1], b[1], (b[0] - a[0]) // 1000) for a, b in zip(chain, chain[1:], strict=False) if (b[0] - a[0]) // 1000 < max_gap_ms]
        held = (held + rows)[-DEPTH:]
        if held:
            state.update(tuple(map(list, zip(*held, strict=True))))
            state.setTimeoutTimestamp(max(held[-1][0] // 1000 + max_gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=[key, "template", "complement", "gap_ms"])

    ship(stream.sparkSession)
    return stream.select(key, time, id_).withWatermark(time, late).groupBy(key).applyInPandasWithState(pair, f"{key} {kind}, template bigint, complement bigint, gap_ms bigint", "times array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_parents(reads: DataFrame, children: DataFrame, time: str, bound: str) -> DataFrame:
    """Reads left-joined with the children that name them as a parent, within `bound` of time."""
    named = children.select(F.explode(F.split("read_id", ";")).alias("parent"), F.col(time).alias("child_time")).withWatermark("child_time", bound)
    left = reads.withWatermark(time, bound)
    on = F.expr(f"read_id = parent AND child_time BETWEEN {time} - INTERVAL {bound} AND {time} + INTERVAL {bound}")
    return left.join(named, on, "leftOuter").withColumn("is_parent", F.col("parent").isNotNull()).drop("parent", "child_time")


def complete_groups(df: DataFrame, group: str, expected: str) -> DataFrame:
    """(group, n): groups all of whose expected members have come (batch form)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.max(expected).alias("_e")).where(F.col("n") == F.col("_e")).drop("_e")


def stream_complete_groups(stream: DataFrame, group: str, expected: str, time: str, late: str = "1 hour") -> DataFrame:
    """The stream form: a group is emitted once, when its last member comes, and then forgotten."""
    kind = stream.schema[group].dataType.simpleString()

    def gate(keys, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        want = None
        for pdf in batches:
            n, want = n + len(pdf), int(pdf[expected].max())
        if want is not None and n >= want:
            if state.exists:
                state.remove()
            yield pd.DataFrame({group: [keys[0]], "n": [n]})
        elif want is not None:
            state.update((n,))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)

    ship(stream.sparkSession)
    return stream.withWatermark(time, late).groupBy(group).applyInPandasWithState(gate, f"{group} {kind}, n bigint", "n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def progress_windows(df: DataFrame, time: str, width: str) -> DataFrame:
    """(start, n, total) counts of each time window; works on streams in complete mode too."""
    return df.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def remaining_seconds(elapsed: float, processed: int, known: dict[str, int], files: int, current_done: bool) -> float | None:
    """elapsed * (estimate / processed - 1); the estimate is reads per known file times files.

    The file being read counts as three quarters read.
    """
    if not processed or not known:
        return None
    seen = len(known) if current_done else len(known) - 0.25
    return elapsed * (sum(known.values()) / seen * files / processed - 1)


def resume(stream: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """Rows of a stream that an earlier run has not written; the checkpoint covers this run's own."""
    return stream.join(done.select(F.col("id").alias("_done")).distinct(), F.col(id_) == F.col("_done"), "left_anti")
