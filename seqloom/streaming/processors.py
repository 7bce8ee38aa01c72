"""Stateful processors for reads that come in any order within the watermark.

Each keeps what it has seen in keyed state and answers when an answer can't change any
more: pairs once the watermark has passed them, parents when a child names them or none
can any more, groups when their last member has come. Repeated rows change nothing. The results
are those of the batch forms, however rows were dealt to micro-batches.

Keys are dealt to BUCKETS by their hash and a bucket's keys are worked on together, as frames
of columns: a call and its state cost milliseconds, whether of one key or of thousands. A bucket's
state is read and written whole when rows of it come. Keys travel as text, so they
are numbers, dates or strings.

State is in RocksDB; session() sets the provider where it isn't set yet.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqloom.session import ship

#: Groups of keys that share a state.
BUCKETS = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> None:
    """What transformWithState needs of a session, where it isn't set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, PROVIDER)
    # a process beside the driver unpickles processors too, and doesn't get what is shipped
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ship(spark)


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def _load(state) -> list[pd.DataFrame]:
    """The frame held in a value state, none if there is none."""
    if not state.exists():
        return []
    with pa.ipc.open_stream(bytes(state.get()[0])) as reader:
        return [reader.read_pandas()]


def _hold(state, rows: pd.DataFrame) -> None:
    """Puts rows in a value state; no rows clear it."""
    if rows.empty:
        state.clear()
        return
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _sent(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if not rows.empty:
        yield rows.reset_index(drop=True)


class Pairs(StatefulProcessor):
    """Neighbours of a key in order of (start, id), each pair when the watermark has passed its later read.

    State: the reads after the watermark, and the last one of each key before it (`done`).
    """

    def __init__(self, max_gap_ms: int, min_length: int):
        self.max_gap_ms, self.min_length = max_gap_ms, min_length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a heartbeat isn't a read and moves the watermark only
        new = [pdf.loc[pdf["is_read"], ["key", "start", "id", "end", "length"]].assign(done=False) for pdf in rows]
        if any(len(n) for n in new):
            held = pd.concat([*_load(self.held), *new]).drop_duplicates(["key", "start", "id"], keep="last")
            _hold(self.held, held)
            self.handle.registerTimer(int(held.loc[~held["done"], "start"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for held in _load(self.held):
            known = held[held["done"] | (held["start"] <= mark)].sort_values(["key", "start", "id"])
            ahead = held[~held["done"] & (held["start"] > mark)]
            code = pd.Series(pd.factorize(known["key"])[0], known.index)
            near, before = code == code.shift(), known[["id", "end", "length"]].shift(fill_value=0)
            gap = known["start"] - before["end"]
            found = near & ~known["done"] & (gap >= 0) & (gap < self.max_gap_ms) & (known["length"] >= self.min_length) & (before["length"] >= self.min_length)
            _hold(self.held, pd.concat([known[code != code.shift(-1)].assign(done=True), ahead]))
            if len(ahead):
                self.handle.registerTimer(int(ahead["start"].min()))
            yield from _sent(pd.DataFrame({"key": known["key"], "template": before["id"], "complement": known["id"], "gap_ms": gap})[found])

    def close(self) -> None:
        pass


def pair_reads(stream: DataFrame, key: str, time: str, id_: str, end: str, length: str, max_gap_ms: int = 10_000, min_length: int = 500, late: str = "10 seconds") -> DataFrame:
    """(key, template, complement, gap_ms): each read and its successor in the key, if near and long enough.

    stream: one row a read, with its start (a timestamp, event time), its end
    (a timestamp) and its length. A row may come `late` after newer ones and still finds its
    place; rows with a null id only move the watermark.
    """
    session(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    number = lambda c, name: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(name)
    rows = stream.withWatermark(time, late).select(F.col(time).alias("_time"), _bucket(key), F.col(key).cast("string").alias("key"), F.col(id_).isNotNull().alias("is_read"), number(F.unix_millis(time), "start"), number(F.col(id_), "id"), number(F.unix_millis(end), "end"), number(F.col(length), "length"))
    out = rows.groupBy("bucket").transformWithStateInPandas(Pairs(max_gap_ms, min_length), "key string, template bigint, complement bigint, gap_ms bigint", "Append", "EventTime")
    return out.select(F.col("key").cast(kind).alias(key), "template", "complement", "gap_ms")


class Parents(StatefulProcessor):
    """A read waits until a child names it, or none can any more.

    State: for each id whether it came as a read, is wanted by a child and was sent, and until when it is waited for.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a row without an id moves the watermark only
        new = [pd.DataFrame({"read_id": p["read_id"], "read": ~p["is_child"], "wanted": p["is_child"], "sent": False, "until": p["at_ms"] + self.wait_ms}) for p in (pdf[pdf["read_id"].notna()] for pdf in rows)]
        if any(len(n) for n in new):
            held = pd.concat([*_load(self.held), *new]).groupby("read_id", as_index=False, sort=False).max()
            found = held["read"] & held["wanted"] & ~held["sent"]
            _hold(self.held, held.assign(sent=held["sent"] | found))
            self.handle.registerTimer(int(held["until"].min()))
            yield from _sent(held.loc[found, ["read_id"]].assign(is_parent=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for held in _load(self.held):
            over = held["until"] <= mark
            _hold(self.held, held[~over])
            if not over.all():
                self.handle.registerTimer(int(held.loc[~over, "until"].min()))
            yield from _sent(held.loc[over & held["read"] & ~held["sent"], ["read_id"]].assign(is_parent=False))

    def close(self) -> None:
        pass


def tag_parents(stream: DataFrame, id_: str, children: str, time: str, wait: int = 3_600_000, late: str = "10 seconds") -> DataFrame:
    """(read_id, is_parent): each simplex read once, true when a duplex read names it.

    stream: rows with an id, or with `children` like `template;complement` for a duplex read, which
    names two. A read without a child is sent when the watermark is `wait` milliseconds past what
    was last heard of it; a row with neither moves the watermark only.
    """
    session(stream.sparkSession)
    named = F.when(F.col(children).isNotNull(), F.transform(F.split(children, ";"), lambda x: F.struct(x.alias("read_id"), F.lit(True).alias("is_child")))).otherwise(F.array(F.struct(F.col(id_).cast("string").alias("read_id"), F.lit(False).alias("is_child"))))
    rows = stream.withWatermark(time, late).select(F.col(time).alias("_time"), F.unix_millis(time).alias("at_ms"), F.inline(named)).withColumn("bucket", _bucket("read_id"))
    return rows.groupBy("bucket").transformWithStateInPandas(Parents(wait), "read_id string, is_parent boolean", "Append", "EventTime")


class Gate(StatefulProcessor):
    """A group opens once when all that was announced for it has come.

    State: the members of groups that aren't open, and for each group what was announced (-1: nothing), how many came, whether it opened, until when it is kept.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows binary")
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[["key", "at_ms", "told", "came", "value"]] for pdf in rows])
        if new.empty:
            return
        groups = lambda df: df.groupby("key", as_index=False, sort=False, dropna=False)
        held = pd.concat(_load(self.held) or [pd.DataFrame({"key": [], "expected": [], "opened": [], "until": []})])
        mine = pd.DataFrame({"key": new["key"], "expected": new["value"].where(new["told"], -1), "opened": False, "until": new["at_ms"] + self.wait_ms})
        # of several announcements the last one counts
        told = pd.concat([held[["key", "expected"]], mine[["key", "expected"]]])
        told = told[told["expected"] >= 0].drop_duplicates("key", keep="last")
        held = groups(pd.concat([held[["key", "opened", "until"]].astype({"opened": bool, "until": "int64"}), mine[["key", "opened", "until"]]])).max().merge(told, "left", "key")
        held["expected"] = held["expected"].fillna(-1).astype("int64")
        seen = pd.concat([*_load(self.seen), new.loc[new["came"], ["key", "value"]]]).drop_duplicates()
        held = held.merge(groups(seen).size().rename(columns={"size": "n"}), "left", "key")
        held["n"] = held["n"].fillna(0).astype("int64")
        found = ~held["opened"] & (held["expected"] >= 0) & (held["n"] >= held["expected"])
        held["opened"] |= found
        _hold(self.seen, seen[~seen["key"].isin(held.loc[held["opened"], "key"])])
        _hold(self.held, held[["key", "expected", "opened", "until"]])
        self.handle.registerTimer(int(held["until"].min()))
        yield from _sent(held.loc[found, ["key", "n"]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # only silence since the last row ends a group
        mark = timerValues.getCurrentWatermarkInMs()
        for held in _load(self.held):
            over = held["until"] <= mark
            _hold(self.held, held[~over])
            for seen in _load(self.seen):
                _hold(self.seen, seen[~seen["key"].isin(held.loc[over, "key"])])
            if not over.all():
                self.handle.registerTimer(int(held.loc[~over, "until"].min()))
        yield from ()

    def close(self) -> None:
        pass


def open_gates(announced: DataFrame, finished: DataFrame, group: str, expected: str, member: str, time: str, wait: int = 3_600_000, late: str = "10 seconds") -> DataFrame:
    """(group, n): groups whose members have all come, each once.

    announced(group, expected, time) says how many members a group has, finished(group, member,
    time) that one has come; both may come in any order and repeatedly. A group is forgotten
    when nothing of it came for `wait` milliseconds of event time.
    """
    session(announced.sparkSession)
    kind = announced.schema[group].dataType.simpleString()

    def half(df: DataFrame, value: str, told: bool) -> DataFrame:
        here = F.col(value).isNotNull()
        return df.select(F.col(time).alias("_time"), F.col(group).alias("group"), (here & F.lit(told)).alias("told"), (here & F.lit(not told)).alias("came"), F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint")).alias("value"))

    rows = half(announced, expected, True).unionByName(half(finished, member, False)).withWatermark("_time", late).select("_time", _bucket("group"), F.col("group").cast("string").alias("key"), F.unix_millis("_time").alias("at_ms"), "told", "came", "value")
    out = rows.groupBy("bucket").transformWithStateInPandas(Gate(wait), "key string, n bigint", "Append", "EventTime")
    return out.select(F.col("key").cast(kind).alias(group), "n")
