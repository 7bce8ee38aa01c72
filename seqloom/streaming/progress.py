"""Progress of a stream from the engine's own figures of each micro-batch."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Fixed value: how much of the file being read is taken to be read.
CURRENT_FILE_READ = 0.75
REPORT = "batch bigint, elapsed double, interval_reads bigint, total_reads bigint, total_estimate bigint, percent int, remaining double"


def estimate_total(known_reads: int, known_files: int, files: int, processed: int) -> int:
    """Reads of all files: those per known file, times files.

    Reads beyond the known files' are of the file being read. If they are more
    than a file's, it counts too, as three quarters read.
    """
    per_file = known_reads / known_files if known_files else 0.0
    current = max(0, processed - known_reads)
    if current <= per_file:
        return int(per_file * files)
    return int((known_reads + int(current / CURRENT_FILE_READ)) / (known_files + 1) * files)


class Progress(StreamingQueryListener):
    """Reports of one query's batches, from the rows that Spark says it read.

    files is the number of input files, files_per_batch what a trigger takes at
    most. A batch reads whole files, so after it their reads are known. Every
    `every` seconds at most one report is kept, and the last; reports hold a few
    numbers each, whatever the rows.
    """

    def __init__(self, files: int, files_per_batch: int, every: float = 0.0):
        self.files, self.files_per_batch, self.every = files, files_per_batch, every
        self.reports: list[tuple] = []
        self.ended = threading.Event()
        self._lock = threading.Lock()
        self.query_id: str | None = None
        self._early: list[tuple] = []
        self._began = self._last = time.monotonic()
        self._batches = self._total = self._interval = 0
        self._open: tuple | None = None

    def follow(self, query) -> None:
        """Names the query whose batches count; what came before its name was known is looked at now."""
        with self._lock:
            self.query_id = str(query.id)
            early, self._early = self._early, []
            for event in early:
                self._take(*event)

    def _take(self, id_: str, batch: int | None, rows: int, now: float) -> None:
        if self.query_id is None:
            self._early.append((id_, batch, rows, now))
        elif id_ == self.query_id and batch is not None:
            self.add(batch, rows, now)
        elif id_ == self.query_id:
            self._close(now)
            self.ended.set()

    def add(self, batch: int, rows: int, now: float) -> None:
        """One batch of `rows` reads, ended at `now` seconds."""
        if rows == 0:
            return
        self._batches += 1
        self._total += rows
        self._interval += rows
        known = min(self.files, self._batches * self.files_per_batch)
        estimate = estimate_total(self._total, known, self.files, self._total)
        elapsed = now - self._began
        remaining = elapsed * estimate / self._total - elapsed
        self._open = (batch, elapsed, self._interval, self._total, estimate, int(min(100.0, 100.0 * self._total / max(1, estimate))), remaining)
        if now - self._last >= self.every:
            self._close(now)

    def _close(self, now: float) -> None:
        if self._open is not None:
            self.reports.append(self._open)
            self._open, self._interval, self._last = None, 0, now

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self._take(str(p.id), p.batchId, p.numInputRows, time.monotonic())

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._take(str(event.id), None, 0, time.monotonic())

    def frame(self, spark: SparkSession) -> DataFrame:
        """The reports as rows of REPORT."""
        return spark.createDataFrame(self.reports, REPORT)


def run_reported(stream: DataFrame, start, files: int, files_per_batch: int, every: float = 0.0, wait: float = 60.0) -> Progress:
    """Runs start(stream), a function that starts a query, to its end and returns its progress."""
    progress = Progress(files, files_per_batch, every)
    spark = stream.sparkSession
    spark.streams.addListener(progress)
    try:
        query = start(stream)
        progress.follow(query)
        query.awaitTermination()
        progress.ended.wait(wait)
    finally:
        spark.streams.removeListener(progress)
    return progress
