"""Progress from the engine: estimates, intervals, and a real stream."""

from types import SimpleNamespace

from seqloom.streaming.progress import Progress, estimate_total, run_reported


def test_estimates():
    assert estimate_total(0, 0, 4, 0) == 0
    assert estimate_total(300, 3, 10, 250) == 1000
    assert estimate_total(300, 3, 10, 380) == 1000
    # 150 of the file being read are three quarters of 200
    assert estimate_total(300, 3, 10, 450) == 1250
    assert estimate_total(0, 0, 4, 75) == 400


def test_reports():
    p = Progress(files=4, files_per_batch=1, every=10)
    began = p._began
    p._early = []
    for batch, rows, at in ((0, 100, 4), (1, 60, 12), (2, 0, 13), (3, 80, 14)):
        p.add(batch, rows, began + at)
    p._close(began + 15)
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in p.reports] == [(1, 160, 160, 320, 50), (3, 80, 240, 320, 75)]
    assert abs(p.reports[0][6] - 12) < 1e-9 and abs(p.reports[1][6] - 14 / 3) < 1e-9


def test_only_the_named_query_counts():
    p = Progress(2, 1)
    event = lambda i, b, n: SimpleNamespace(progress=SimpleNamespace(id=i, batchId=b, numInputRows=n))
    p.onQueryProgress(event("x", 0, 5))
    p.onQueryProgress(event("y", 0, 7))
    p.follow(SimpleNamespace(id="y"))
    p.onQueryProgress(event("x", 1, 5))
    p.onQueryProgress(event("y", 1, 7))
    p.onQueryTerminated(SimpleNamespace(id="x"))
    assert not p.ended.is_set()
    p.onQueryTerminated(SimpleNamespace(id="y"))
    assert p.ended.is_set() and [r[2] for r in p.reports] == [7, 7] and p.reports[-1][5] == 100


def test_stream(spark, tmp_path):
    sizes = [50, 20, 80]
    for i, n in enumerate(sizes):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    start = lambda s: s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    got = run_reported(stream, start, 3, 1)
    assert sorted(r[2] for r in got.reports) == sorted(sizes)
    last = got.frame(spark).orderBy("batch").collect()[-1]
    assert (last.total_reads, last.total_estimate, last.percent) == (150, 150, 100) and abs(last.remaining) < 1e-6
