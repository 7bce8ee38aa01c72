"""Stateful processors: shuffled and repeated micro-batches equal the batch result."""

import random
from datetime import datetime, timedelta

import pytest

from seqloom.streaming import processors, stateful

T0 = datetime(2024, 1, 1)


def batches(spark, folder, rows, schema, n):
    """A stream of n files, read one a micro-batch."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.mark.parametrize("n", [3, 10])
def test_pairs_from_shuffled_batches(spark, tmp_path, n):
    rng = random.Random(n)
    reads = [(k, at(s), i, at(s + d), length) for i, (k, s, d, length) in enumerate((rng.choice("abc"), rng.randint(0, 900) / 3, rng.randint(0, 9) / 3, rng.choice([400, 600, 5000])) for _ in range(120))]
    want = []
    for k in "abc":
        mine = sorted((r for r in reads if r[0] == k), key=lambda r: (r[1], r[2]))
        for a, b in zip(mine, mine[1:], strict=False):
            gap = (b[1] - T0) // timedelta(milliseconds=1) - (a[3] - T0) // timedelta(milliseconds=1)
            if 0 <= gap < 3000 and min(a[4], b[4]) >= 500:
                want.append((k, a[2], b[2], gap))
    rng.shuffle(reads)
    # all rows are within the delay; repeats come too, and in the end a heartbeat
    rows = reads + reads[:20] + [("h", at(10_000), None, None, None)] * n
    s = batches(spark, tmp_path / "in", rows, "k string, start timestamp, id bigint, end timestamp, length int", n)
    out = stateful.run_to_table(processors.pair_reads(s, "k", "start", "id", "end", "length", 3000, 500, "20000 seconds"), "pairs")
    assert out.count() == 0
    # a delay that the heartbeat gets over
    rows = [r for r in rows if r[2] is not None]
    late = batches(spark, tmp_path / "two", rows, "k string, start timestamp, id bigint, end timestamp, length int", n)
    spark.createDataFrame([("h", at(10_000), None, None, None)], "k string, start timestamp, id bigint, end timestamp, length int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/two/zz")
    out = stateful.run_to_table(processors.pair_reads(late, "k", "start", "id", "end", "length", 3000, 500, "400 seconds"), "pairs")
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and want


def test_parents_are_tagged_once(spark, tmp_path):
    rng = random.Random(4)
    reads = [(str(i), None, at(i)) for i in range(40)]
    named = [rng.sample(range(40), 2) for _ in range(12)]
    rows = reads + [(None, f"{a};{b}", at(max(a, b))) for a, b in named] + reads[:5] + [(None, "90;91", at(3))]
    rng.shuffle(rows)
    s = batches(spark, tmp_path / "in", rows, "id string, kids string, ts timestamp", 5)
    spark.createDataFrame([(None, None, at(9_999_999))], "id string, kids string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/zz")
    out = stateful.run_to_table(processors.tag_parents(s, "id", "kids", "ts", 1000, "60 seconds"), "parents")
    wanted = {str(x) for pair in named for x in pair}
    assert sorted((r.read_id, r.is_parent) for r in out.where("read_id IS NOT NULL").collect()) == sorted((str(i), str(i) in wanted) for i in range(40))


def test_gates_open_once(spark, tmp_path):
    rng = random.Random(5)
    groups = {g: rng.randint(1, 6) for g in range(12)}
    announced = [(g, n, at(g)) for g, n in groups.items()] * 2
    finished = [(g, m, at(g + m)) for g, n in groups.items() for m in range(n - (g % 4 == 0))] * 2
    rng.shuffle(announced)
    rng.shuffle(finished)
    a = batches(spark, tmp_path / "a", announced, "g bigint, expected int, ts timestamp", 4)
    f = batches(spark, tmp_path / "f", finished, "g bigint, member int, ts timestamp", 4)
    out = stateful.run_to_table(processors.open_gates(a, f, "g", "expected", "member", "ts", late="60 seconds"), "gates")
    assert sorted(tuple(r) for r in out.collect()) == [(g, n) for g, n in groups.items() if g % 4]


def test_keys_share_a_bucket(spark, tmp_path):
    """Three thousand groups are worked on by bucket, not each by itself."""
    a = batches(spark, tmp_path / "a", [(g, 2, at(g)) for g in range(3000)], "g bigint, expected int, ts timestamp", 2)
    f = batches(spark, tmp_path / "f", [(g, m, at(g + m)) for g in range(3000) for m in range(2)], "g bigint, member int, ts timestamp", 2)
    out = processors.open_gates(a, f, "g", "expected", "member", "ts", late="4000 seconds")
    assert processors.BUCKETS < 3000 and "bucket" in out._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in stateful.run_to_table(out, "shared").collect()) == [(g, 2) for g in range(3000)]
