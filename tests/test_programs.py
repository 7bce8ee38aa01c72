"""Program lines of merged headers."""

from seqloom.operators import joins

SCHEMA = "file string, key string, line string, parent string"


def test_programs_are_renamed_along_their_chains(spark):
    rows = [("f", "align", "v1", None), ("f", "sort", "s", "align"), ("g", "align", "v2", None), ("g", "sort", "s", "align"), ("h", "align", "v1", None), ("h", "sort", "s", "align"), ("h", "dup", "d", "sort")]
    got = {(r.file, r.key): (r.new_key, r.new_parent) for r in joins.merge_programs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["f", "align"] == got["h", "align"] == ("align", None) and got["g", "align"] == ("align.1", None)
    assert got["f", "sort"] == got["h", "sort"] and got["h", "dup"] == ("dup", got["h", "sort"][0])
    assert {got["f", "sort"], got["g", "sort"]} in ({("sort", "align"), ("sort.2", "align.1")}, {("sort.2", "align"), ("sort", "align.1")})
    keys = {k for k, _ in got.values()}
    assert all(p is None or p in keys for _, p in got.values())


def test_programs_without_parents_or_in_circles(spark):
    rows = [("f", "a", "x", "gone"), ("f", "b", "y", "c"), ("f", "c", "z", "b"), ("f", "a", "x", "gone")]
    got = sorted(tuple(r) for r in joins.merge_programs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("f", "a", "x", "a", None), ("f", "b", "y", "b", "c"), ("f", "c", "z", "c", "b")]
    assert joins.merge_programs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_of_files_are_not_broadcast(spark):
    rows = [(f, f"k{i}", "CL:x", f"k{i - 1}" if i else None) for f in range(50) for i in range(3)]
    out = joins.merge_programs(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 150
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # files meet each other's rows by file and key; only distinct programs may be small
    assert plan.count("strategy=merge") >= 2
