"""Every core query with SQL against DuckDB over the same tables."""

import math
import os

import pytest

from seqloom.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_same_with_other_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("interval_hits", "merge_ranges", "first_wins", "cigar_pileup", "variant_islands", "robust_scale"):
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = registry.QUERIES[name](spark, SF)
            found.append(rows(df.columns, df.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert found[0] == found[1]
