"""Splitting of made-up concatemers."""

import random

import pytest

from seqloom.operators import splitting as S

TURN = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def pieces():
    rng = random.Random(5)
    seq = lambda n: "".join(rng.choices("ACGT", k=n))
    return seq(3000), seq(2500)


def parts(df):
    return sorted((r.read_id, r.offset, len(r.seq), r.rule, r.end_reason) for r in df.collect())


def test_rules(spark, pieces):
    a, b = pieces
    adapter = S.Settings().adapter
    turned = a.translate(TURN)[::-1]
    rows = [("plain", a, "e"), ("pore", a + "AAAAA" + adapter + b, "e"), ("turned", a + "GGGGG" + turned, "e"), ("hidden", a + adapter + turned, "e")]
    reads = spark.createDataFrame(rows, "read_id string, seq string, end_reason string")
    gaps = spark.createDataFrame([("pore", 3000, 3005), ("turned", 3000, 3005), ("plain", 1500, 1505)], "read_id string, g_start int, g_end int")
    got = parts(S.split(reads, gaps))
    assert [g for g in got if g[0] == "plain"] == [("plain", 0, 3000, None, "e")]
    assert [g for g in got if g[0] == "pore"] == [("pore", 0, 3000, "PORE_ADAPTER", None), ("pore", 3005, 24 + 2500, "PORE_ADAPTER", "e")]
    assert [g for g in got if g[0] == "turned"] == [("turned", 0, 3000, "PORE_FLANK", None), ("turned", 3005, 3000, "PORE_FLANK", "e")]
    hidden = [g for g in got if g[0] == "hidden"]
    assert len(hidden) == 2 and hidden[0][3] == "ADAPTER_FLANK" and hidden[0][4] is None and hidden[1][4] == "e"
    assert [g[3] for g in parts(S.split(reads, gaps, simplex=True)) if g[0] != "pore"] == [None] * 3


def test_middle_without_a_gap(spark, pieces):
    a, _ = pieces
    reads = spark.createDataFrame([("m", a + a.translate(TURN)[::-1], "e")], "read_id string, seq string, end_reason string")
    none = spark.createDataFrame([], "read_id string, g_start int, g_end int")
    got = parts(S.split(reads, none, S.Settings(relaxed_adapter_edits=2)))
    assert len(got) == 2 and {g[3] for g in got} == {"SPLIT_MIDDLE"} and abs(got[1][1] - 3000) <= 150
