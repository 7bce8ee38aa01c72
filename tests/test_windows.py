"""Greedy windows and pair consensus against plain loops."""

import random

import pytest

from seqloom.operators import windows as W


def test_candidate_windows(spark):
    cols = spark.createDataFrame([("c", i, i) for i in range(300)], "k string, col bigint, major bigint")
    cand = spark.createDataFrame([("c", p) for p in (30, 35, 41, 120, 296)], "k string, position bigint")
    got = [(r.position, r.flank, r.first, r.last) for r in W.candidate_windows(cols, cand, "k", 20, 8).orderBy("position").collect()]
    assert got == [(30, 8, 22, 41), (35, 8, 27, 46), (41, 8, 33, 52), (120, 8, 112, 131)]
    with pytest.raises(ValueError):
        W.candidate_windows(cols, cand, "k", 5, 6)
    assert W.candidate_windows(cols, cand.where("false"), "k", 20, 8).count() == 0


def test_column_limited_windows(spark):
    rng = random.Random(1)
    steps = [("t", i, 1 + rng.choice([0, 0, 0, 4])) for i in range(100)]
    got = W.column_limited_windows(spark.createDataFrame(steps, "t string, pos bigint, step bigint"), "t", 30, 25).orderBy("start").collect()
    assert got[0].start == 0 and got[-1].end == 100 and all(a.end == b.start for a, b in zip(got, got[1:], strict=False))
    assert all(r.columns <= 25 and r.end - r.start <= 30 and r.columns == sum(s for _, p, s in steps if r.start <= p < r.end) for r in got)


def test_kept_tiles_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < 0.2, rng.random() < 0.5, rng.random() < 0.5) for k in "ab" for i in range(40)]
    want = set()
    for k in "ab":
        mine = {r[1]: r for r in rows if r[0] == k}
        for i, r in mine.items():
            if r[2]:
                want.add((k, i))
                for flag, way in ((4, 1), (3, -1)):
                    j = i
                    while mine[j][flag] and j + way in mine and not mine[j + way][2]:
                        j += way
                        want.add((k, j))
    got = {(r.k, r.t) for r in W.kept_tiles(spark.createDataFrame(rows, "k string, t int, candidate boolean, left boolean, right boolean"), ["k"], "t").collect()}
    assert got == want


def test_edge_flags(spark):
    rows = [("c", 0, 5, 1, 9, 0), ("c", 0, 6, 0, 10, 6), ("c", 0, 7, 0, 10, 0), ("c", 1, 8, 0, 10, 9), ("c", 1, 8, 1, 10, 0)]
    got = {r.tile: (r.left, r.right) for r in W.edge_flags(spark.createDataFrame(rows, "k string, tile int, major int, minor int, depth int, deletions int"), ["k"], "tile", 2, 2, 0.5).collect()}
    assert got == {0: (True, False), 1: (False, True)}


def test_pair_consensus(spark):
    rng = random.Random(3)
    truth = "".join(rng.choices("ACGT", k=120))
    turn = str.maketrans("ACGT", "TGCA")
    bad = truth[:60] + "ACGT"[("ACGT".index(truth[60]) + 1) % 4] + truth[61:]
    low = "I" * 58 + "#" * 5 + "I" * 57
    rows = [(1, bad, low, truth.translate(turn)[::-1], "I" * 120), (2, "A" * 30, "I" * 30, "C" * 30, "I" * 30)]
    got = W.pair_consensus(spark.createDataFrame(rows, "p int, t_seq string, t_qual string, c_seq string, c_qual string"), "p").collect()
    assert [(r.p, r.seq) for r in got] == [(1, truth)]
