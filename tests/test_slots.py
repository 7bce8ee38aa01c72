"""Slots of the read matrix against a walk over every place; windows with too few alignments."""

import random

import pytest

from seqloom.operators import pileup as P


def plain_slots(reads, tile, most, gap):
    out = {}
    for nth in range(0, 1 + max(e for _, _, e in reads) // tile):
        ends, placed = [], {}
        order = sorted((s, i, e) for i, s, e in reads)
        for at in range(nth * tile, (nth + 1) * tile):
            for s, i, e in order:
                if s <= at < e and i not in placed:
                    out.setdefault((nth, i), (None, None))
                    slot = next((n for n, x in enumerate(ends) if at >= x + gap), len(ends))
                    if most is None or slot < most:
                        ends[slot : slot + 1] = [e]
                        placed[i] = slot
                        out[nth, i] = (slot, at)
    return out


@pytest.mark.parametrize("most", [None, 0, 1, 3, 6])
def test_slots(spark, most):
    rng = random.Random(most or 9)
    reads = [(i, s, s + rng.randrange(1, 60)) for i, s in ((i, rng.randrange(300)) for i in range(90))]
    rows = [("c", *r) for r in reads] + [("d", 500, 3, 9), ("d", 501, 9, 9), ("d", 502, None, 9), (None, 503, 1, 9)]
    df = spark.createDataFrame(rows, "c string, id int, s int, e int")
    got = P.read_slots(df, "id", "c", "s", "e", 100, most, 5).collect()
    assert {(r.tile, r.id): (r.slot, r.placed) for r in got if r.c == "c"} == plain_slots(reads, 100, most, 5)
    assert [(r.id, r.slot) for r in got if r.c != "c"] == [(500, None if most == 0 else 0)]
    by_slot = {}
    for r in got:
        if r.slot is not None:
            by_slot.setdefault((r.c, r.tile, r.slot), []).append(r)
    ends = {i: e for i, _, e in reads} | {500: 9}
    for rows in by_slot.values():
        rows.sort(key=lambda r: r.placed)
        assert all(b.placed >= ends[a.id] + 5 for a, b in zip(rows, rows[1:]))


def test_votes_need_two_alignments(spark):
    df = spark.createDataFrame([(1, 0, "a", 5, "t", 1), (2, 0, "a", 5, "t", 2), (3, 0, "a", 1, "t", 2)], "win int, at int, symbol string, n int, target string, aligned int")
    got = P.vote(df, ["win", "at"], "symbol", "n", "target", aligned="aligned").collect()
    assert sorted((r.win, r.consensus) for r in got) == [(2, "a"), (3, "t")]


def test_datatypes(spark):
    df = spark.createDataFrame([(1, {"DT": "b"}), (2, {"DT": "z"}), (3, {}), (4, None), (5, {"DT": "a"})], "id int, tags map<string,string>")
    typed, wrong = P.datatypes(df, "id", ["a", "b"])
    assert sorted((r.id, r.dtype) for r in typed.collect()) == [(1, 1), (5, 0)]
    assert sorted(map(tuple, wrong.collect())) == [(2, "unknown DT z"), (3, "DT is missing"), (4, "DT is missing")]
    one, none = P.datatypes(df, "id", ["a"])
    assert {r.dtype for r in one.collect()} == {0} and one.count() == 5 and none.count() == 0
