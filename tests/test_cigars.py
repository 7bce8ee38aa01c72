import random
import re

from seqloom.functions import cigars
from seqloom.operators import pileup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar or "")]


def test_operations_are_those_of_the_pattern():
    texts = ["3M2I", None, "", "*", "M5M", "12345678901M", "7", "7Q3X", "10=", "é4D", "1M"]
    row, op, n = cigars.operations(texts)
    assert [(r, int(x), chr(o)) for r, o, x in zip(row, op, n)] == [(i, x, o) for i, t in enumerate(texts) for x, o in _ops(t)]
    assert cigars.sums_before(n, row).tolist() == [sum(x for x, _ in _ops(t)[:k]) for t in texts for k in range(len(_ops(t)))]


def _windows(pos, cigar, tlen, size):
    ops, at = [], pos
    for n, o in _ops(cigar):
        step = n if o in "MDN=X" else 0
        ops.append((at, at + step, n, o))
        at += step
    got = {}
    for a, b, n, o in ops:
        for w in range(a // size, max((b - 1 if b > a else a) // size, a // size) + 1):
            x = got.setdefault(w, dict.fromkeys("MXID", 0) | {"longest": 0})
            cut = min(b, (w + 1) * size) - max(a, w * size) if b > a else n
            kind = "M" if o == "=" else o
            if kind in x:
                x[kind] += cut
            if o in "ID":
                x["longest"] = max(x["longest"], n)
    if not ops or at - pos < size:
        return []
    return [(w, x["M"], x["X"], x["I"], x["D"], x["longest"]) for w, x in sorted(got.items()) if pos <= w * size + size / 10 and at >= min(tlen, (w + 1) * size) - size / 10]


def test_overlap_windows_by_hand_and_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(cigars, "CHUNK", 100)
    rng = random.Random(1)
    rows = [(i, rng.randrange(90), "".join(f"{rng.randrange(1, 70)}{rng.choice('MMMX=IDNSH')}" for _ in range(rng.randrange(12))), 400) for i in range(200)]
    rows += [(200, None, "90M", 400), (201, 3, None, 400), (202, 3, "*", 400)]
    out = pileup.overlap_windows(spark.createDataFrame(rows, "id long, pos int, cigar string, tlen int"), "id", 50)
    assert "Exchange" not in _plan(out)
    got = sorted((r.id, r.win, r.matches, r.mismatches, r.ins, r["del"], r.longest_indel) for r in out.collect())
    assert got == sorted((i, *w) for i, p, c, t in rows if p is not None for w in _windows(p, c, t, 50))


def test_pileup_counts_what_its_rows_say(spark, monkeypatch):
    monkeypatch.setattr(cigars, "CHUNK", 200)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(30), rng.choice([0, 16, None]), "".join(f"{rng.randrange(0, 5)}{rng.choice('MX=IDNSH')}" for _ in range(rng.randrange(9))), "".join(rng.choice("acgtACGTNdD*é") for _ in range(rng.randrange(25))), rng.choice([1, 2, None])) for i in range(300)]
    rows += [(300, "a", 4, 0, "3M2D", None, 1), (301, "a", 4, 0, None, "ACG", 1), (302, "a", 4, 16, "2D", "", None)]
    reads = spark.createDataFrame(rows, "id long, rname string, pos int, flag int, cigar string, seq string, dtype int")
    key = lambda r: str(tuple(r))
    for strata in (None, ["dtype"]):
        want = pileup.pileup_rows(reads, "id", strata).groupBy("rname", "major", "minor", "symbol", *(strata or [])).count()
        assert sorted((tuple(r) for r in pileup.pileup(reads, "id", strata).collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)


def test_an_ambiguous_d_is_no_deletion(spark):
    read = spark.createDataFrame([(1, "a", 0, 0, "3M", "ADC")], "id long, rname string, pos int, flag int, cigar string, seq string")
    assert sorted((r.major, r.symbol) for r in pileup.pileup_rows(read, "id").collect()) == [(0, "A"), (2, "C")]


def test_depth_features_counts_once(spark):
    reads = spark.createDataFrame([(1, "a", 0, 0, "3M1I2D", "ACGT"), (2, None, 0, 16, "2M", "AC")], "id long, rname string, pos int, flag int, cigar string, seq string")
    out = pileup.depth_features(pileup.pileup(reads, "id"))
    assert _plan(out).count("MapInPandas") == 1 and "Join" not in _plan(out)
    assert sorted((str(r.rname), r.major, r.minor, r.symbol, r.depth) for r in out.collect()) == [("None", 0, 0, "a", 0), ("None", 1, 0, "c", 0), ("a", 0, 0, "A", 1), ("a", 1, 0, "C", 1), ("a", 2, 0, "G", 1), ("a", 2, 1, "T", 1), ("a", 3, 0, "D", 1), ("a", 4, 0, "D", 1)]
