"""Variant calling from columns: known cases, joined samples, reference rows."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import variants as V

SCHEMA = "k string, sample int, major bigint, minor bigint, ref string, calls array<string>, logp array<double>, ref_logp double"


def columns(spark, cases, cut=None):
    """Columns of cases(key -> (gapped reference, gapped haplotypes)); cut(key, i) gives the sample."""
    rows = []
    for k, (ref, haps) in cases.items():
        major, minor = -1, 0
        for i, r in enumerate(ref):
            major, minor = (major, minor + 1) if r == "*" else (major + 1, 0)
            rows.append((k, cut(k, i) if cut else 0, major, minor, r, [h[i] for h in haps], [0.0] * len(haps), 0.0 if any(h[i] == r for h in haps) else -23.0))
    return spark.createDataFrame(rows, SCHEMA)


def called(df):
    return sorted((r.pos, r.ref, tuple(r.alts), r.gt, r.filter, r.rstart, r.rend) for r in df.collect())


N = {}  # no option
NORM = {"normalize": True}
BOTH = {"normalize": True, "merge_overlapping": True, "merge_adjacent": True}
DIPLOID = "ACCAAA*AAA"
# (reference, haplotypes, options, (pos, ref, alts, gt, filter, rstart, rend) expected)
CASES = [
    ("ACTG", ["ACTG"], N, []),
    ("ACTG", ["AGTG", "ACTG"], N, [(1, "C", ("G",), "0/1", "PASS", 1, 2)]),
    ("ACATG", ["AGATG", "ACAAG"], N, [(1, "C", ("G",), "0/1", "PASS", 1, 2), (3, "T", ("A",), "0/1", "PASS", 3, 4)]),
    ("ACTG", ["AGTG", "ACAG"], N, [(1, "CT", ("CA", "GT"), "1/2", "PASS", 1, 3)]),
    ("AAAA", ["ACAA"], NORM, [(1, "A", ("C",), "1", "PASS", 1, 2)]),
    ("CAAA", ["CA*A"], NORM, [(0, "CA", ("C",), "1", "PASS", 0, 3)]),
    ("CAAA", ["CA*A"], N, [(2, "A", (".",), "0", ".", 2, 3)]),
    ("ATAC", ["*TAC"], NORM, [(0, "AT", ("T",), "1", "PASS", 0, 2)]),
    ("A", ["*"], NORM, [(0, "A", (".",), "0", ".", 0, 1)]),
    ("ACT***GCT", ["ACTAAAGCT"], NORM, [(2, "T", ("TAAA",), "1", "PASS", 2, 6)]),
    ("CCTAG***********TATTATT", ["CCTAG*********TT*CTTATT"], NORM, [(6, "A", ("TC",), "1", "PASS", 4, 18)]),
    ("CCTAG************TTATTATT", ["CCTAG*********TT**T*TTATT", "CCTAG*********T*AT*ATTATT"], BOTH, [(6, "TA", ("ATA", "TT"), "1/2", "PASS", 4, 20)]),
    ("ANTG", ["AGTG", "ACTG"], N, []),
    ("ANTG", ["AGTG", "ACTG"], {"ambiguous": True}, [(1, "N", ("C", "G"), "1/2", "PASS", 1, 2)]),
    ("ANTG", ["AGTG", "ACAG"], N, [(2, "T", ("A",), "0/1", "PASS", 2, 3)]),
    ("ANTG", ["AGTG", "ACAG"], {"ambiguous": True}, [(1, "NT", ("CA", "GT"), "1/2", "PASS", 1, 3)]),
    ("AAGCCATTACA", ["A*******ACA"] * 2, N, [(1, "AGCCATT", (".",), "0", ".", 1, 8)]),
    ("AAGCCATTACA", ["A*******ACA"] * 2, NORM, [(0, "AAGCCATT", ("A",), "1/1", "PASS", 0, 8)]),
    ("AAGCCATTACA", ["A*******ACA"] * 2, NORM | {"min_quality": 80.0}, [(0, "AAGCCATT", ("A",), "1/1", "LowQual", 0, 8)]),
    ("AGCCATTACA", ["*******ACA"] * 2, NORM, [(0, "AGCCATTA", ("A",), "1/1", "PASS", 0, 8)]),
    ("ANNNNNAGCCATTACA", ["A************ACA"] * 2, NORM, [(6, "AGCCATTA", ("A",), "1/1", "PASS", 6, 14)]),
    ("ANNNNNAGCCATTACA", ["A************ACA"] * 2, NORM | {"ambiguous": True}, [(0, "ANNNNNAGCCATT", ("A",), "1/1", "PASS", 0, 13)]),
    ("NNNNNAGCCATTACA", ["************ACA"] * 2, NORM | {"ambiguous": True}, [(0, "NNNNNAGCCATTA", ("A",), "1/1", "PASS", 0, 13)]),
    (DIPLOID, ["ACC*A***AA", "ACC*ACC*A*"], N, [(3, "A", (".",), "0", ".", 3, 4), (5, "AA", (".",), "0", ".", 5, 8), (8, "A", (".",), "0", ".", 9, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*ACC*A*"], NORM, [(2, "CA", ("C",), "1/1", "PASS", 2, 4), (4, "AAA", ("A", "ACC"), "1/2", "PASS", 4, 8), (7, "AA", ("A",), "0/1", "PASS", 8, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*ACC*A*"], BOTH, [(4, "AAAA", ("A", "CC"), "1/2", "PASS", 2, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*AAC*A*"], NORM, [(2, "CA", ("C",), "1/1", "PASS", 2, 4), (4, "AAA", ("A", "AAC"), "1/2", "PASS", 4, 8), (7, "AA", ("A",), "0/1", "PASS", 8, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*AAC*A*"], BOTH, [(4, "AAAA", ("A", "AC"), "1/2", "PASS", 2, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*AAA*A*"], NORM, [(2, "CA", ("C",), "1/1", "PASS", 2, 4), (4, "AAA", ("A",), "0/1", "PASS", 4, 8), (7, "AA", ("A",), "0/1", "PASS", 8, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*AAA*A*"], NORM | {"merge_adjacent": True}, [(2, "CAAA", ("C", "CA"), "1/2", "PASS", 2, 10)]),
    (DIPLOID, ["ACC*A***AA", "ACC*AAA*A*"], BOTH, [(2, "CAAA", ("C", "CA"), "1/2", "PASS", 2, 10)]),
    ("T*****TCCCATT*****AGCAATCACC", ["T*****************AGCAATCACC", "T*****TCCCATT*****AGCAATCACC"], BOTH, [(0, "TTCCCATT", ("T",), "0/1", "PASS", 0, 18)]),
]


@pytest.mark.parametrize("haploid", [True, False])
def test_known_variants(spark, haploid):
    """All cases of one set of options at once, each a key of its own."""
    by_options = {}
    for n, (ref, haps, options, want) in enumerate(CASES):
        if (len(haps) == 1) == haploid:
            by_options.setdefault(tuple(sorted({"normalize": False, **options}.items())), {})[str(n)] = (ref, haps, want)
    for options, cases in by_options.items():
        out = V.call_variants(columns(spark, {k: c[:2] for k, c in cases.items()}), ["k"], **dict(options)).collect()
        for k, (_, _, want) in cases.items():
            got = sorted((r.pos, r.ref, tuple(r.alts), r.gt, r.filter, r.rstart, r.rend) for r in out if r.k == k)
            assert got == sorted(want), (k, options)


def random_cases(rng, n):
    cases = {}
    for k in range(n):
        ref = "A" + "".join(rng.choice("AACT**") for _ in range(rng.randint(5, 60)))
        haps = ["".join(r if rng.random() < 0.8 else rng.choice("ACT*") for r in ref) for _ in range(2)]
        cases[str(k)] = (ref, haps)
    return cases


def applied(ref, variants, hap):
    """The haplotype's bases as the variants (pos, ref, haplotype's alleles) say."""
    out, at = "", 0
    for pos, old, alleles in sorted(variants):
        assert ref[pos : pos + len(old)] == old and pos >= at
        out += ref[at:pos] + alleles[hap]
        at = pos + len(old)
    return out + ref[at:]


def test_variants_rebuild_haplotypes(spark):
    """Applied to the draft, merged variants give the called haplotypes back."""
    cases = random_cases(random.Random(3), 60)
    got = V.call_variants(columns(spark, cases), ["k"], merge_overlapping=True, merge_adjacent=True).collect()
    assert len(got) > 100
    for k, (ref, haps) in cases.items():
        mine = [r for r in got if r.k == k]
        if any(r.gt == "0" for r in mine):
            continue
        # phase isn't kept in gt, so each variant must offer alleles that one order puts right
        draft = ref.replace("*", "")
        ends = [r.pos + len(r.ref) for r in sorted(mine, key=lambda r: r.pos)]
        assert all(b.pos >= e for b, e in zip(sorted(mine, key=lambda r: r.pos)[1:], ends, strict=False))
        from itertools import product

        choices = [[[([r.ref, *r.alts])[int(x)] for x in order] for order in {tuple(r.gt.split("/")), tuple(reversed(r.gt.split("/")))}] for r in mine]
        if len(choices) <= 8:
            want = [h.replace("*", "") for h in haps]
            assert any([applied(draft, [(r.pos, r.ref, c) for r, c in zip(mine, pick, strict=True)], h) for h in (0, 1)] == want for pick in product(*choices)), (ref, haps)


def test_joined_samples_dont_move_variants(spark):
    """Cuts at other columns give the same variants, though some lie across many samples."""
    cases = random_cases(random.Random(5), 30)
    cases["all"] = ("ACCT", ["GGGG", "TTTT"])
    whole = V.call_variants(columns(spark, cases), ["k"], normalize=False)
    keep = lambda df: sorted((r.k, r.pos, r.ref, tuple(r.alts), r.gt) for r in df.collect())
    want = keep(whole)
    for width in (1, 2, 5, 9):
        cut = columns(spark, cases, lambda k, i, w=width: i // w)
        for tile in (3, 1 << 20):
            joined = V.join_samples(cut, ["k"], tile)
            assert joined.count() == cut.count()
            assert keep(V.call_variants(joined, ["k"], normalize=False)) == want


def test_join_samples_by_hand(spark):
    """Splits before the last calm major column; a gap in the positions begins a sample."""
    rows = [("k", s, m, n, r, [c], [0.0], 0.0) for s, m, n, r, c in [(0, 0, 0, "A", "A"), (0, 1, 0, "C", "C"), (0, 2, 0, "G", "T"), (1, 3, 0, "G", "T"), (1, 3, 1, "*", "A"), (2, 4, 0, "A", "C"), (2, 5, 0, "A", "A"), (3, 9, 0, "T", "T"), (3, 10, 0, "T", "G")]]
    out = V.join_samples(spark.createDataFrame(rows, SCHEMA), ["k"]).orderBy("major", "minor").collect()
    assert [tuple(r.sample) for r in out] == [(0, 0), (1, 0), (1, 0), (1, 0), (1, 0), (1, 0), (5, 0), (9, 0), (9, 0)]


def test_reference_rows_tile_each_position(spark):
    cases = random_cases(random.Random(8), 20)
    cols = columns(spark, cases)
    found = V.call_variants(cols, ["k"], merge_overlapping=True, merge_adjacent=True)
    rest = V.reference_rows(cols, ["k"], found)
    seen = sorted([(r.k, p) for r in found.collect() for p in range(r.pos, r.pos + len(r.ref))] + [(r.k, r.pos) for r in rest.collect()])
    assert seen == sorted((k, p) for k, (ref, _) in cases.items() for p in range(len(ref.replace("*", ""))))
    every = {r.pos: r for r in V.reference_rows(columns(spark, {"x": ("ACTGA", ["ACAGA"])}), ["k"]).collect()}
    assert [(every[p].ref, every[p].qual, every[p].gt, every[p].gq, every[p].filter, every[p].alts) for p in range(5)] == [(b, q, "0", int(q), ".", ["."]) for b, q in zip("ACTGA", (70.0, 70.0, 0.0, 70.0, 70.0), strict=True)]


def test_columns_from_probabilities(spark):
    """Argmax per haplotype, ties to the first symbol, N takes the gap's probability."""
    rows = [("c", 0, 2, 0, h, s, p) for h, ps in ((0, (0.1, 0.2, 0.5, 0.1, 0.1)), (1, (0.4, 0.4, 0.1, 0.05, 0.05))) for s, p in zip("*ACGT", ps, strict=True)]
    rows += [("c", 0, 3, 0, h, s, p) for h in (0, 1) for s, p in zip("*ACGT", (0.7, 0.3, 0.0, 0.0, 0.0), strict=True)]
    got = {r.major: r for r in V.columns_of(spark.createDataFrame(rows, "k string, sample int, major bigint, minor bigint, hap int, symbol string, prob float"), spark.createDataFrame([("c", "ACCNT")], "k string, draft string"), ["k"]).withColumn("p", F.exp("ref_logp")).collect()}
    assert (got[2].ref, got[2].calls, round(got[2].p, 6)) == ("C", ["C", "*"], 0.5)
    assert (got[3].ref, got[3].calls, round(got[3].p, 6)) == ("N", ["*", "*"], 0.7)
    assert V.call_variants(columns(spark, {"a": ("ACG", ["ACG"])}).where("false"), ["k"]).count() == 0


def trimmed(spark, samples, **options):
    """samples: for each its list of (major, minor)."""
    rows = [("k", n, m, i) for n, cols in enumerate(samples) for m, i in cols]
    out = V.trim_samples(spark.createDataFrame(rows, "k string, sample int, major bigint, minor bigint"), ["k"], **options).orderBy("sample").collect()
    return [(r.relation, r.start, r.end, r.differing) for r in out]


def test_trim_samples(spark):
    plain = lambda a, b: [(m, 0) for m in range(a, b)]
    assert trimmed(spark, [plain(0, 10), plain(6, 20), plain(7, 12), plain(20, 25), plain(30, 31)]) == [("first", 0, 8, False), ("overlap", 2, 14, False), ("within", None, None, False), ("abut", 0, 5, False), ("gap", 0, 1, False)]
    # odd overlaps: the later sample keeps the middle column
    assert trimmed(spark, [plain(0, 9), plain(6, 12)]) == [("first", 0, 7, False), ("overlap", 1, 6, False)]
    # inserted columns that both have are cut like others, and a sample may go on within a major
    a, b = [*plain(0, 6), (5, 1), (5, 2), (6, 0)], [(4, 0), (5, 0), (5, 1), (5, 2), (6, 0), (7, 0)]
    assert trimmed(spark, [a, b]) == [("first", 0, 6, False), ("overlap", 2, 6, False)]
    assert trimmed(spark, [[(0, 0), (1, 0)], [(1, 1), (2, 0)], [(2, 2), (3, 0)]]) == [("first", 0, 2, False), ("abut", 0, 2, False), ("gap", 0, 2, False)]


def test_trim_samples_that_differ(spark):
    left = [(m, i) for m in range(0, 12) for i in range(1 + (m == 9))]
    right = [(m, 0) for m in range(4, 16)]
    assert trimmed(spark, [left, right]) == [("first", 0, 13, False), ("overlap", 0, 12, True)]
    # majors 4 to 11, middle 7; 8 is the nearest other one with one column in both
    assert trimmed(spark, [left, right], search=True) == [("first", 0, 8, False), ("overlap", 4, 12, True)]
    assert trimmed(spark, [left, right], search=True, region=(2, 6)) == [("first", 2, 6, False), ("overlap", None, None, True)]
    # too few majors in common
    assert trimmed(spark, [[(0, 0), (1, 0), (1, 1), (2, 0)], [(1, 0), (2, 0), (3, 0)]], search=True) == [("first", 0, 4, False), ("overlap", 0, 3, True)]


@pytest.mark.parametrize("limit", [1, 5, 23, 10_000])
def test_greedy_batches(spark, limit):
    from seqloom.operators import intervals

    rng = random.Random(limit)
    rows = [(k, i * 3, rng.choice([0, 0, 1, 2, 9, 40, None])) for k in "ab" for i in range(90)]
    want = {}
    for k in "ab":
        held, batch = 0, 0
        for _, i, n in [r for r in rows if r[0] == k]:
            want[k, i] = batch
            held += n or 0
            if held >= limit:
                held, batch = 0, batch + 1
    df = spark.createDataFrame(rows, "k string, i int, n int")
    for width in (7, 1 << 20):
        assert {(r.k, r.i): r.batch for r in intervals.greedy_batches(df, ["k"], ["i"], "n", limit, width).collect()} == want
    assert intervals.greedy_batches(df.where("false"), ["k"], ["i"], "n", limit).count() == 0


def test_quality_takes_in_an_appended_base(spark):
    """A deletion at the very start takes the next base, whose probability counts."""
    rows = [("x", 0, i, 0, r, [c, r], [-0.1, -0.2 * (i + 1)], 0.0) for i, (r, c) in enumerate(zip("CAAC", "*AAC", strict=True))]
    got = V.call_variants(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()
    assert [(r.pos, r.ref, r.alts, r.rend) for r in got] == [(0, "CA", ["A"], 2)]
    # -0.1 - 0.2 of the first column, -0.1 - 0.4 of the second
    assert got[0].qual == pytest.approx(2.59, abs=0.002)


MEETING = [("A*C*CC*", ["**C*CCC", "A*C*ACC"]), ("AA*CACC", ["*A*ACC*", "*A*CACC"]), ("A*C*CC**", ["CAC*CC**", "**C*AC*C"]), ("A*A*AA**C", ["CAA*AA**C", "**A*CA*AC"])]


def test_merged_variants_never_meet(spark):
    """A merged variant that reaches back over a base the one before it took is merged with that too."""
    cases = {str(k): c for k, c in enumerate(MEETING)}
    got = V.call_variants(columns(spark, cases), ["k"], merge_overlapping=True, merge_adjacent=True).collect()
    for k, (ref, haps) in cases.items():
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.pos)
        assert mine and all(b.pos >= a.pos + len(a.ref) for a, b in zip(mine, mine[1:], strict=False)), (ref, haps)
        assert len(mine) == 1
        draft = ref.replace("*", "")
        alleles = [mine[0].ref, *mine[0].alts]
        built = {draft[: mine[0].pos] + alleles[int(x)] + draft[mine[0].pos + len(mine[0].ref) :] for x in mine[0].gt.split("/")}
        assert built == {h.replace("*", "") for h in haps}
