"""Candidate overlaps by blocks: what is read once, and equal results by plainer ways."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_overlaps import TURN, plain_minimizers

from seqloom.operators import overlaps as O

FIELDS = "score anchors a_start a_end b_start b_end".split()


def reads(rng, n, genome, size=500):
    out = []
    for i in range(n):
        at = rng.randrange(len(genome) - size)
        read = "".join(c if rng.random() > 0.01 else rng.choice("ACGT") for c in genome[at : at + size])
        out.append(read.translate(TURN)[::-1] if i % 3 == 0 else read)
    return out


def plain_overlaps(texts, k, w, min_score, min_occ, max_occ, gap=5000, band=150, back=64):
    """Every pair's anchors in a dict, chains one anchor at a time; the texts are distinct."""
    at = {}
    for id_, t in texts:
        for pos, h, reverse in plain_minimizers(t, k, w):
            at.setdefault(h, []).append((id_, pos, reverse))
    most = O._cut({n: [len(v) for v in at.values()].count(n) for n in {len(v) for v in at.values()}}, 0.0002, min_occ, max_occ)
    pairs = {}
    for met in at.values():
        for a, x, r in met if 2 <= len(met) <= most else ():
            for b, y, q in met:
                if a < b:
                    pairs.setdefault((a, b, r != q), []).append((x, -y if r != q else y))
    out = set()
    for (a, b, turned), points in pairs.items():
        points.sort()
        done, best = [], (0,)
        for i, (x, y) in enumerate(points):
            top, state = (k, -1), (k, 1, x, y)
            for j in range(max(0, i - back), i):
                dx, dy = x - points[j][0], y - points[j][1]
                off = abs(dx - dy)
                gain = done[j][0] + min(k, dx, dy) - off * k // 100 - off.bit_length() // 2
                if 0 < dx <= gap and 0 < dy <= gap and off <= band and gain > k and (gain, j) >= top:
                    top, state = (gain, j), (gain, done[j][1] + 1, *done[j][2:4])
            done.append(state)
            if state[0] > best[0]:
                best = (*state, x, y)
        s, n, sx, sy, ex, ey = best
        if s >= min_score:
            out.add((a, b, turned, s, n, sx, ex + k, -ey if turned else sy, (-sy if turned else ey) + k))
    return out


def found(df):
    return {(r.a, r.b, r.reverse, *[r[f] for f in FIELDS]) for r in df.collect() if r.score is not None}


def test_texts_are_made_once(spark):
    """Before, each branch of the plan made the texts anew: four times."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rng = random.Random(1)
    texts = reads(rng, 20, "".join(rng.choices("ACGT", k=1500)))
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "id int, seq string").mapInPandas(count, "id int, seq string")
    assert len(O.overlaps(df, "id", "seq", 15, 5, min_score=60).collect()) > 20
    assert seen.value == 21


def test_spelled_is_translate_and_is_made_once(spark):
    seen = "áé,a b.cABCxyz\U0001f600Z "
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([seen, seen, "", "", None, None, "acgt"])], "id int, text string")
    out = rows.withColumn("got", O.spelled("abcABC .,", "ACGTNC")("text", F.col("id") % 2 == 1))
    dna = F.translate("text", "abcABC .,", "ACGTNC")
    out = out.withColumn("due", F.when(F.col("id") % 2 == 1, F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))).otherwise(dna))
    assert all(r.got == r.due for r in out.collect())
    plan = out.where("got IS NOT NULL").select("id", "got")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_overlaps_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(2)
    genome = "".join(rng.choices("ACGT", k=3000))
    texts = reads(rng, 40, genome + genome[500:1200])
    texts += ["é" + texts[0][:300], texts[1][:200] + "N" * 30 + texts[2][100:], "ACG", ""]
    due = plain_overlaps(list(enumerate(texts)), 15, 5, 60, 10, 1000)
    assert len(due) > 60
    df = spark.createDataFrame([(i - 9, t) for i, t in enumerate(texts)], "id int, seq string")
    got = O.overlaps(df, "id", "seq", 15, 5, min_score=60)
    assert dict(got.dtypes)["a"] == "int"
    assert found(got) == {(a - 9, b - 9, *rest) for a, b, *rest in due}
    # ids that are texts keep their order
    names = spark.createDataFrame([(f"r{i:02}", t) for i, t in enumerate(texts)], "id string, seq string").repartition(3)
    monkeypatch.setattr(O, "BUCKETS", 3)
    assert found(O.overlaps(names, "id", "seq", 15, 5, min_score=60)) == {(f"r{a:02}", f"r{b:02}", *rest) for a, b, *rest in due}


def test_too_frequent_seeds_count_but_join_nothing(spark):
    """30 texts share a stretch and ten more share it twice: beyond max_occ; two also share another."""
    rng = random.Random(3)
    hot, own = ("".join(rng.choices("ACGT", k=300)) for _ in range(2))
    texts = [hot + "".join(rng.choices("ACGT", k=80 + i)) for i in range(30)] + [hot + "N" + hot + "".join(rng.choices("ACGT", k=80 + i)) for i in range(10)]
    texts[3] += own
    texts[7] += own
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string").repartition(5)
    got = found(O.overlaps(df, "id", "seq", 15, 5, min_score=60, min_occ=2, max_occ=10))
    assert got == plain_overlaps(list(enumerate(texts)), 15, 5, 60, 2, 10)
    assert {r[:3] for r in got} == {(3, 7, False)}


def test_minimizers_of_a_batch(monkeypatch):
    rng = random.Random(4)
    texts = ["", "ACG", "é", "ACGT" * 30, "A" * 90, "N" * 50, "".join(rng.choices("ACGT", k=700)), "".join(rng.choices("ACGTNé", weights=[8, 8, 8, 8, 1, 1], k=700)), "ACGTTGCAACG", "", "é" * 3 + "".join(rng.choices("AC", k=60)), "ac\U0001f600" + "acgtgta" * 9, ""]
    for group, piece in ((1 << 17, 1 << 20), (100, 1 << 20), (100, 400), (1, 50)):
        monkeypatch.setattr(O, "GROUP", group)
        monkeypatch.setattr(O, "PIECE", piece)
        for k, w in ((3, 4), (8, 5), (15, 10), (1, 1), (4, 20)):
            for part in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array(texts[:3]), pa.array([], pa.string())):
                got = [[] for _ in range(len(part))]
                for lines, at, h, back in O._scanned(part, k, w):
                    for i, *rest in zip(lines, at, h.view(np.uint64), back):
                        got[i].append(tuple(rest))
                assert got == [plain_minimizers(t.as_py().upper(), k, w) for t in part]


def test_pairs_that_may_chain():
    """No pair whose chain reaches the score is left out; strewn anchors are."""
    rng = random.Random(5)
    pairs = []
    for n in range(120):
        dots = {(rng.randrange(3000), rng.randrange(-3000, 3000)) for _ in range(n % 40 + 1)}
        at, y = rng.randrange(900), rng.randrange(-900, 900)
        pairs.append(sorted(dots | {(at + i * 9, y + i * 9 + i // 3) for i in range(n % 17)}))
    number = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    x, y = np.array([d for p in pairs for d in p]).T
    fits = O.may_chain(number, x, y, 15, 40, 80)
    scores = O.best_chains([np.array([d[0] for d in p]) for p in pairs], [np.array([d[1] for d in p]) for p in pairs], 15, 5000, 40, 64)[:, 0]
    assert len(fits) == len(pairs) and all(fits[scores >= 80]) and (scores >= 80).sum() > 20
    assert (~fits).sum() > 30
    assert len(O.may_chain(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 15, 40, 80)) == 0
