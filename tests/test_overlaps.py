"""Minimizers and chains against plain computations, recall on made overlaps."""

import random

import numpy as np

from seqloom.operators import overlaps as O

TURN = str.maketrans("ACGT", "TGCA")


def value(kmer):
    n = 0
    for c in kmer:
        n = 4 * n + "ACGT".index(c)
    return n * O.MIX % 2**64


def plain_minimizers(text, k, w):
    out = {}
    hashes = []
    for i in range(len(text) - k + 1):
        kmer = text[i : i + k]
        turned = kmer.translate(TURN)[::-1]
        fine = set(kmer) <= set("ACGT") and kmer != turned
        hashes.append((min(value(kmer), value(turned)), value(turned) < value(kmer)) if fine else None)
    for s in range(max(1, len(hashes) - w + 1) if hashes else 0):
        seen = [(hashes[i][0], i) for i in range(s, min(s + w, len(hashes))) if hashes[i]]
        if seen:
            h, i = min(seen)
            out[i] = (h, hashes[i][1])
    return [(i, *out[i]) for i in sorted(out)]


def test_minimizers_of_texts_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = ["", "ACG", "ACGT" * 30, "A" * 90, "N" * 50, "".join(rng.choices("ACGT", k=700)), "".join(rng.choices("ACGTN", weights=[8, 8, 8, 8, 1], k=700)), "".join(rng.choices("ACGT", k=9)), "é" + "".join(rng.choices("AC", k=60))]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(O, "PIECE", piece)
        for k, w in ((3, 4), (8, 5), (15, 10), (1, 1)):
            for t in texts:
                at, h, back = O.minimizers_of(t, k, w)
                assert list(zip(at, h.view(np.uint64), back)) == plain_minimizers(t, k, w)


def test_chains_of_a_batch():
    rng = random.Random(6)
    pairs = []
    for n in (1, 2, 30, 80, 79):
        pairs.append(sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(n)} | {(i * 9, i * 9 + i // 3) for i in range(n)}))
    got = O.best_chains([np.array([p[0] for p in a]) for a in pairs], [np.array([p[1] for p in a]) for a in pairs], 11, 200, 40, 16)
    for a, found in zip(pairs, got):
        done, best = [], (0,)
        for i, (x, y) in enumerate(a):
            state = (11, 1, x, y)
            top = (11, -1)
            for j in range(max(0, i - 16), i):
                dx, dy = x - a[j][0], y - a[j][1]
                off = abs(dx - dy)
                gain = done[j][0] + min(11, dx, dy) - off * 11 // 100 - off.bit_length() // 2
                if 0 < dx <= 200 and 0 < dy <= 200 and off <= 40 and gain > 11 and (gain, j) >= top:
                    top, state = (gain, j), (gain, done[j][1] + 1, *done[j][2:4])
            done.append(state)
            if state[0] > best[0]:
                best = (*state, x, y)
        assert tuple(found) == best


def test_overlaps_find_noisy_pairs_of_both_strands(spark):
    """Recall against all pairs that overlap by 400 bases or more: at least 0.9; no pair of strangers."""
    rng = random.Random(7)
    genome = "".join(rng.choices("ACGT", k=12000))
    rows, spans = [], {}
    for i in range(60):
        start, size = rng.randrange(11000), rng.randrange(700, 1400)
        read = [c if rng.random() > 0.02 else rng.choice(["", "A", "CC", "G", "T"]) for c in genome[start : start + size]]
        read = "".join(read)
        rows.append((i, read.translate(TURN)[::-1] if i % 2 else read))
        spans[i] = (start, min(start + size, len(genome)))
    rows += [(100, "".join(rng.choices("ACGT", k=900))), (101, rows[0][1]), (102, None), (None, rows[0][1]), (103, ""), (104, "ACG")]
    got = O.overlaps(spark.createDataFrame(rows, "id int, seq string"), "id", "seq", k=15, w=5, min_score=60).collect()
    pairs = {(r.a, r.b): r for r in got if r.score is not None}
    assert [(r.a, r.b) for r in got if r.score is None] == [(0, 101)]
    assert not {100, 102, 103, 104} & {i for p in pairs for i in p}
    shared = {(a, b): min(spans[a][1], spans[b][1]) - max(spans[a][0], spans[b][0]) for a in spans for b in spans if a < b}
    due = [p for p, n in shared.items() if n >= 400]
    assert len(due) > 50 and sum(p in pairs for p in due) >= 0.9 * len(due)
    assert all(shared[p] > 0 for p in pairs)
    assert all(r.reverse == bool((r.a + r.b) % 2) and 0 <= r.b_start < r.b_end for r in pairs.values())


def test_frequent_seeds_are_cut(spark):
    counts = spark.createDataFrame([(h, n) for h, n in enumerate([2] * 90 + [5] * 9 + [5000])], "hash int, n long")
    assert O.cut_off(counts, 0.02, 2, 10_000) == 5
    assert O.cut_off(counts, 0.001, 2, 1000) == 1000
    assert O.cut_off(counts, 0.5, 10, 1000) == 10
    assert O.cut_off(counts.limit(0), 0.5, 10, 1000) == 1000
    empty = spark.createDataFrame([], "id int, seq string")
    assert O.overlaps(empty, "id", "seq").collect() == []
