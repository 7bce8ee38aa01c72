import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.operators import fuzzy, superkmers
from seqloom.session import shared_dir


def _bytes(top):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def _brute(texts, k, top, least):
    sets = {i: {t[p : p + k] for p in range(len(t) - k + 1)} for i, t in texts}
    counts = {}
    for s in sets.values():
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    most = sorted(counts.values(), reverse=True)[int(len(counts) * top)]
    good = {g for g, n in counts.items() if 2 <= n <= most}
    ids = sorted(sets)
    met = [(a, b, len(sets[a] & sets[b] & good)) for a in ids for b in ids if a < b]
    return sorted(m for m in met if m[2] >= least)


def test_each_kmer_is_in_one_stretch_and_equal_ones_share_a_bucket():
    rng = random.Random(3)
    texts = ["a" * 1000, "".join(rng.choice("abc \U0001f600") for _ in range(5000)), "x" * 24, "short"]
    seen = {}
    for t in texts:
        places = []
        for start, end, bucket in superkmers.stretches_of(t, 24, 8):
            for a, b, c in zip(start, end, bucket):
                assert b - a - 23 <= superkmers.LONGEST
                for p in range(a, b - 23):
                    places.append(p)
                    assert seen.setdefault(t[p : p + 24], c) == c
        assert places == list(range(max(0, len(t) - 23)))


def test_kmer_pairs_as_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd é") for _ in range(60)) for _ in range(30)]
    texts = [(i, "".join(rng.choice(parts) for _ in range(4))) for i in range(60)] + [(60, "tiny"), (61, "")]
    got = fuzzy.kmer_pairs(spark.createDataFrame(texts, "id long, text string"), "id", "text", 12, 0.02, 20).where("shared IS NOT NULL")
    assert sorted(tuple(r) for r in got.collect()) == _brute(texts, 12, 0.02, 20)


def test_kmer_pairs_keeps_less_on_disk_than_its_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(2000)]
    before = _bytes(shared_dir(spark))
    out = fuzzy.kmer_pairs(spark.createDataFrame(texts, "id long, text string"), "id", "text", 24, 0.0002, 40)
    assert _bytes(shared_dir(spark)) - before < sum(len(t) for _, t in texts)
    assert out.where(F.col("a") >= F.col("b")).isEmpty()


def _shuffled(spark):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_kmer_pairs_shuffles_blocks_and_not_stretches(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(300)]
    texts = [(i, lines[rng.randrange(300)] + "".join(rng.choice("xyz") for _ in range(5))) for i in range(1000)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2)
    before = _shuffled(spark)
    fuzzy.kmer_pairs(docs, "id", "text", 24, 0.0002, 40).count()
    records = sum(n for stage, n in _shuffled(spark).items() if stage not in before)
    # a text has about 80 stretches
    assert 0 < records < 20 * len(texts)


def test_hashes_tell_blocks_in_another_order_apart():
    rng = random.Random(13)
    blocks = ["".join(rng.choice("abcdefgh \xe9") for _ in range(4)) for _ in range(12)]
    grams = sorted({"".join(rng.choice(blocks) for _ in range(6)) for _ in range(20000)})
    letters = np.frombuffer("".join(grams).encode("latin-1"), np.uint8)
    for k in (24, 12, 7, 3):
        found = superkmers._hashes(letters, k, np.uint64)[::24]
        assert len(set(found.tolist())) == len({g[:k] for g in grams})
        wide = superkmers._hashes(letters.astype(np.uint32), k, np.uint64, np.arange(0, len(letters) - 23, 24))
        assert (found == wide).all()


def test_kmer_pairs_of_texts_of_any_letters_and_ids(spark):
    rng = random.Random(17)
    blocks = ["".join(rng.choice(letters) for _ in range(8)) for letters in ("abcd", "ab\xe9\xfc", "a\u0142\u4e2d", "b\U0001f600\U0001f601") for _ in range(3)]
    texts = [(i - 30, "".join(rng.choice(blocks) for _ in range(12))) for i in range(60)]
    expected = _brute(texts, 24, 0.01, 3)
    assert expected
    for kind, name in (("long", lambda i: i), ("int", lambda i: i), ("string", lambda i: f"t{i + 100:04d}")):
        rows = [(name(i), t) for i, t in texts]
        rows += [rows[0], (None, "x" * 50), (name(400), None), (name(401), rows[5][1]), (name(402), "short")]
        got = fuzzy.kmer_pairs(spark.createDataFrame(rows, f"id {kind}, text string"), "id", "text", 24, 0.01, 3).collect()
        assert sorted(tuple(r) for r in got if r["shared"] is not None) == [(name(a), name(b), n) for a, b, n in expected]
        assert [(r["a"], r["b"]) for r in got if r["shared"] is None] == [(rows[5][0], name(401))]


def test_scanned_texts_are_cut_as_each_by_itself(monkeypatch):
    monkeypatch.setattr(superkmers, "PIECE", 300)
    monkeypatch.setattr(superkmers, "GROUP", 500)
    rng = random.Random(19)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n, letters in ((40, "ab"), (23, "ab"), (24, "ab"), (1000, "abc\xe9"), (90, "ab\u4e2d"), (200, "a"), (0, "a"), (10, "a"), (170, "xyz"), (301, "abcdef"))]
    seen = {}
    for code, line, start, n, least in superkmers._scanned(pa.array(["left out"] + texts).slice(1), 24, 8):
        for i, s, c, h in zip(line.tolist(), start.tolist(), n.tolist(), least.tolist()):
            for p in range(s, s + c):
                seen.setdefault(i, []).append(("".join(map(chr, code[p : p + 24])), h))
    for i, t in enumerate(texts):
        assert [g for g, _ in seen.get(i, [])] == [t[p : p + 24] for p in range(len(t) - 23)]
    hashes = {}
    assert all(hashes.setdefault(g, h) == h for grams in seen.values() for g, h in grams)


def test_kmers_of_a_large_part_go_by_shares(monkeypatch):
    rng = random.Random(23)
    pieces = ["".join(rng.choice("abc") for _ in range(30)) for _ in range(40)]
    for shift in (0, -7, 1 << 60):
        rows = [(rng.randrange(25) + shift, rng.choice(pieces)[: rng.randrange(12, 31)]) for _ in range(300)]
        texts = {}
        for i, t in rows:
            for p in range(len(t) - 11):
                texts.setdefault(t[p : p + 12], set()).add(i)
        expected = sorted(sorted(s) for s in texts.values() if len(s) > 1)
        code = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
        n, ids = np.array([len(t) - 11 for _, t in rows]), np.array([i for i, _ in rows])
        for sorted_ in (1 << 19, 500):
            monkeypatch.setattr(superkmers, "SORTED", sorted_)
            monkeypatch.setattr(superkmers, "CHUNK", 1000)
            parts = list(superkmers._once(code, n, ids, 12))
            assert len(parts) == -(-int(n.sum()) // sorted_)
            assert sum(p[0] for p in parts) == sum(len(s) == 1 for s in texts.values())
            lists = [m.tolist() for p in parts for m in np.split(p[1], np.cumsum(p[2])[:-1])]
            assert sorted(m for m in lists if m) == expected


def test_pairs_of_long_lists_and_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(superkmers, "PAIRS", 50)
    for n in (2, 5, 7, 8, 60):
        lines, same = np.arange(3 * n).reshape(3, n), np.array([1, 2, 3])
        parts = list(superkmers._pairs(lines, same))
        got = sorted(zip(*[np.concatenate(c).tolist() for c in zip(*parts)]))
        assert got == [(a, b, w + 1) for w in range(3) for a in range(w * n, w * n + n) for b in range(a + 1, w * n + n)]
    a, b, same = np.array([1, 2, 1, 2, 1]), np.array([5, 6, 5, 7, 5]), np.array([1, 1, 1, 1, 1])
    monkeypatch.setattr(superkmers, "_mixed", lambda h: np.zeros(len(h), np.uint64))
    _, a, b, same = superkmers._summed(a, b, same)
    assert list(zip(a.tolist(), b.tolist(), same.tolist())) == [(1, 5, 3), (2, 6, 1), (2, 7, 1)]
