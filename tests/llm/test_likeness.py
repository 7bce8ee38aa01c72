import random

from test_llm import closure, prose

from seqloom.llm import likeness


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    one, two = sets
    return len(one & two) / len(one | two) if one | two else 1.0


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def agrees(spark, texts):
    got = {r.doc_id: r.component_id for r in likeness.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 5, 0.8).collect()}
    n = len(texts)
    pairs = [(a, b, jaccard(texts[a], texts[b])) for a in range(n) for b in range(a + 1, n)]
    assert [got[i] for i in range(n)] == closure(n, [(a, b) for a, b, j in pairs if j >= 0.8])
    return pairs


def test_only_pairs_at_the_bar_join(spark):
    rng = random.Random(3)
    base = [prose(rng, 200) for _ in range(12)]
    near = [edited(rng, t, n) for t in base for n in (2, 4, 6, 9)]
    repeats = [" ".join(["again"] * 300 + prose(rng, 30).split()) for _ in range(4)]
    pairs = agrees(spark, [*base, *near, *repeats, "again", "", " \n", "two words", "Two  words"])
    assert any(0.6 < j < 0.8 for _, _, j in pairs) and any(0.8 <= j < 0.9 for _, _, j in pairs)


def test_lone_pairs_at_the_bar_are_found(spark):
    rng = random.Random(5)
    base = [prose(rng, 150) for _ in range(60)]
    pairs = agrees(spark, [*base, *(edited(rng, t, 3) for t in base)])
    assert sum(0.8 <= j < 0.83 for _, _, j in pairs) >= 20
