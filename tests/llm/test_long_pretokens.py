from decimal import Decimal, getcontext

import pytest

from seqloom.llm import token_counts


def plain(u, word):
    """A unigram DP in decimals, which don't underflow."""
    best, total = [(Decimal(1), 0)], [Decimal(1)]
    for i in range(1, len(word) + 1):
        ways = [(j, Decimal(p)) for j in range(max(0, i - u.longest), i) if (p := u.prob.get(word[j:i])) is not None]
        top = max(best[j][0] * p for j, p in ways)
        best.append((top, min(best[j][1] + 1 for j, p in ways if best[j][0] * p >= top * (1 - Decimal("1e-12")))))
        total.append(sum(total[j] * p for j, p in ways))
    return best[-1][1], float(best[-1][0].ln()), float(total[-1].ln())


@pytest.mark.parametrize("text", ["今日は天気がいいから散歩しましょう" * 60, "=" * 2000, "antidisestablishment" * 40, "x" * 47 + "é"])
def test_long_pretokens_are_scored_whole(text):
    getcontext().prec = 40
    u = token_counts.Unigram.from_file(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    word = text.encode()
    assert u.runs(word) == [word]
    (runs, tokens, best, total), = u.count([word])
    n, top, mass = plain(u, word)
    assert (runs, tokens) == (1, n) and best == pytest.approx(top) and total == pytest.approx(mass)
