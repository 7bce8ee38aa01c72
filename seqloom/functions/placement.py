"""Semi-global placement of a pattern in a text, for a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wildcards of a pattern and what they stand for.
WILD = {"N": "ACGT", "V": "ACG", "M": "AC"}


def _distances(patterns: list[str], texts: list[str], anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(least edits of each pattern against any stretch of its text, end of the leftmost such stretch).

    anchored: only stretches from the text's start count.

    Rows of the table run over the pattern, columns over the text; moves along
    a row are a running minimum, so each step is one pass over the batch.
    """
    n, m = max(map(len, texts), default=0), max(map(len, patterns), default=0)
    text = np.zeros((len(texts), n), np.uint8)
    for i, t in enumerate(texts):
        text[i, : len(t)] = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    outside = np.arange(n + 1)[None, :] > np.array([len(t) for t in texts])[:, None]
    along = np.arange(n + 1, dtype=np.int32)[None, :]
    row = np.repeat(along * anchored, len(texts), axis=0).astype(np.int32)
    done = row.copy()
    sizes = np.array([len(p) for p in patterns])
    for i in range(m):
        letters = [p[i] if i < len(p) else "" for p in patterns]
        fits = np.zeros((len(texts), n), bool)
        for c in set(letters) - {""}:
            mine = np.array([x == c for x in letters])
            fits[mine] = np.isin(text[mine], np.frombuffer(WILD.get(c, c).encode(), np.uint8))
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + ~fits)
        row = np.minimum.accumulate(new - along, axis=1) + along
        ends = sizes == i + 1
        done[ends] = row[ends]
    done = np.where(outside, np.iinfo(np.int32).max, done)
    return done.min(axis=1), done.argmin(axis=1)


PLACE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("dist", "start", "end")])


def place(pattern, text):
    """Column struct: least edit distance of pattern to a stretch of text, and that stretch.

    Letters N, V and M of the pattern match what they stand for. Of several
    stretches the one that ends first, then the shortest. Nulls give nulls.
    """
    return F.pandas_udf(_place, PLACE)(pattern, text)


def _place(pattern: pd.Series, text: pd.Series) -> pd.DataFrame:
    ok = (pattern.notna() & text.notna()).to_numpy()
    out = pd.DataFrame({"dist": pd.array([None] * len(pattern), "Int32"), "start": pd.array([None] * len(pattern), "Int32"), "end": pd.array([None] * len(pattern), "Int32")})
    if ok.any():
        p, t = pattern[ok].tolist(), text[ok].tolist()
        dist, end = _distances(p, t)
        # backwards from the end, the first place where as few edits are enough
        _, back = _distances([x[::-1] for x in p], [x[:e][::-1] for x, e in zip(t, end.tolist(), strict=True)], anchored=True)
        out.loc[ok, "dist"], out.loc[ok, "end"], out.loc[ok, "start"] = dist, end, end - back
    return out
