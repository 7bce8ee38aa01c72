"""CIGARs of a batch as arrays; for the work that takes a row per operation or base."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Letters of sequences and CIGARs worked on at a time.
CHUNK = 1 << 20
_OP = np.zeros(256, bool)
_OP[np.frombuffer(b"MIDNSHP=X", np.uint8)] = True


def kinds(letters: bytes) -> np.ndarray:
    """A table by byte: is it one of letters."""
    table = np.zeros(256, bool)
    table[np.frombuffer(letters, np.uint8)] = True
    return table


QUERY, TARGET = kinds(b"MIS=X"), kinds(b"MDN=X")


def joined(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); a letter outside of ASCII is one byte too."""
    known = [t if isinstance(t, str) else "" for t in texts]
    ends = np.zeros(len(known) + 1, np.int64)
    np.cumsum([len(t) for t in known], out=ends[1:])
    return np.frombuffer("".join(known).encode("ascii", "replace"), np.uint8), ends


def operations(cigars: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, op as byte, len) of all operations, as by cigar_ops()."""
    text, ends = joined(cigars)
    digit = (text >= 48) & (text <= 57)
    at = np.flatnonzero(_OP[text])
    # the row's text ends a number to the left
    row = np.searchsorted(ends, at, side="right") - 1
    begin = ends[row]
    length, scale, more, back = np.zeros(len(at), np.int64), 1, np.ones(len(at), bool), 1
    some = np.zeros(len(at), bool)
    while True:
        place = at - back
        more = more & (place >= begin)
        more[more] = digit[place[more]]
        if not more.any():
            break
        length[more] += (text[place[more]].astype(np.int64) - 48) * scale
        some |= more
        scale, back = scale * 10, back + 1
    return row[some], text[at[some]], length[some]


def sums_before(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Running sums within each row; rows come in order."""
    sums = np.cumsum(values) - values
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return sums - np.repeat(sums[first], np.diff(first, append=len(row)))


def chunks(pdf: pd.DataFrame, *texts: str) -> Iterator[pd.DataFrame]:
    """Slices of a batch of about CHUNK letters, one row at least."""
    size = sum(pdf[t].str.len().fillna(0) for t in texts).to_numpy(np.float64)
    nth = (np.cumsum(size) - size) // CHUNK
    cuts = [*np.flatnonzero(np.diff(nth, prepend=-1)), len(pdf)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield pdf.iloc[a:b]
