"""Texts as sequences of repeating units, found and looked up a batch at a time.

A unit is a stretch that a pre-tokenizer for spaced scripts never joins to its
neighbours: text is cut at ASCII white space and, inside a run, between two
ASCII characters of different class (letters, single digits, others). Runs with
an apostrophe or with characters beyond ASCII next to a cut are left whole
there. What a unit stands for is learned once and found by a hash of its bytes,
read as 64-bit words, so texts cost array operations only. A hash only points:
the bytes themselves are compared before anything is used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

SPACE, LETTER, DIGIT, OTHER, WIDE = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[128:] = WIDE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of a unit's first and second word and of the whole.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: The lowest 0 to 8 bytes of a word.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 2_000_000
#: Units kept, and items kept for them; beyond either the memory is begun anew.
KEPT, KEPT_ITEMS = 1_500_000, 24_000_000


class Split:
    """Units of some texts: buf[starts[i]:ends[i]] is the i-th; text t has units first[t]:first[t + 1]."""

    def __init__(self, texts: list[bytes], fold: bool):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        special = b"<|" in joined
        self.buf = LOWER[raw] if fold and not special else raw
        kind = CLASS[self.buf]
        solid = kind != SPACE
        edge = np.empty(len(raw), bool)
        edge[0] = solid[0]
        edge[1:] = solid[1:] & ~solid[:-1]
        if not special:
            a, b = kind[:-1], kind[1:]
            cut = solid[1:] & solid[:-1] & ((a != b) | (b == DIGIT)) & (a != WIDE) & (b != WIDE)
            quotes = np.flatnonzero(raw == 39)
            if len(quotes):
                runs = np.cumsum(edge)
                quoted = np.zeros(int(runs[-1]) + 1, bool)
                quoted[runs[quotes]] = True
                cut &= ~quoted[runs[1:]]
            edge[1:] |= cut
        self.starts = np.flatnonzero(edge)
        # a unit ends where the next begins or at the first space before that
        stop = np.empty(len(raw), bool)
        stop[0] = False
        stop[1:] = solid[:-1] & (~solid[1:] | edge[1:])
        self.ends = np.flatnonzero(stop)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))

    def heads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first 8 bytes, next 8 bytes, length) of each unit; bytes it lacks are zero."""
        size = self.ends - self.starts
        padded = np.concatenate([self.buf, np.zeros(16, np.uint8)])
        word = np.ndarray((len(self.buf) + 9,), "<u8", padded, strides=(1,))
        return word[self.starts] & LOW[np.minimum(size, 8)], word[self.starts + 8 if len(size) else size] & LOW[np.clip(size - 8, 0, 8)], size

    def hashes(self, heads=None) -> np.ndarray:
        """A hash of each unit."""
        one, two, size = heads or self.heads()
        h = (one * MIX[0]) ^ ((two ^ (two >> np.uint64(31))) * MIX[1] + size.astype(np.uint64))
        h = (h ^ (h >> np.uint64(29))) * MIX[2]
        long = np.flatnonzero(size > 16)
        if len(long):
            raw, digest = self.buf.tobytes(), xxhash.xxh64_intdigest
            h[long] = np.fromiter((digest(raw[a:b]) for a, b in zip(self.starts[long].tolist(), self.ends[long].tolist(), strict=True)), np.uint64, len(long))
        return h


def stretches(text: bytes) -> list[bytes]:
    """The text cut before spaces into stretches of about CHUNK; a longer run stays whole."""
    out, at = [], 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(w, at + 1, at + CHUNK) for w in (b" ", b"\n", b"\t"))
        if cut < 0:
            after = [x for w in (b" ", b"\n", b"\t") if (x := text.find(w, at + CHUNK)) >= 0]
            if not after:
                break
            cut = min(after)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def stretch(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes at[0], at[0] + 1, ... (sizes[0] of them), then those from at[1] on, and so forth."""
    ends = np.cumsum(sizes)
    return np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Memory:
    """What units stand for: for each, a stretch of every one of several arrays.

    learn(units) gives, for a list of distinct units, a tuple of lists, one for
    each array kind, with an array per unit. The units' own bytes are kept as a
    last kind, and every find is confirmed by them.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[list[np.ndarray], ...]], kinds: tuple):
        self.learn, self.kinds = learn, (*kinds, np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.key, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.heads = [np.empty(1024, np.uint64), np.empty(1024, np.uint64)]
        self.count = 0
        self.flat = [np.empty(1024, k) for k in self.kinds]
        self.used = [0] * len(self.kinds)
        self.at = [np.empty(1024, np.int64) for _ in self.kinds]
        self.size = [np.empty(1024, np.int32) for _ in self.kinds]

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a) // 2), a.dtype)])

    def _add(self, units: list[bytes]) -> None:
        for k in range(2):
            self.heads[k] = self._room(self.heads[k], self.count + len(units))
            self.heads[k][self.count : self.count + len(units)] = np.frombuffer(b"".join(u[8 * k : 8 * k + 8].ljust(8, b"\0") for u in units), "<u8")
        for k, got in enumerate((*self.learn(units), [np.frombuffer(u, np.uint8) for u in units])):
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            whole = np.concatenate(got) if got else np.empty(0, self.kinds[k])
            to, n = self.used[k] + len(whole), self.count + len(units)
            self.flat[k], self.at[k], self.size[k] = self._room(self.flat[k], to), self._room(self.at[k], n), self._room(self.size[k], n)
            self.flat[k][self.used[k] : to] = whole
            self.at[k][self.count : n] = self.used[k] + np.cumsum(sizes) - sizes
            self.size[k][self.count : n] = sizes
            self.used[k] = to
        self.count += len(units)

    def places(self, s: Split) -> np.ndarray:
        """Where each unit of s is kept; all are afterwards."""
        if self.count > KEPT or max(self.used) > KEPT_ITEMS:
            self._clear()
        if not len(s.starts):
            return np.empty(0, np.int64)
        heads = s.heads()
        keys, one, back = np.unique(s.hashes(heads), return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(self.key, keys), max(0, len(self.key) - 1))
        known = self.key[i] == keys if len(self.key) else np.zeros(len(keys), bool)
        found = np.empty(len(keys), np.int64)
        found[known] = self.place[i[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = s.buf.tobytes()
            found[new] = self.count + np.arange(len(new))
            self._add([raw[a:b] for a, b in zip(s.starts[one[new]].tolist(), s.ends[one[new]].tolist(), strict=True)])
            at = np.searchsorted(self.key, keys[new])
            self.key, self.place = np.insert(self.key, at, keys[new]), np.insert(self.place, at, found[new])
        found = found[back]
        if (self.heads[0][found] != heads[0]).any() or (self.heads[1][found] != heads[1]).any() or (self.size[-1][found] != heads[2]).any():
            return self._one_by_one(s)
        long = np.flatnonzero(heads[2] > 16)
        size = heads[2][long]
        same = np.array_equal(self.flat[-1][stretch(self.at[-1][found[long]], size)], s.buf[stretch(s.starts[long], size)])
        return found if same else self._one_by_one(s)

    def _one_by_one(self, s: Split) -> np.ndarray:
        """For different units of one hash: each distinct unit of the batch is learned by its bytes."""
        raw = s.buf.tobytes()
        units = [raw[a:b] for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]
        seen = {u: i for i, u in enumerate(dict.fromkeys(units))}
        base = self.count
        self._add(list(seen))
        return np.array([base + seen[u] for u in units], np.int64)

    def gather(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(array k of these units one after another, ends of each unit's stretch)."""
        sizes = self.size[k][places].astype(np.int64)
        return self.flat[k][stretch(self.at[k][places], sizes)], np.cumsum(sizes)

    def texts(self, texts: list[bytes], fold: bool):
        """Yields for each text the tuple of its arrays, one for each kind.

        A very long text goes in stretches between spaces, which no unit spans.
        """
        at = 0
        while at < len(texts):
            if len(texts[at]) > 2 * CHUNK and len(parts := stretches(texts[at])) > 1:
                yield tuple(np.concatenate(x) for x in zip(*self.texts(parts, fold), strict=True))
                at += 1
                continue
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
                size += len(texts[to]) + 1
                to += 1
            s = Split(texts[at:to], fold)
            places = self.places(s)
            got = [self.gather(k, places) for k in range(len(self.kinds) - 1)]
            cuts = [np.concatenate([[0], ends])[s.first].tolist() for _, ends in got]
            for t in range(to - at):
                yield tuple(flat[c[t] : c[t + 1]] for (flat, _), c in zip(got, cuts, strict=True))
            at = to
