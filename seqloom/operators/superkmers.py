"""Stretches of a text whose k-mers share their least m-mer, so that equal k-mers of all texts meet by it.

A stretch of n k-mers is n + k - 1 letters, where n k-mers by themselves are n rows.
Stretches go to buckets by their least m-mer, a block of them at a time. Whatever is
done for each letter is done in arrays; Spark's rows are blocks and buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship

#: Letters of the m-mers, and k-mers of a stretch at most.
M, LONGEST = 8, 64
#: Letters hashed at a time (longer texts go in pieces), bytes of short texts that are cut together, and letters whose k-mers are hashed together.
PIECE, GROUP, CHUNK = 1 << 20, 1 << 16, 1 << 15
#: k-mers that a block sends and that a bucket holds on average, and that are sorted together at most; buckets at least, and parts of each.
BLOCK, SORTED, BUCKETS, PARTS = 1 << 21, 1 << 19, 128, 8
#: Pairs that a block counts and that a bucket of pairs holds on average.
PAIRS = 1 << 20
#: An odd base of powers, 3 or 5 modulo 8, another odd number for letters, and a shift.
_MIX = {np.uint32: (0x85EBCA6B, 0xC2B2AE35, 15), np.uint64: (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 29)}
_ROW = "bucket int, size bigint, rows binary"


def _mixed(h: np.ndarray, kind: type = np.uint64, power: int = 1) -> np.ndarray:
    base, _, shift = _MIX[kind]
    h = h * kind(pow(base, power, 1 << 8 * kind().itemsize))
    h ^= h >> kind(shift)
    return h


def _letters(code: np.ndarray, kind: type) -> np.ndarray:
    part = (code.astype(kind) + kind(1)) * kind(_MIX[kind][1])
    part ^= part >> kind(_MIX[kind][2])
    return _mixed(part, kind)


def _hashes(code: np.ndarray, k: int, kind: type, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """A hash of each k letters in a row, or of those that begin at the given places, by doubled lengths.

    It is a polynomial in a base, so that each place has a power of its own; what stands left is
    mixed before each sum, so that it is not linear.
    """
    if code.itemsize == 1 and k % 2 == 0:
        two = code[:-1].astype(np.uint16)
        two <<= np.uint16(8)
        two |= code[1:]
        part, size = _twos(kind)[two], 2
    else:
        part, size = _letters(code, kind), 1
    n, out, done = len(code) - k + 1, None, 0
    while True:
        if k & size:
            last = part[done : done + n][at]
            out = last if out is None else _mixed(out, kind, size) + last
            done += size
        if 2 * size > k:
            return _mixed(out, kind)
        left = _mixed(part[:-size], kind, size)
        left += part[size:]
        part, size = left, 2 * size


@lru_cache
def _twos(kind: type) -> np.ndarray:
    """What _hashes has of each two letters of one byte, before it ends."""
    one = _letters(np.arange(256), kind)
    return (_mixed(one, kind)[:, None] + one).ravel()


def _counted(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the runs, one behind the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _runs(*sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal values."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = sorted_[0][1:] != sorted_[0][:-1]
    for c in sorted_[1:]:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, _sizes(starts, len(new))


def _sizes(starts: np.ndarray, end: int) -> np.ndarray:
    sizes = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=sizes[:-1])
    sizes[-1:] = end - starts[-1:]
    return sizes


def _cut(code: np.ndarray, sizes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(line, start in code, k-mers, least m-mer's hash) of the stretches of texts that lie one behind the other."""
    if len(code) < k:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint32))
    least = _hashes(code, m, np.uint32)
    # the least of k - m + 1 neighbours, by doubled lengths
    size, w = 1, k - m + 1
    while size < w:
        step = min(size, w - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    # runs end with a text's last k-mer, and those of k-mers that reach into the next text go
    begins, grams = np.cumsum(sizes) - sizes, np.maximum(sizes - k + 1, 0)
    new = np.ones(len(least) + k, bool)
    np.not_equal(least[1:], least[:-1], out=new[1 : len(least)])
    new[begins] = new[begins + grams] = True
    first = np.flatnonzero(new[: len(least)])
    n = _sizes(first, len(least))
    line = np.searchsorted(begins, first, side="right") - 1
    inside = first - begins[line] < grams[line]
    line, first, n = line[inside], first[inside], n[inside]
    if len(n) and n.max() > LONGEST:
        cuts = -(-n // LONGEST)
        nth = _counted(np.zeros(len(cuts), np.int64), cuts)
        line, first = np.repeat(line, cuts), np.repeat(first, cuts) + nth * LONGEST
        n = np.minimum(LONGEST, np.repeat(n, cuts) - nth * LONGEST)
    return line, first, n, least[first]


def stretches_of(text: str, k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, bucket) of a text's stretches: each place of a k-mer is in exactly one."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for s in range(0, len(letters) - k + 1, PIECE):
        code = letters[s : s + PIECE + k - 1]
        _, start, n, least = _cut(code, np.array([len(code)]), k, m)
        yield start + s, start + s + n + k - 1, least


def _narrow(code: np.ndarray) -> np.ndarray:
    """The letters in as few bytes each as hold them all."""
    most = int(code.max(initial=0))
    return code.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32, copy=False)


def _scanned(texts: pa.Array, k: int, m: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(letters, line, start in letters, k-mers, least m-mer's hash) of a batch of texts, some texts at a time."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = pc.utf8_length(texts).to_numpy()
    data = memoryview(texts.buffers()[2] or b"")
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + GROUP, side="right")) - 1)
        part = data[ends[i] : ends[j]]
        code = np.frombuffer(part, np.uint8)
        if len(code) > sizes[i:j].sum():
            letters = str(part, "utf-8", "surrogatepass")
            try:
                code = np.frombuffer(letters.encode("latin-1"), np.uint8)
            except UnicodeEncodeError:
                code = _narrow(np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32))
        if j > i + 1 or len(code) <= PIECE:
            line, *rest = _cut(code, sizes[i:j], k, m)
            yield code, line + i, *rest
        else:
            for s in range(0, len(code) - k + 1, PIECE):
                piece = code[s : s + PIECE + k - 1]
                line, *rest = _cut(piece, np.array([len(piece)]), k, m)
                yield piece, line + i, *rest
        i = j


def _packed(*parts: bytes) -> tuple[int, bytes]:
    whole = b"".join(parts)
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(t: pa.Table) -> Iterator[bytes]:
    for size, rows in zip(t.column("size").to_pylist(), t.column("rows").to_pylist()):
        yield pa.decompress(rows, size, codec="zstd", asbytes=True)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, size, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "size", "rows"])


def _dealt(held: list[tuple[np.ndarray, ...]], k: int) -> pa.RecordBatch:
    """(bucket, size, rows): a block's stretches, one row for each bucket."""
    code = np.concatenate([h[0] for h in held])
    shift = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
    fine = np.concatenate([h[1] for h in held])
    # numbers of two bytes are sorted by radix
    low = int(fine.min())
    order = np.argsort((fine - low).astype(np.uint16) if fine.max() - low < 1 << 16 else fine, kind="stable")
    fine = fine[order]
    ids = np.concatenate([h[2] for h in held])[order]
    start = np.concatenate([h[3] + s for h, s in zip(held, shift)])[order]
    n = np.concatenate([h[4] for h in held])[order]
    size = n + k - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    letters = np.empty(ends[-1], code.dtype)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
        letters[ends[i] : ends[j]] = code[_counted(start[i:j], size[i:j])]
        i = j
    n = n.astype(np.uint8)
    starts, sizes = _runs(fine // PARTS)
    rows = []
    for s, c in zip(starts.tolist(), sizes.tolist()):
        part = _narrow(letters[ends[s] : ends[s + c]])
        head = np.append(np.bincount(fine[s : s + c] % PARTS, minlength=PARTS), part.itemsize)
        rows.append((int(fine[s]) // PARTS, *_packed(head.tobytes(), ids[s : s + c].tobytes(), n[s : s + c].tobytes(), part.tobytes())))
    return _batch(rows)


def stretches(texts: DataFrame, id_: str, text: str, k: int, buckets: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(bucket, size, rows): blocks of the texts' stretches, of the `part`th of `parts` shares of the buckets.

    id_ is a long. There are `buckets` buckets in a share.
    """
    ship(texts.sparkSession)
    m, all_ = min(M, k), np.uint64(buckets * PARTS * parts)
    low, high = part * buckets * PARTS, (part + 1) * buckets * PARTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("_id").to_numpy()
            for code, line, start, n, least in _scanned(batch.column("_text"), k, m):
                fine = ((_mixed(least, np.uint32).astype(np.uint64) * all_) >> np.uint64(32)).astype(np.int64)
                mine = (fine >= low) & (fine < high)
                held.append((code, fine[mine], ids[line[mine]], start[mine], n[mine]))
                size += int(held[-1][4].sum())
                if size >= BLOCK:
                    yield _dealt(held, k)
                    held, size = [], 0
        if size:
            yield _dealt(held, k)

    return texts.select(F.col(id_).alias("_id"), F.col(text).alias("_text")).mapInArrow(cut, _ROW)


def _once(code: np.ndarray, n: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k-mers of one text, members, sizes): the ascending ids of each k-mer that two texts or more have.

    If there are many k-mers, they go by shares of their hashes, each of which reads all the letters.
    """
    ends = np.concatenate([[0], np.cumsum(n + k - 1)])
    shares = max(1, -(-int(n.sum()) // SORTED))
    for share in range(shares):
        hashes, owners, i = [], [], 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
            h = _hashes(code[ends[i] : ends[j]], k, np.uint64, _counted(ends[i:j] - ends[i], n[i:j]))
            own = np.repeat(ids[i:j], n[i:j])
            if shares > 1:
                mine = (h >> np.uint64(40)) % np.uint64(shares) == share
                h, own = h[mine], own[mine]
            hashes.append(h)
            owners.append(own)
            i = j
        h, own = np.concatenate(hashes), np.concatenate(owners)
        # places stand in the low bits of the sorted numbers; what differs in the others is of one text
        low = (np.uint64(1) << np.uint64(len(h).bit_length())) - np.uint64(1)
        key = h & ~low
        key |= np.arange(len(h), dtype=np.uint64)
        key.sort()
        same = (key[1:] ^ key[:-1]) <= low
        member = np.zeros(len(key), bool)
        member[1:] = same
        member[:-1] |= same
        at = (key[member] & low).astype(np.int64)
        alone = len(h) - len(at)
        if not len(at):
            yield alone, at, at
            continue
        h, own = h[at], own[at]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.cumsum(new)
        bits = np.int64(62 - int(run[-1]).bit_length())
        if own.min() >= 0 and own.max() < 1 << bits and run[-1] == 1 + np.count_nonzero((h[1:] ^ h[:-1]) > low):
            # hashes differ in the sorted bits alone: their number and the id are one number
            both = (run << bits) | own
            both.sort()
            both = both[_runs(both)[0]]  # once for each text
            run, own = both >> bits, both & ((np.int64(1) << bits) - 1)
        else:
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            first, _ = _runs(h, own)
            run, own = h[first], own[first]
        _, sizes = _runs(run)
        yield alone + int((sizes == 1).sum()), own[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]


def _alike(members: np.ndarray, sizes: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of members, by size, each distinct one once with the sum of its `same`."""
    if not len(sizes):
        return members, sizes, same
    starts = np.cumsum(sizes) - sizes
    one = _mixed(_mixed(members.view(np.uint64)))
    x, y = np.bitwise_xor.reduceat(one, starts), np.add.reduceat(_mixed(one + np.uint64(1)), starts)
    order = np.argsort(x ^ _mixed(sizes.view(np.uint64)))
    first, _ = _runs(sizes[order], x[order], y[order])
    same, lead = np.add.reduceat(same[order], first), order[first]
    order = np.argsort(sizes[lead], kind="stable")
    same, lead = same[order], lead[order]
    return members[_counted(starts[lead], sizes[lead])], sizes[lead], same


def shared_kmers(blocks: DataFrame, k: int) -> DataFrame:
    """(n, kmers, sets, members, same) of blocks of stretches: in a bucket, the k-mers that n texts have.

    k-mers of a bucket in just the same texts are one set of n ids, and `same` is their
    number; a row has all sets of a bucket and n, one behind the other. k-mers of one text
    are only counted.
    """
    ship(blocks.sparkSession)

    def gather(t: pa.Table) -> pa.Table:
        blobs = []
        for blob in _unpacked(t):
            head = np.frombuffer(blob, np.int64, PARTS + 1)
            count = int(head[:PARTS].sum())
            ids = np.frombuffer(blob, np.int64, count, head.nbytes)
            n = np.frombuffer(blob, np.uint8, count, head.nbytes + ids.nbytes).astype(np.int64)
            code = np.frombuffer(blob, f"u{head[PARTS]}", offset=head.nbytes + ids.nbytes + count)
            lines = np.concatenate([[0], np.cumsum(head[:PARTS])])
            blobs.append((ids, n, code, lines, np.concatenate([[0], np.cumsum(n + k - 1)])[lines]))
        alone, found = 0, []
        kmers = sum(np.add.reduceat(np.append(b[1], 0), b[3][:-1]) * (b[3][1:] > b[3][:-1]) for b in blobs)
        low = 0
        while low < PARTS:
            # some parts together, if they are small
            high = max(low + 1, low + int(np.searchsorted(np.cumsum(kmers[low:]), SORTED // 2, side="right")))
            ids = np.concatenate([b[0][b[3][low] : b[3][high]] for b in blobs])
            n = np.concatenate([b[1][b[3][low] : b[3][high]] for b in blobs])
            code = np.concatenate([b[2][b[4][low] : b[4][high]] for b in blobs])
            low = high
            if not len(ids):
                continue
            for single, members, sizes in _once(code, n, ids, k):
                alone += single
                found.append(_alike(members, sizes, np.ones(len(sizes), np.int64)))
        members, sizes, same = _alike(*[np.concatenate(c) for c in zip(*found)])
        ends = np.cumsum(sizes)
        rows = [(1, alone, 0, None, None)]
        for s, c in zip(*[v.tolist() for v in _runs(sizes)] if len(sizes) else ((), ())):
            n = int(sizes[s])
            rows.append((n, int(same[s : s + c].sum()), c, members[ends[s] - n : ends[s + c - 1]].tobytes(), same[s : s + c].tobytes()))
        columns = zip(*rows)
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("n", "kmers", "sets", "members", "same"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    return blocks.groupBy("bucket").applyInArrow(gather, "n bigint, kmers bigint, sets bigint, members binary, same binary")


@lru_cache(maxsize=8)
def _couples(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _pairs(members: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, same) of the pairs of each line of members, some at a time."""
    n = members.shape[1]
    if n * n <= PAIRS:
        i, j = _couples(n)
        step = max(1, PAIRS // len(i))
        for s in range(0, len(members), step):
            part = members[s : s + step]
            yield part[:, i].ravel(), part[:, j].ravel(), np.repeat(same[s : s + step], len(i))
        return
    step = max(1, PAIRS // n)
    for line, w in zip(members, same):
        for s in range(0, n - 1, step):
            i, j = np.triu_indices(min(step, n - s), 1, n - s)
            yield line[s + i], line[s + j], np.full(len(i), w)


def _summed(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, a, b, same) of distinct pairs by a hash of theirs, with the sum of `same`."""
    key = _mixed(_mixed(_mixed(a.view(np.uint64))) + b.view(np.uint64))
    order = np.argsort(key)
    key, a, b, same = key[order], a[order], b[order], same[order]
    first, n = _runs(key)
    if len(first) < len(_runs(key, a, b)[0]):  # two pairs have one hash
        order = np.lexsort((b, a, key))
        key, a, b, same = key[order], a[order], b[order], same[order]
        first, n = _runs(key, a, b)
    return key[first], a[first], b[first], np.add.reduceat(same, first)


def shared_pairs(shared: DataFrame, pairs: int, least: int) -> DataFrame:
    """(a, b, shared): pairs of ids, a < b, that have at least `least` k-mers of shared_kmers in common.

    Pairs of a block are counted before they are dealt to buckets by pair; `pairs` is
    their number in all, from which the number of buckets follows.
    """
    ship(shared.sparkSession)
    buckets = max(BUCKETS, pairs // PAIRS)

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, a, b, same = _summed(*[np.concatenate(c) for c in zip(*held)])
        to = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        rows = []
        for s, c in zip(*[v.tolist() for v in _runs(to)]):
            order = s + np.lexsort((b[s : s + c], a[s : s + c]))
            rows.append((int(to[s]), *_packed(a[order].tobytes(), b[order].tobytes(), same[order].tobytes())))
        return _batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for n, members, same in zip(*[batch.column(c) for c in ("n", "members", "same")]):
                lines = np.frombuffer(members.as_buffer(), np.int64).reshape(-1, n.as_py())
                for part in _pairs(lines, np.frombuffer(same.as_buffer(), np.int64)):
                    held.append(part)
                    size += len(part[0])
                    if size >= PAIRS:
                        yield dealt(held)
                        held, size = [], 0
        if size:
            yield dealt(held)

    def count(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(blob, np.int64).reshape(3, -1) for blob in _unpacked(t)]
        _, a, b, same = _summed(*[np.concatenate(c) for c in zip(*parts)])
        kept = same >= least
        return pa.table({"a": a[kept], "b": b[kept], "shared": same[kept]})

    met = shared.select("n", "members", "same").mapInArrow(meet, _ROW)
    return met.groupBy("bucket").applyInArrow(count, "a bigint, b bigint, shared bigint")
