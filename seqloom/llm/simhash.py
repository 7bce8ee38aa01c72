"""SimHash near-duplicates: fingerprints, sharded BK-trees and components.

Shards are made so that no tree ever holds the corpus: two fingerprints within
the radius agree on some of the bit blocks that key a shard, so both meet in at
least one. The number of blocks that must agree follows the number of
fingerprints, so that a shard keeps about SHARD members at every size and its
BK-tree does the search. A shard's tree travels to its queries by shuffle. It
is not broadcast, because the trees together grow with the corpus. A shard with
more members than `shard_rows` is dealt out as pairs of blocks (one block's
tree, the other block's queries), which is exact and bounds each task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.session import ship, table

SEED = 42
#: Members below which a subtree is kept as a flat leaf.
LEAF = 8
#: Members of a shard, about, that the choice of agreeing blocks aims at.
SHARD = 1024


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; all words if fewer than k."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - k] + 1).tolist()]
    ends = [*gaps[k - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray, lanes: int = 1) -> bytes:
    """lanes x 64 bits, each big-endian; a bit is set if over half the hashes have it.

    Lane 0 takes the hashes as they are; others take a mixed copy of them.
    """
    out = []
    for lane in range(lanes):
        x = h
        if lane:
            x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * lane)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        set_in = np.zeros(64, np.int64)
        for at in range(0, len(x), 8192):
            part = np.ascontiguousarray(x[at : at + 8192]).view(np.uint8).reshape(-1, 8)
            set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(set_in * 2 > len(h), bitorder="little")[::-1].tobytes())
    return b"".join(out)


def fingerprint(data: bytes | None, k: int, lanes: int = 1) -> bytes:
    """majority() of the shingle hashes of a whole text."""
    return majority(shingle_hashes(data or b"", k), lanes)


def fingerprints(docs: DataFrame, k: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, fp binary) of whole texts; a null text counts as empty."""

    def run(batches):
        for pdf in batches:
            seen: dict[bytes, bytes] = {}
            fps = []
            for x in pdf["data"]:
                x = x or b""
                if x not in seen:
                    seen[x] = fingerprint(x, k, lanes)
                fps.append(seen[x])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInPandas(run, "doc_id bigint, fp binary")


class BKTree:
    """Burkhard-Keller tree over rows of uint64 lanes under Hamming distance.

    Children hang at the integer distance to their parent; a search follows
    only edges within the radius. Small subtrees are kept as flat leaves.
    `followed` and `passed` count edges by what searches did with them.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.followed = self.passed = 0
        self.root = self._grow(np.arange(len(rows)))

    @staticmethod
    def distance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.bitwise_count(one ^ many).sum(axis=-1, dtype=np.int32)

    def _grow(self, members: np.ndarray):
        top: list = [None]
        todo = [(members, top, 0)]
        while todo:
            members, into, slot = todo.pop()
            if len(members) <= LEAF:
                into[slot] = (members, None)
                continue
            head, rest = members[0], members[1:]
            d = self.distance(self.rows[head], self.rows[rest])
            order = np.argsort(d, kind="stable")
            edges, at = np.unique(d[order], return_index=True)
            children = [None] * len(edges)
            into[slot] = (head, (edges, children))
            for i, part in enumerate(np.split(rest[order], at[1:])):
                todo.append((part, children, i))
        return top[0]

    def near(self, queries: np.ndarray, radius: int):
        """Yields arrays (query index, member index) within the radius."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (head, below), who = todo.pop()
            if below is None:
                for at in range(0, len(who), 4096):
                    part = who[at : at + 4096]
                    q, m = np.nonzero(self.distance(queries[part][:, None, :], self.rows[head][None, :, :]) <= radius)
                    if len(q):
                        yield part[q], head[m]
                continue
            d = self.distance(queries[who], self.rows[head])
            hit = who[d <= radius]
            if len(hit):
                yield hit, np.full(len(hit), head)
            edges, children = below
            for edge, child in zip(edges.tolist(), children, strict=True):
                go = who[np.abs(d - edge) <= radius]
                self.followed += len(go)
                self.passed += len(who) - len(go)
                if len(go):
                    todo.append((child, go))


def local_links(rows: np.ndarray, ids: np.ndarray, tree_rows: np.ndarray, radius: int, stars: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the searches of one shard connect, under n for n members.

    rows, ids: the members; tree_rows: which of them form the tree. With `stars`
    an edge is (id, least id of its group), else a pair that a search found.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids, in_tree = rows[order], ids[order], tree_rows[order]
    owner = np.arange(len(ids))
    members = np.flatnonzero(in_tree)
    tree = BKTree(rows[members])
    pairs: list[tuple[int, int]] = []

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = owner[x]
            if (up == x).all():
                return x
            x = up

    for at in range(0, len(rows), 1024):
        for q, m in tree.near(rows[at : at + 1024], radius):
            q, m = q + at, members[m]
            a, b = find(q), find(m)
            apart = np.flatnonzero(a != b)
            if not len(apart):
                continue
            _, one = np.unique(np.stack([a[apart], b[apart]], 1), axis=0, return_index=True)
            for i in apart[one].tolist():
                x, y = a[i], b[i]
                while owner[x] != x:
                    x = owner[x]
                while owner[y] != y:
                    y = owner[y]
                if x != y:
                    owner[max(x, y)] = min(x, y)
                    pairs.append((q[i], m[i]))
    if stars:
        root = find(np.arange(len(ids)))
        moved = ids != ids[root]
        return ids[moved], ids[root][moved]
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return ids[found.max(axis=1)], ids[found.min(axis=1)]


def agreeing_blocks(nodes: int, radius: int, shard: int = SHARD) -> int:
    """How many of radius + x bit blocks must agree so that a shard has about `shard` of the nodes."""
    agree = 1
    while nodes >> (64 * agree // (radius + agree)) > shard and 64 // (radius + agree + 1) > 1:
        agree += 1
    return agree


def block_keys(fp: str, blocks: int, agree: int):
    """Shard keys of one 64-bit lane: every choice of `agree` of its bit blocks.

    Two lanes that differ in at most blocks - agree bits share a key.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [f"(shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.expr("array(" + ", ".join(f"xxhash64({n}, {', '.join(part[i] for i in chosen)})" for n, chosen in enumerate(combinations(range(blocks), agree))) + ")")


def sampled_keys(lanes: int, tables: int, bits: int):
    """Shard keys of `tables` fixed random draws of `bits` bits out of all lanes."""
    rng = np.random.default_rng(SEED)
    keys = []
    for n in range(tables):
        mask = [0] * lanes
        for bit in rng.choice(64 * lanes, bits, replace=False).tolist():
            mask[bit // 64] |= 1 << (bit % 64)
        signed = [m - (1 << 64) if m >> 63 else m for m in mask]
        keys.append(f"xxhash64({n}, " + ", ".join(f"lanes[{i}] & ({f'{m}L' if m != -(1 << 63) else 'bigint(-9223372036854775808)'})" for i, m in enumerate(signed) if m) + ")")
    return F.expr("array(" + ", ".join(keys) + ")")


def _lanes(lanes: int):
    """Signed 64-bit lanes of the binary column fp."""
    return F.expr("array(" + ", ".join(f"cast(conv(hex(substring(fp, {8 * i + 1}, 8)), 16, -10) as bigint)" for i in range(lanes)) + ")")


def links(nodes: DataFrame, keys, radius: int, shard_rows: int = 4096, stars: bool = True) -> DataFrame:
    """Edges (a, b) that connect the ids whose fingerprints lie within the radius; see local_links().

    nodes: (id, lanes array<bigint>), one row per distinct fingerprint.
    """
    keyed = nodes.withColumn("key", F.explode(keys))
    hot = table(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select(F.col("key").alias("_key"), F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "hot")
    # few shards are hot; were they many, the join would shuffle
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    dealt = keyed.join(hot, F.col("key") == F.col("_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("id", "lanes", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), (F.col("own") <= F.col("other")).alias("in_tree"))

    def shards(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            pdf = pd.concat([*held, pdf]) if held else pdf
            if pdf.empty:
                continue
            last = pdf["shard"].to_numpy() == pdf["shard"].iloc[-1]
            held = [pdf[last]]
            yield from linked(pdf[~last])
        if held:
            yield from linked(held[0])

    def linked(pdf):
        if pdf.empty:
            return
        shard = pdf["shard"].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        sizes = np.diff(np.append(at, len(shard)))
        if (sizes == 1).all():
            return
        pdf = pdf[np.repeat(sizes > 1, sizes)]
        rows = np.stack(pdf["lanes"].to_numpy()).astype(np.int64).view(np.uint64)
        ids, tree = pdf["id"].to_numpy(), pdf["in_tree"].to_numpy(bool)
        ends = np.cumsum(sizes[sizes > 1]).tolist()
        a, b = [], []
        for s, e in zip([0, *ends[:-1]], ends, strict=True):
            x, y = local_links(rows[s:e], ids[s:e], tree[s:e], radius, stars)
            a.extend(x.tolist())
            b.extend(y.tolist())
        if a:
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInPandas(shards, "a bigint, b bigint")


def simhash_components(docs: DataFrame, k: int = 4, lanes: int = 1, radius: int = 4, tables: int = 0, table_bits: int = 16, shard_rows: int = 4096) -> DataFrame:
    """(doc_id, fp binary, component_id) for every row of docs(doc_id, text).

    Rows link when their fingerprints differ in at most `radius` bits;
    component_id is the least doc_id reachable. With `tables` = 0 shards are
    keyed by agreeing bit blocks and no link is lost (one lane, radius up to
    30); otherwise by that many draws of `table_bits` bits, for a radius too
    wide for blocks. Equal texts, empty and null ones too, share a fingerprint
    and so a component. A row without doc_id takes part in no component but
    its fingerprint's. An empty table gives an empty result.
    """
    if not tables and (lanes != 1 or radius > 30):
        raise ValueError("block keys need one lane and blocks of two bits or more")
    fps = table(fingerprints(docs, k, lanes), "fingerprints")
    nodes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL").withColumn("lanes", _lanes(lanes)), "nodes")
    if tables:
        keys = sampled_keys(lanes, tables, table_bits)
    else:
        agree = agreeing_blocks(nodes.count(), radius)
        keys = block_keys("lanes[0]", radius + agree, agree)
    joined = components(links(nodes.select("id", "lanes"), keys, radius, shard_rows))
    named = nodes.join(joined, nodes["id"] == joined["node"], "left").select(nodes["fp"], F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op4_simhash_components(spark, sf_dir) -> DataFrame:
    """The contract's query: 4-word shingles, 64 bits, links at 4 bits or fewer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
