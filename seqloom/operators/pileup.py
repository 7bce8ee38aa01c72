"""CIGAR explosion, pileup counts, depth, windows of overlaps and votes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import cigars
from seqloom.functions.scalars import cigar_ops, sums_before
from seqloom.session import ship


def passes(min_mapq: int = 0, tag: str | None = None, value: str | None = None, keep_missing: bool = False, read_group: str | None = None, missing_skips_group: bool = True, min_snp_accuracy: float = 0) -> Column:
    """Condition on flag, mapq, accuracy and tags of alignments that take part in a pileup.

    With missing_skips_group a row that lacks the tag and is kept for that is
    not asked for its read group. min_snp_accuracy (over 0) asks for snp_accuracy().
    """
    ok = F.expr("(flag & 3844) = 0") & (F.col("mapq") >= min_mapq)
    if min_snp_accuracy > 0:
        ok &= snp_accuracy() >= min_snp_accuracy
    group = F.coalesce(F.col("tags")["RG"] == read_group, F.lit(False)) if read_group else F.lit(True)
    if tag is None:
        return ok & group
    here = F.col("tags")[tag]
    if not keep_missing:
        return ok & F.coalesce(here == value, F.lit(False)) & group
    return ok & ((here.isNull() & (F.lit(True) if missing_skips_group else group)) | (F.coalesce(here == value, F.lit(False)) & group))


def snp_accuracy(cigar: str = "cigar", tags: str = "tags") -> Column:
    """1 - substitutions / aligned pairs, in [0, 1]; 0 without pairs.

    Substitutions are NM less insertions and deletions, and none without NM.
    """
    total = lambda ops, kinds: F.aggregate(F.filter(ops, lambda o: o["op"].isin(list(kinds))), F.lit(0), lambda a, o: a + o["len"])

    def share(ops: Column) -> Column:
        pairs = total(ops, "M=X")
        wrong = F.coalesce(F.col(tags)["NM"].try_cast("int") - total(ops, "ID"), F.lit(0))
        return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.try_divide(wrong, pairs))), F.lit(0.0))

    return F.transform(F.array(cigar_ops(cigar)), share)[0]


def exploded(alignments: DataFrame, id_: str, bases: str | None = None) -> DataFrame:
    """One row per CIGAR operation with q0 (query) and r0 (reference) where it begins.

    alignments: id_, pos (0-based), cigar. Sums run inside the row, so nothing
    is shuffled. bases: an array column of the read's bases; it is replaced by
    `piece`, the stretch of each operation that takes query.
    """
    piece = f", 'piece', if(instr('MIS=X', x.op) > 0, slice({bases}, cast(s.q[i] as int) + 1, x.len), null)" if bases else ""
    ops = alignments.withColumn("_ops", cigar_ops("cigar"))
    taken = lambda kinds: sums_before(f"transform(_ops, o -> if(instr('{kinds}', o.op) > 0, cast(o.len as bigint), 0L))")
    both = f"named_struct('q', {taken('MIS=X')}, 'r', {taken('MDN=X')})"
    state = f"transform(array({both}), s -> transform(_ops, (x, i) -> named_struct('len', x.len, 'op', x.op, 'q0', cast(s.q[i] as int), 'r0', pos + s.r[i]{piece})))[0]"
    kept = [c for c in alignments.columns if c != bases]
    return ops.select(*kept, F.posexplode(F.expr(state)).alias("nth", "_o")).select(*kept, "nth", "_o.*")


def pileup_rows(alignments: DataFrame, id_: str, carry: list[str] | None = None) -> DataFrame:
    """(id_, rname, major, minor, symbol): a row per aligned, deleted or inserted base.

    Lower case is the reverse strand, d and D are deletions; reference skips
    and ambiguity codes give nothing. minor counts from 1 within an insertion.
    `carry` names further columns of alignments to keep. Each operation takes
    its stretch of seq along, so no base is looked up from the read's start.
    """
    kept = list(dict.fromkeys([id_, "rname", *(carry or [])]))
    reverse = F.expr("(flag & 16) <> 0")
    reads = alignments.select(*kept, "pos", "cigar", F.when(reverse, "d").otherwise("D").alias("_gap"), F.split(F.translate(F.when(reverse, F.lower("seq")).otherwise(F.upper("seq")), "dD", "nN"), "").alias("_bases"))
    ops = exploded(reads, id_, "_bases").where("op IN ('M', '=', 'X', 'D', 'I')")
    ops = ops.select(*kept, "op", "r0", F.posexplode(F.expr("if(op = 'D', array_repeat(_gap, len), piece)")).alias("k", "symbol"))
    major, minor = F.expr("if(op = 'I', r0 - 1, r0 + k)"), F.expr("if(op = 'I', k + 1, 0)")
    return ops.select(*kept, major.alias("major"), minor.alias("minor"), "symbol").where("symbol IN ('a', 'c', 'g', 't', 'A', 'C', 'G', 'T', 'd', 'D')")


#: Symbols of a pileup by their codes, and the code of each byte of a read (none for other letters, D among them).
_SYMBOLS = np.array(list("acgtACGTdD"))
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(b"acgtACGT", np.uint8)] = range(8)
_EMITS, _CLIPPED = cigars.kinds(b"M=XDI"), cigars.kinds(b"MIS=X")


def _batch_counts(part: pd.DataFrame) -> pd.DataFrame:
    """(row, major, minor, symbol, n) of a batch of rows(group, pos, reverse, cigar, seq); row is the first of its group."""
    seq, ends = cigars.joined(part["seq"])
    row, op, n = cigars.operations(part["cigar"])
    q0 = cigars.sums_before(np.where(_CLIPPED[op], n, 0), row)
    r0 = cigars.sums_before(np.where(cigars.TARGET[op], n, 0), row) + part["pos"].to_numpy(np.int64)[row]
    gap = op == ord("D")
    # no operation takes more than its read has
    n = np.where(gap, n, np.clip(np.diff(ends)[row] - q0, 0, n))
    keep = _EMITS[op] & (n > 0)
    row, op, n, q0, r0, gap = (v[keep] for v in (row, op, n, q0, r0, gap))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inserted, deleted = np.repeat(op == ord("I"), n), np.repeat(gap, n)
    row, r0, at = np.repeat(row, n), np.repeat(r0, n), np.repeat(ends[row] + q0, n) + k
    symbol = np.where(deleted, 8, _CODE[seq[np.minimum(at, max(len(seq) - 1, 0))] if len(seq) else np.zeros(len(at), np.uint8)])
    # codes of one case are four apart, those of gaps one
    reverse = part["reverse"].to_numpy(bool)[row]
    symbol = np.where(symbol == 255, 255, np.where(deleted, 9 - reverse, symbol % 4 + np.where(reverse, 0, 4)))
    major, minor = np.where(inserted, r0 - 1, r0 + k), np.where(inserted, k + 1, 0)
    group = part["group"].to_numpy()[row]
    known = symbol < 10
    group, major, minor, symbol, row = (v[known] for v in (group, major, minor, symbol, row))
    if not len(row):
        return pd.DataFrame()
    order = np.lexsort((symbol, minor, major, group))
    new = np.zeros(len(order), bool)
    new[0] = True
    for v in (group, major, minor, symbol):
        new[1:] |= np.diff(v[order]) != 0
    start = np.flatnonzero(new)
    first = order[start]
    return pd.DataFrame({"row": row[first], "major": major[first], "minor": minor[first], "symbol": _SYMBOLS[symbol[first]], "n": np.diff(start, append=len(order))})


def pileup(alignments: DataFrame, id_: str, strata: list[str] | None = None) -> DataFrame:
    """(rname, major, minor, symbol, n), by further columns `strata` of alignments if given.

    Counts of pileup_rows(), made in each batch before they are added up, so that no base is a row.
    Alignments without a place have none.
    """
    ship(alignments.sparkSession)
    by = list(dict.fromkeys(["rname", *(strata or [])]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in cigars.chunks(pdf, "cigar", "seq"):
                found = _batch_counts(part.assign(group=part.groupby(by, dropna=False, sort=False).ngroup()))
                if len(found):
                    head = part[by].iloc[found["row"].to_numpy()].reset_index(drop=True)
                    yield pd.concat([head, found[["major", "minor", "symbol", "n"]]], axis=1)

    reverse = F.coalesce(F.expr("(flag & 16) <> 0"), F.lit(False)).alias("reverse")
    rows = alignments.where(F.col("pos").isNotNull()).select(*by, F.col("pos").cast("bigint").alias("pos"), reverse, "cigar", "seq")
    kinds = ", ".join(f"`{c}` {alignments.schema[c].dataType.simpleString()}" for c in by)
    found = rows.mapInPandas(count, f"{kinds}, major bigint, minor int, symbol string, n bigint")
    keys = ["rname", "major", "minor", "symbol", *[c for c in by if c != "rname"]]
    return found.groupBy(*keys).agg(F.sum("n").alias("n"))


def datatypes(alignments: DataFrame, id_: str, known: list[str], tag: str = "DT") -> tuple[DataFrame, DataFrame]:
    """(typed, violations): alignments with dtype, the place of their tag's value in `known`; those of no known type.

    With one known type, or none, all are of type 0 and no tag is asked for.
    violations(id_, reason) must be empty before strata of a pileup are counted.
    """
    if len(known) < 2:
        return alignments.withColumn("dtype", F.lit(0)), alignments.where("false").select(id_, F.lit("").alias("reason"))
    value = F.col("tags")[tag]
    at = F.coalesce(F.array_position(F.lit(list(known)), value), F.lit(0)).cast("int")
    reason = F.when(value.isNull(), f"{tag} is missing").otherwise(F.concat(F.lit(f"unknown {tag} "), value))
    return alignments.where(at > 0).withColumn("dtype", at - 1), alignments.where(at == 0).select(id_, reason.alias("reason"))


def depth_features(counts: DataFrame, mode: str = "total") -> DataFrame:
    """Adds depth (of the major position, also at its minors) and feature = n / depth.

    mode: total, fwd_rev (depth by strand) or none (feature = n).
    """
    reverse = F.col("symbol") == F.lower("symbol")
    keys = ["rname", "major"]
    if mode == "fwd_rev":
        counts, keys = counts.withColumn("_rev", reverse), [*keys, "_rev"]
    # counts are made once: a position's symbols are a few rows, and keys with nulls have no depth, as in a join
    depth = F.sum(F.when(F.col("minor") == 0, F.col("n"))).over(Window.partitionBy(*keys))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    out = counts.withColumn("depth", F.coalesce(F.when(known, depth), F.lit(0)))
    feature = F.col("n").cast("double") if mode == "none" else F.col("n") / F.greatest("depth", F.lit(1))
    return out.withColumn("feature", feature).drop("_rev")


def fill_symmetric_indels(counts: DataFrame) -> DataFrame:
    """Adds, at each minor position, deletions for the reads of that strand without the insertion."""
    lower = F.col("symbol") == F.lower("symbol")
    counts = counts.withColumn("rev", lower)
    depth = counts.where("minor = 0").groupBy("rname", "major", "rev").agg(F.sum("n").alias("depth"))
    have = counts.where("minor > 0").groupBy("rname", "major", "minor", "rev").agg(F.sum("n").alias("have"))
    columns = counts.where("minor > 0").select("rname", "major", "minor").distinct()
    fill = columns.join(depth, ["rname", "major"]).join(have, ["rname", "major", "minor", "rev"], "left").withColumn("n", F.col("depth") - F.coalesce("have", F.lit(0))).where("n > 0")
    return counts.drop("rev").unionByName(fill.select("rname", "major", "minor", F.when(F.col("rev"), "d").otherwise("D").alias("symbol"), "n"))


def vote(counts: DataFrame, keys: list[str], symbol: str, n: str, target: str, min_support: int = 2, aligned: str | None = None) -> DataFrame:
    """(keys, consensus, support): the symbol with most support.

    Needs min_support, else the target's symbol; of equal ones the target's
    wins, then the least symbol. Where `aligned`, the number of alignments of a
    window, is given, windows of fewer than two have no rows.
    """
    if aligned is not None:
        counts = counts.where(F.col(aligned) >= 2)
    w = Window.partitionBy(*keys).orderBy(F.desc(n), F.desc(F.col(symbol) == F.col(target)), F.asc(symbol))
    top = counts.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    chosen = F.when(F.col(n) >= min_support, F.col(symbol)).otherwise(F.col(target))
    return top.select(*keys, chosen.alias("consensus"), F.col(n).alias("support"))


def supported_columns(counts: DataFrame, keys: list[str], n: str, reads: int = 3, symbols: int = 2) -> DataFrame:
    """Keys of columns where at least `symbols` symbols have `reads` reads each."""
    return counts.groupBy(*keys).agg(F.count_if(F.col(n) >= reads).alias("symbols")).where(F.col("symbols") >= symbols)


def max_insertions(alignments: DataFrame, id_: str) -> DataFrame:
    """(rname, major, longest insertion after it)."""
    return exploded(alignments, id_).where("op = 'I'").groupBy("rname", (F.col("r0") - 1).alias("major")).agg(F.max("len").alias("inserted"))


def cut_to_query(alignments: DataFrame, id_: str, start: str, end: str) -> DataFrame:
    """(id_, cigar, pos): the part of each alignment for query bases [start, end).

    Operations at the ends that take no query are dropped; pos is where the
    first kept one begins.
    """
    ops = exploded(alignments, id_).withColumn("takes", F.expr("instr('MIS=X', op) > 0"))
    kept = ops.withColumn("n", F.expr(f"if(takes, greatest(0, least(q0 + len, {end}) - greatest(q0, {start})), if(q0 > {start} AND q0 < {end}, len, 0))")).where("n > 0")
    kept = kept.withColumn("r", F.expr(f"r0 + if(takes AND instr('M=X', op) > 0, greatest(0, {start} - q0), 0)"))
    rows = kept.groupBy(id_).agg(F.sort_array(F.array_agg(F.struct("nth", "n", "op", "r", "takes"))).alias("x"))
    rows = rows.withColumn("x", F.expr("slice(x, greatest(1, array_position(transform(x, o -> o.takes), true)), size(x))"))
    rows = rows.withColumn("x", F.expr("slice(x, 1, size(x) - greatest(1, array_position(reverse(transform(x, o -> o.takes)), true)) + 1)"))
    return rows.where("size(x) > 0").select(id_, F.expr("array_join(transform(x, o -> concat(o.n, o.op)), '')").alias("cigar"), F.expr("x[0].r").alias("pos"))


def overlap_windows(overlaps: DataFrame, id_: str, size: int) -> DataFrame:
    """(id_, win, matches, mismatches, ins, del, longest indel, accuracy) per window of the target.

    overlaps: id_, pos, cigar, tlen, a row for each overlap. A run that crosses a border is cut there.
    First and last windows count only if the overlap reaches within a tenth of
    the window's far border; overlaps shorter than a window are dropped. A row's windows are
    made in its batch, so nothing is shuffled.
    """
    ship(overlaps.sparkSession)
    counts = {"matches": b"M=", "mismatches": b"X", "ins": b"I", "del": b"D"}
    tables = {n: cigars.kinds(c) for n, c in counts.items()}
    indel = cigars.kinds(b"ID")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in cigars.chunks(pdf, "cigar"):
                row, op, n = cigars.operations(part["cigar"])
                takes = cigars.TARGET[op]
                at = cigars.sums_before(np.where(takes, n, 0), row) + part["pos"].to_numpy(np.int64)[row]
                end = at + np.where(takes, n, 0)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if not len(first):
                    continue
                ops = np.diff(first, append=len(row))
                t0, t1 = np.repeat(at[first], ops), np.repeat(np.maximum.reduceat(end, first), ops)
                long = t1 - t0 >= size
                row, op, n, takes, at, end, t0, t1 = (v[long] for v in (row, op, n, takes, at, end, t0, t1))
                if not len(row):
                    continue
                # an operation is in all windows that it touches
                low = at // size
                times = np.maximum(np.where(takes, end - 1, at) // size, low) - low + 1
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, op, n, takes, at, end, t0, t1 = (np.repeat(v, times) for v in (row, op, n, takes, at, end, t0, t1))
                win = np.repeat(low, times) + nth
                cut = np.where(takes, np.minimum(end, (win + 1) * size) - np.maximum(at, win * size), n)
                # windows of a row come in order
                start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(win, prepend=0) != 0))
                out = {c: np.add.reduceat(np.where(t[op], cut, 0), start) for c, t in tables.items()}
                out["longest_indel"] = np.maximum.reduceat(np.where(indel[op], n, 0), start)
                row, win, t0, t1 = (v[start] for v in (row, win, t0, t1))
                # tenths and halves are no whole numbers
                tlen = part["tlen"].to_numpy(np.int64)[row]
                reach = (t0 <= win * size + size / 10) & (t1 >= np.minimum(tlen, (win + 1) * size) - size / 10)
                yield pd.DataFrame({"id": part["id"].to_numpy()[row], "win": win, **out})[reach]

    kind = overlaps.schema[id_].dataType.simpleString()
    rows = overlaps.select(F.col(id_).alias("id"), F.col("pos").cast("bigint").alias("pos"), "cigar", F.col("tlen").cast("bigint").alias("tlen")).where("id IS NOT NULL AND pos IS NOT NULL AND tlen IS NOT NULL")
    found = rows.mapInPandas(windows, f"id {kind}, win bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", longest_indel int")
    return found.select(F.col("id").alias(id_), "win", *counts, "longest_indel", F.expr("try_divide(matches, matches + mismatches + ins + del)").alias("accuracy"))


def top_overlaps(windows: DataFrame, keys: list[str], name: str, k: int = 30, max_indel: int = 30) -> DataFrame:
    """The k most accurate rows of each window without an indel of max_indel; near ties go by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("accuracy", 10)), name)
    return windows.where(F.col("longest_indel") < max_indel).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def piles(overlaps: DataFrame, order: str) -> DataFrame:
    """Overlaps(target, query, tstart, tend, tlen, qstart, qend, qlen): no self hits, first of a pair, consistent."""
    ok = overlaps.where("target <> query AND tstart >= 0 AND tstart <= tend AND tend <= tlen AND qstart >= 0 AND qstart <= qend AND qend <= qlen")
    w = Window.partitionBy("target", "query").orderBy(order)
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def relabel_minors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Minor columns without any base go; those left are numbered anew from 0."""
    used = rows.groupBy(*keys, "major", "minor").agg(F.bool_or(F.lower("symbol") != "d").alias("_used"))
    left = used.where("_used OR minor = 0").withColumn("_minor", F.dense_rank().over(Window.partitionBy(*keys, "major").orderBy("minor")) - 1)
    return rows.join(left.drop("_used"), [*keys, "major", "minor"]).withColumn("minor", F.col("_minor")).drop("_minor")


def read_slots(alignments: DataFrame, id_: str, group: str, start: str, end: str, tile: int, max_reads: int | None = None, gap: int = 5) -> DataFrame:
    """(group, tile, id_, slot, placed): the matrix row of each read in each tile of `tile` places that it touches.

    Reads [start, end) come by (start, id_, end). A read takes the first slot whose
    last read ended `gap` or more before, else a new one, of which there are at
    most max_reads. Where all are taken it waits and is placed from the first
    place on at which one is free and it has not ended; one that never is has
    null slot and place. Each tile is dealt anew, as a window of the features
    is. A tile's rows stream by in order; a task holds its slots and the reads
    that wait. Reads without group or places, and empty ones, have no row.
    """
    ship(alignments.sparkSession)
    kinds = {c: alignments.schema[c].dataType.simpleString() for c in (group, id_)}
    rows = alignments.where(F.col(start) < F.col(end)).where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(id_).alias("id"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))
    rows = rows.withColumn("tile", F.explode(F.expr(f"sequence(start div {tile}, (end - 1) div {tile})")))
    dealt = rows.repartition("g", "tile").sortWithinPartitions("g", "tile", "start", "id", "end")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        ends: list[int] = []
        waiting: deque = deque()
        out: list[tuple] = []

        def take(read: tuple, at: int) -> bool:
            slot = next((i for i, e in enumerate(ends) if at >= e + gap), len(ends))
            if slot == len(ends):
                if max_reads is not None and slot >= max_reads:
                    return False
                ends.append(0)
            ends[slot] = read[1]
            out.append((*now, read[0], slot, at))
            return True

        def serve(until: int | None) -> None:
            while waiting:
                free = min(ends, default=0) + gap
                if until is not None and free > until:
                    return
                # the end lies ahead of a waiting read's own start, so `free` does too
                read = waiting.popleft()
                if max_reads == 0 or read[1] <= free or free >= (now[1] + 1) * tile:
                    out.append((*now, read[0], None, None))
                else:
                    take(read, max(free, read[2]))

        for pdf in batches:
            for g, name, first, last, nth in zip(pdf["g"], pdf["id"], pdf["start"], pdf["end"], pdf["tile"]):
                if (g, nth) != now:
                    serve(None)
                    now, ends = (g, nth), []
                at = max(first, nth * tile)
                serve(at)
                if waiting or not take((name, last), at):
                    waiting.append((name, last, at))
            yield pd.DataFrame(out, columns=["g", "tile", "id", "slot", "placed"]).astype({"slot": "Int64", "placed": "Int64"})
            out.clear()
        serve(None)
        yield pd.DataFrame(out, columns=["g", "tile", "id", "slot", "placed"]).astype({"slot": "Int64", "placed": "Int64"})

    return dealt.mapInPandas(deal, f"g {kinds[group]}, tile bigint, id {kinds[id_]}, slot bigint, placed bigint").toDF(group, "tile", id_, "slot", "placed")


def dwells(moves: str, cap: int = 127) -> Column:
    """Moves spent on each base, at most cap."""
    at = f"array_append(filter(transform({moves}, (m, i) -> if(m = 1, i, null)), x -> x IS NOT NULL), size({moves}))"
    return F.expr(f"transform(sequence(1, size({at}) - 1), i -> least({cap}, {at}[i] - {at}[i - 1]))")
