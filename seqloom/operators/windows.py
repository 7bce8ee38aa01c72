"""Greedy windows: around candidates, under a column limit, and tiles with their neighbours."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.intervals import overlap_pairs
from seqloom.session import ship

#: Fixed value: the least flank a window keeps around its candidate.
LEAST_FLANK = 3


def candidate_windows(columns: DataFrame, candidates: DataFrame, key: str, size: int, flank: int) -> DataFrame:
    """(key, position, flank, first, last): windows of `size` columns around candidate positions.

    columns(key, col, major): a gapless column number and its position.
    Candidates(key, position) are taken in order; one that the window before
    covers up to its flank is skipped. The flank shrinks until the window holds
    the candidate with as much on its right, down to LEAST_FLANK; a candidate
    for which that fails, or whose window passes the last column, has none.
    Candidates over 2 * size apart can't cover one another, so each island of
    closer ones is a group of its own with its stretch of columns.
    """
    if not 0 <= flank <= size:
        raise ValueError("the flank lies between 0 and the window size")
    w = Window.partitionBy(key).orderBy("position")
    c = candidates.select(key, "position").distinct()
    c = c.withColumn("_n", F.when(F.col("position") - F.lag("position").over(w) <= 2 * size, 0).otherwise(1)).withColumn("island", F.sum("_n").over(w)).drop("_n")
    spans = c.groupBy(key, "island").agg((F.min("position") - flank).alias("b_start"), (F.max("position") + 2 * size + 1).alias("b_end"))
    near = overlap_pairs(columns.select(key, "col", F.col("major").alias("start"), (F.col("major") + 1).alias("end")), spans, [key], 4 * size).select(F.col(key).alias(key), F.col("island").alias("island"), "col", F.col("start").alias("major"))
    kind = columns.schema[key].dataType.simpleString()

    def greedy(cand: pd.DataFrame, cols: pd.DataFrame) -> pd.DataFrame:
        cols = cols.sort_values("col")
        major, number = cols["major"].tolist(), cols["col"].tolist()
        rows, covered = [], None
        for p in sorted(cand["position"].tolist()):
            if covered is not None and p < covered:
                continue
            for f in range(flank, LEAST_FLANK - 1, -1):
                a = bisect_left(major, p - f)
                if a + size >= len(major):
                    break
                if p <= major[a + size] - f:
                    rows.append((cand[key].iloc[0], p, f, number[a], number[a + size - 1]))
                    covered = major[a + size - 1] + 1 - f
                    break
        return pd.DataFrame(rows, columns=[key, "position", "flank", "first", "last"])

    ship(columns.sparkSession)
    return c.groupBy(key, "island").cogroup(near.groupBy(key, "island")).applyInPandas(greedy, f"{key} {kind}, position bigint, flank int, first bigint, last bigint")


def column_limited_windows(steps: DataFrame, target: str, size: int, max_columns: int) -> DataFrame:
    """(target, start, end, columns): windows of at most `size` positions and max_columns columns.

    steps(target, pos, step): columns that each position takes, 1 and its
    longest insertion. A window ends before the position that would exceed the
    limit; a position that alone exceeds it is a window of its own. A target is
    one read, so its steps fit one group.
    """
    kind = steps.schema[target].dataType.simpleString()

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows, start, used = [], None, 0
        last = None
        for pos, step in zip(pdf["pos"].tolist(), pdf["step"].tolist(), strict=True):
            if start is not None and (pos - start >= size or used + step > max_columns or pos != last + 1):
                rows.append((pdf[target].iloc[0], start, last + 1, used))
                start, used = None, 0
            if start is None:
                start = pos
            used += step
            last = pos
        if start is not None:
            rows.append((pdf[target].iloc[0], start, last + 1, used))
        return pd.DataFrame(rows, columns=[target, "start", "end", "columns"])

    ship(steps.sparkSession)
    return steps.groupBy(target).applyInPandas(cut, f"{target} {kind}, start bigint, end bigint, columns bigint")


def edge_flags(columns: DataFrame, keys: list[str], tile: str, n: int, min_coverage: int, fraction: float) -> DataFrame:
    """(keys, tile, left, right): whether a tile's edges call for its neighbours.

    columns(keys, tile, major, minor, depth, deletions). An edge does if its
    outermost column is a minor one and a column of its n outermost major
    positions has deletions of max(min_coverage, fraction of the top depth).
    """
    w = Window.partitionBy(*keys, tile)
    c = columns.withColumns({
        "_need": F.greatest(F.lit(min_coverage), F.floor(F.max("depth").over(w) * fraction)),
        "_a": F.row_number().over(w.orderBy("major", "minor")),
        "_z": F.row_number().over(w.orderBy(F.desc("major"), F.desc("minor"))),
    })
    c = c.withColumns({"_ma": F.sum((F.col("minor") == 0).cast("int")).over(w.orderBy("major", "minor")), "_mz": F.sum((F.col("minor") == 0).cast("int")).over(w.orderBy(F.desc("major"), F.desc("minor")))})
    many = (F.col("minor") == 0) & (F.col("deletions") >= F.col("_need"))
    side = lambda first, rank: F.bool_or((F.col(first) == 1) & (F.col("minor") > 0)) & F.bool_or(many & (F.col(rank) <= n))
    return c.groupBy(*keys, tile).agg(side("_a", "_ma").alias("left"), side("_z", "_mz").alias("right"))


def kept_tiles(tiles: DataFrame, keys: list[str], tile: str) -> DataFrame:
    """Tiles(keys, tile, candidate, left, right) that hold a candidate or are pulled in.

    A kept tile pulls its neighbour where its edge flag says so, and a pulled
    one the next in the same direction. Seen from a tile: every tile from the
    nearest one with a candidate up to its neighbour has the flag.
    """
    out = tiles
    for flag, order in (("right", F.asc(tile)), ("left", F.desc(tile))):
        w = Window.partitionBy(*keys).orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_fails", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(upto))
        # failures up to the tile before the nearest candidate, and up to the last neighbour
        out = out.withColumn("_from", F.col("_fails") - F.when(F.col(flag), 0).otherwise(1))
        start = F.last(F.when(F.col("candidate"), F.col("_from")), ignorenulls=True).over(before)
        out = out.withColumn(f"_by_{flag}", F.coalesce(F.max("_fails").over(before) == start, F.lit(False)))
    pulled = F.col("_by_right") | F.col("_by_left")
    return out.where(F.col("candidate") | pulled).withColumn("pulled", ~F.col("candidate")).select(*keys, tile, "pulled")


def pair_consensus(pairs: DataFrame, pair_id: str, run: int = 11, band: int = 64) -> DataFrame:
    """(pair_id, seq, qual) from pairs(pair_id, t_seq, t_qual, c_seq, c_qual).

    Qualities are pooled to the least of 5 neighbours; the complement is turned
    and aligned to the template within a band; the alignment is cut to between
    its first and last `run` matches in a row; each column takes the base of
    higher quality, a gap having that of its neighbour. No such run gives no row.
    """
    kind = pairs.schema[pair_id].dataType.simpleString()
    turn = str.maketrans("ACGTacgt", "TGCAtgca")

    def pooled(q: str) -> list[int]:
        v = [ord(c) - 33 for c in q]
        return [min(v[max(0, i - 2) : i + 3]) for i in range(len(v))]

    def align(a: str, b: str) -> list[tuple[int, int]]:
        """Columns (index in a or -1, index in b or -1) of least edits within the band."""
        slope = len(b) / max(1, len(a))
        rows, back = [{0: 0}], [{}]
        for j in range(1, min(len(b), band) + 1):
            rows[0][j] = j
            back[0][j] = (0, -1)
        for i in range(1, len(a) + 1):
            mid, row, step = int(i * slope), {}, {}
            for j in range(max(0, mid - band), min(len(b), mid + band) + 1):
                options = [(rows[-1][j - 1] + (a[i - 1] != b[j - 1]), (-1, -1))] if j and j - 1 in rows[-1] else []
                if j in rows[-1]:
                    options.append((rows[-1][j] + 1, (-1, 0)))
                if j - 1 in row:
                    options.append((row[j - 1] + 1, (0, -1)))
                if options:
                    row[j], step[j] = min(options)
            rows.append(row)
            back.append(step)
        i, j, out = len(a), len(b), []
        if j not in rows[-1]:
            return []
        while i or j:
            di, dj = back[i][j]
            out.append((i - 1 if di else -1, j - 1 if dj else -1))
            i, j = i + di, j + dj
        return out[::-1]

    def run_batches(batches):
        for pdf in batches:
            rows = []
            for p, ts, tq, cs, cq in zip(pdf["p"], pdf["t_seq"], pdf["t_qual"], pdf["c_seq"], pdf["c_qual"], strict=True):
                other, qa, qb = cs.translate(turn)[::-1], pooled(tq), pooled(cq)[::-1]
                cols = align(ts, other)
                same = "".join("1" if i >= 0 and j >= 0 and ts[i] == other[j] else "0" for i, j in cols)
                first, last = same.find("1" * run), same.rfind("1" * run)
                if first < 0:
                    continue
                seq, qual, la, lb = [], [], 0, 0
                for i, j in cols[first : last + run]:
                    la, lb = (i if i >= 0 else la), (j if j >= 0 else lb)
                    x, y, u, v = (ts[i] if i >= 0 else ""), (other[j] if j >= 0 else ""), qa[la], qb[lb]
                    if x == y:
                        seq.append(x)
                        qual.append(chr(33 + max(u, v)))
                    elif base := (x if u >= v else y):
                        seq.append(base)
                        qual.append(chr(33 + max(u, v)))
                rows.append((p, "".join(seq), "".join(qual)))
            yield pd.DataFrame(rows, columns=["p", "seq", "qual"])

    ship(pairs.sparkSession)
    return pairs.select(F.col(pair_id).alias("p"), "t_seq", "t_qual", "c_seq", "c_qual").mapInPandas(run_batches, f"p {kind}, seq string, qual string").withColumnRenamed("p", pair_id)
