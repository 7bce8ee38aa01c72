"""Concatemer splitting: seven rules in a fixed order, each on the parts of the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.placement import place
from seqloom.functions.scalars import derived_uuid
from seqloom.session import ship, table


@dataclass(frozen=True)
class Settings:
    """Lengths in bases, edit distances and error shares of the rules."""

    adapter: str = "TACTTCGTTCAGTTACGTATTGCT"
    adapter_edits: int = 4
    relaxed_adapter_edits: int = 8
    flank_error: float = 0.15
    relaxed_flank_error: float = 0.275
    end_flank: int = 1200
    end_trim: int = 200
    start_flank: int = 1700
    min_flank: int = 300
    adapter_span: int = 50
    adapter_prefix: int = 200
    middle_span: int = 1000
    middle_share: float = 0.2
    muA: str = "GTTTTCGCATTTATCGTGAAACGCTTTCGCGTTTTTCGTGCGCCGCTTCA"
    muA_edits: int = 11
    muA_adapter: str = "TACTTCGTTCAGTT"
    muA_adapter_edits: int = 5


def turned(text: str) -> str:
    return f"reverse(translate({text}, 'ACGTacgt', 'TGCAtgca'))"


def with_flank(df: DataFrame, s: Settings, first: str, last: str, error: float) -> DataFrame:
    """Adds flank: whether the turned sequence left of [first, last) lies right of it, and m: where."""
    a, b = f"greatest(0, {first} - {s.end_flank})", f"({first} - {s.end_trim})"
    end = f"least(length(seq), {last} + {s.start_flank} + {last} - {first})"
    usable = f"{first} > {s.end_trim} AND {last} < length(seq) AND {b} - {a} >= {s.min_flank} AND {end} - {first} >= {b} - {a}"
    df = df.withColumns({"_q": F.expr(f"if({usable}, {turned(f'substr(seq, {a} + 1, {b} - {a})')}, null)"), "_t": F.expr(f"if({usable}, substr(seq, {first} + 1, {end} - {first}), null)")})
    df = df.withColumn("m", place(F.col("_q"), F.col("_t")))
    return df.withColumn("flank", F.expr(f"coalesce(m.dist <= round({error} * length(_q)), false)")).drop("_q", "_t")


def with_adapter(df: DataFrame, pattern: str, first: str, last: str, edits: int) -> DataFrame:
    """Adds adapter: the struct of the best placement in [first, last) if within edits, in the part's bases."""
    df = df.withColumn("_w", F.expr(f"substr(seq, greatest(0, {first}) + 1, greatest(0, least(length(seq), {last}) - greatest(0, {first})))")).withColumn("_p", place(F.lit(pattern), F.col("_w")))
    return df.withColumn("adapter", F.expr(f"if(_p.dist <= {edits}, struct(greatest(0, {first}) + _p.start AS start, greatest(0, {first}) + _p.end AS end), null)")).drop("_w", "_p")


def adapter_matches(parts: DataFrame, s: Settings) -> DataFrame:
    """A row for each stretch of a part with an adapter, past its expected place at the start.

    The part is cut into overlapping stretches of four adapters; the best
    placement of each counts, once.
    """
    n = len(s.adapter)
    cut = parts.withColumn("_at", F.explode(F.expr(f"sequence({s.adapter_prefix}, greatest({s.adapter_prefix}, length(seq) - {n}), {2 * n})")))
    found = with_adapter(cut, s.adapter, "_at", f"_at + {4 * n}", s.adapter_edits).where("adapter IS NOT NULL").drop("_at")
    return found.dropDuplicates(["part_id", "adapter"])


def merged(spacers: DataFrame, distance: int) -> DataFrame:
    """Spacers(part_id, first, last) closer than distance as one."""
    w = Window.partitionBy("part_id").orderBy("first", "last")
    so_far = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = spacers.withColumn("_n", F.when(F.col("first") <= so_far + distance, 0).otherwise(1)).withColumn("_i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("part_id", "_i").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_i")


def cut_parts(parts: DataFrame, spacers: DataFrame, rule: str) -> DataFrame:
    """Parts(read_id, part_id, offset, seq, end_reason, rule) without their spacers.

    New parts get ids from their parent's and place; only the last keeps the
    end reason. Parts without spacers stay as they are.
    """
    cuts = spacers.groupBy("part_id").agg(F.sort_array(F.array_agg(F.struct("first", "last"))).alias("_s"))
    x = parts.join(cuts, "part_id", "left")
    whole = x.where("_s IS NULL").select(*parts.columns)
    edges = "filter(transform(sequence(0, size(_s)), i -> struct(if(i = 0, 0, _s[i - 1].last) AS a, if(i = size(_s), length(seq), _s[i].first) AS b)), e -> e.b > e.a)"
    y = x.where("_s IS NOT NULL").withColumn("_e", F.expr(edges)).select("read_id", "part_id", "offset", "seq", "end_reason", F.size("_e").alias("_n"), F.posexplode("_e").alias("_i", "_x"))
    made = y.select("read_id", derived_uuid("part_id", "_i").alias("part_id"), (F.col("offset") + F.col("_x.a")).alias("offset"), F.expr("substr(seq, _x.a + 1, _x.b - _x.a)").alias("seq"), F.when(F.col("_i") == F.col("_n") - 1, F.col("end_reason")).alias("end_reason"), F.lit(rule).alias("rule"))
    # each rule reads the parts twice, so their plan ends here
    return table(whole.unionByName(made), "parts")


def split(reads: DataFrame, gaps: DataFrame, s: Settings | None = None, rapid: Column | None = None, spikes: DataFrame | None = None, simplex: bool = False) -> DataFrame:
    """Parts of reads(read_id, seq, end_reason) after the seven rules.

    gaps(read_id, g_start, g_end): candidate pore regions in bases, as
    series.threshold_clusters and series.top_regions give them. rapid: condition
    of rapid chemistry; for those, spikes(read_id, first, last) of low quality
    near a muA stretch and an adapter split too. Without simplex mode flanks are
    compared as well: what follows a strand's end must be its turned self.
    """
    s = s or Settings()
    ship(reads.sparkSession)
    far = s.end_flank + s.start_flank
    parts = reads.select("read_id", F.col("read_id").cast("string").alias("part_id"), F.lit(0).alias("offset"), "seq", "end_reason", F.lit(None).cast("string").alias("rule"))

    def pores(p: DataFrame) -> DataFrame:
        """Pore regions that lie within a part, in the part's bases."""
        met = p.join(gaps, "read_id").withColumns({"first": F.col("g_start") - F.col("offset"), "last": F.col("g_end") - F.col("offset")})
        return met.where("first >= 0 AND last <= length(seq) AND first <= last")

    out = lambda df: df.select("part_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    near = lambda df, e: with_adapter(df, s.adapter, "first", f"last + {s.adapter_span}", e).where("adapter IS NOT NULL")

    parts = cut_parts(parts, out(near(pores(parts), s.adapter_edits)), "PORE_ADAPTER")
    if rapid is not None and spikes is not None:
        fast = reads.where(rapid).select("read_id")
        x = parts.join(fast, "read_id", "left_semi").join(spikes.withColumnsRenamed({"first": "_f", "last": "_l"}), "read_id").withColumns({"first": F.col("_f") - F.col("offset"), "last": F.col("_l") - F.col("offset")}).where("first >= 0 AND last <= length(seq) AND length(seq) >= 200")
        x = with_adapter(x, s.muA, "greatest(100, first)", "last + 300", s.muA_edits).where("adapter IS NOT NULL").withColumn("_m", F.col("adapter.start")).drop("adapter")
        x = with_adapter(x, s.muA_adapter, "greatest(100, _m - 100)", f"_m + {len(s.muA_adapter) + s.muA_adapter_edits}", s.muA_adapter_edits).where("adapter IS NOT NULL AND adapter.start >= 50")
        parts = cut_parts(parts, out(x.dropDuplicates(["part_id", "first", "last"])), "MUA_SPIKE")
    if simplex:
        return parts
    parts = cut_parts(parts, merged(out(with_flank(pores(parts), s, "first", "last", s.flank_error).where("flank")), far), "PORE_FLANK")
    parts = cut_parts(parts, merged(out(with_flank(near(pores(parts), s.relaxed_adapter_edits), s, "first", "last", s.relaxed_flank_error).where("flank")), far), "PORE_ALL")
    at = adapter_matches(parts, s).withColumns({"first": F.col("adapter.start"), "last": F.col("adapter.end")})
    parts = cut_parts(parts, out(with_flank(at, s, "first", "first", s.flank_error).where("flank")), "ADAPTER_FLANK")

    ends = f"length(seq) - {s.end_flank}"
    start_end = lambda df, upto: df.withColumn("o", place(F.expr(f"if(length(seq) >= {s.end_flank}, {turned(f'substr(seq, {ends} + 1, {s.end_flank - s.end_trim})')}, null)"), F.expr(f"left(seq, {upto})"))).withColumn("outer", F.expr(f"coalesce(o.dist <= round({s.flank_error} * {s.end_flank - s.end_trim}), false)"))
    span = f"cast(greatest({s.middle_span}, round({s.middle_share} * length(seq))) AS int)"
    mid = with_adapter(parts.where(f"length(seq) >= {span}"), s.adapter, f"length(seq) div 2 - {span} div 2", f"length(seq) div 2 + {span} div 2", s.relaxed_adapter_edits).where("adapter IS NOT NULL")
    mid = mid.withColumns({"first": F.col("adapter.start"), "stop": F.col("adapter.end")})
    mid = start_end(with_flank(mid, s, "first", "first", s.flank_error).where("flank"), s.start_flank)
    short = f"stop + {s.end_flank} > length(seq) OR least({s.start_flank}, first) < {s.end_flank - s.end_trim}"
    parts = cut_parts(parts, out(mid.where(f"({short}) OR outer").withColumns({"last": F.col("first"), "first": F.col("first") - 1})), "ADAPTER_MIDDLE")

    ext = f"cast(greatest(0.1 * length(seq), {s.start_flank}) AS int)"
    both = start_end(parts.where(f"{ext} + {s.end_flank} <= length(seq)"), ext).where(f"outer AND o.end + {s.end_flank} <= length(seq)")
    both = both.withColumn("_c", F.expr(f"(o.end + {ends}) div 2")).withColumn("_g", F.expr("cast(greatest(100, 0.05 * length(seq)) AS int)"))
    both = both.withColumns({"first": F.expr("cast(_c - _g AS int)"), "last": F.expr("cast(_c + _g AS int)")})
    both = with_flank(both, s, "first", "last", s.flank_error).where("flank")
    both = both.withColumn("_c", F.expr(f"(first - {s.end_trim} + first + m.start) div 2"))
    return cut_parts(parts, out(both.withColumns({"first": F.col("_c") - 1, "last": F.col("_c")})), "SPLIT_MIDDLE")
