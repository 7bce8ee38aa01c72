"""Variants from consensus columns: joined samples, islands, merged alleles, normal form, reference rows.

Columns are rows (keys, sample, major, minor, ref, calls, logp, ref_logp): one for each
position of a sample. `minor` counts inserted columns after a major one; `ref` is the draft's
base, `*` on inserted columns; `calls` has the symbol of each haplotype and `logp` the log
probabilities of those; `ref_logp` is the greatest log probability of the reference symbol over
the haplotypes. Samples of a key don't overlap.

Windows stay within a sample, which is a window of the inference; along a contig
only one row a sample is scanned, in tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import scans
from seqloom.session import table

#: Symbols of the label scheme, and the cap of a quality.
SYMBOLS = "*ACGT"
CAP = 70.0
#: Probabilities are taken for at least this in logarithms.
LEAST_P = 1e-10


def columns_of(probs: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Columns from probs(keys, sample, major, minor, hap, symbol, prob) and drafts(keys, draft).

    Each haplotype calls its likeliest symbol, of equal ones the first in
    SYMBOLS. A reference base outside of them counts as `*` in its own probability. The
    draft is cut to the samples' own stretches once, so no row carries a contig.
    """
    at = [*keys, "sample", "major", "minor"]
    spans = probs.groupBy(*keys, "sample").agg(F.min("major").alias("_lo"), F.max("major").alias("_hi"))
    slices = spans.join(drafts.select(*keys, "draft"), keys).select(*keys, "sample", "_lo", F.expr("substring(draft, cast(_lo + 1 as int), cast(_hi - _lo + 1 as int))").alias("_slice"))
    rank = F.instr(F.lit(SYMBOLS), F.col("symbol"))
    p = F.log(F.greatest(F.col("prob").cast("double"), F.lit(LEAST_P)))
    # the slice meets haplotypes, not symbols: one row for each of a column's
    haps = probs.groupBy(*at, "hap").agg(F.max_by(F.struct("symbol", p.alias("p")), F.struct("prob", -rank)).alias("_top"), F.array_agg(F.struct("symbol", p.alias("p"))).alias("_all"))
    wide = haps.groupBy(*at).agg(F.sort_array(F.array_agg(F.struct("hap", "_top", "_all"))).alias("_h"))
    wide = wide.join(slices, [*keys, "sample"]).withColumn("ref", F.expr("if(minor = 0, substring(_slice, cast(major - _lo + 1 as int), 1), '*')"))
    return wide.select(*at, "ref", F.expr("transform(_h, x -> x._top.symbol)").alias("calls"), F.expr("transform(_h, x -> x._top.p)").alias("logp"), F.expr("array_max(transform(_h, x -> coalesce(filter(x._all, y -> y.symbol = if(instr('*ACGT', ref) > 0, ref, '*'))[0].p, ln(1e-10))))").alias("ref_logp"))


def mark(columns: DataFrame, keys: list[str], ambiguous: bool = True) -> DataFrame:
    """Adds `i`, the place within the sample, and is_variant.

    A major column is a variant if a call differs from ref; an inserted one also if its
    major or another insertion there does. The first column of a sample counts
    for itself. Without `ambiguous`, columns whose ref isn't in SYMBOLS are none.
    """
    own = F.exists("calls", lambda c: c != F.col("ref"))
    sample = Window.partitionBy(*keys, "sample")
    rows = columns.withColumn("i", F.row_number().over(sample.orderBy("major", "minor")) - 1).withColumn("_own", own)
    group = F.max("_own").over(Window.partitionBy(*keys, "sample", "major"))
    # which haplotype differs doesn't matter, as a column is a variant for any
    found = F.when((F.col("minor") == 0) | (F.col("i") == 0), F.col("_own")).otherwise(group)
    if not ambiguous:
        found = found & F.col("ref").isin(*SYMBOLS)
    return rows.withColumn("is_variant", F.coalesce(found, F.lit(False))).drop("_own")


def join_samples(columns: DataFrame, keys: list[str], width: int = scans.TILE) -> DataFrame:
    """Columns with samples cut where nothing varies, so that no variant lies across two.

    Each sample is cut before its last major column that isn't a variant (but not at its first
    column). What stands left goes to the sample before, and so through any number
    of samples without such a column; what stands right begins a new one. Where
    neighbours don't adjoin, a new one begins too. `sample` becomes (major, minor)
    of the first column.
    """
    # columns are marked once, ends of samples are a row each
    rows = table(mark(columns, keys), "marked")
    at = F.struct("major", "minor")
    calm = (F.col("minor") == 0) & ~F.col("is_variant") & (F.col("i") > 0)
    ends = rows.groupBy(*keys, "sample").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max(F.when(calm, at)).alias("split")).withColumns({"_major": F.col("first.major"), "_minor": F.col("first.minor")})
    order = ["_major", "_minor"]
    ends = scans.before(table(ends, "sample-ends"), keys, order, {"_prev": ("last", F.col("last"))}, width)
    adjoins = F.expr("first.major = _prev.major + 1 OR (first.major = _prev.major AND first.minor = _prev.minor + 1)")
    ends = ends.withColumn("_own", F.when(F.coalesce(adjoins, F.lit(False)), None).otherwise(F.col("first")))
    ends = scans.before(table(ends, "sample-starts"), keys, order, {"_open": ("last", F.coalesce("split", "_own"))}, width)
    ends = ends.select(*keys, "sample", "split", F.coalesce("_own", "_open").alias("left"))
    out = rows.drop("i", "is_variant").join(ends, [*keys, "sample"])
    return out.withColumn("sample", F.when(F.col("split").isNotNull() & (at >= F.col("split")), F.col("split")).otherwise(F.col("left"))).drop("split", "left")


def _let(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows with values computed once, where withColumns would copy them into each later use.

    A generator of one row stands between, which the optimiser doesn't look through.
    """
    return rows.select(*[F.col(c) for c in rows.columns if c not in values], F.inline(F.array(F.struct(*[v.alias(f"_let_{n}") for n, v in values.items()])))).withColumnsRenamed({f"_let_{n}": n for n in values})


def _gapless(symbols: str) -> str:
    return f"replace(array_join({symbols}, ''), '*', '')"


def _normal(rows: DataFrame) -> DataFrame:
    """Normal form of raw alleles: rows with pos, alleles, context, forced, nxt get pos, alleles, ext, appended.

    context: (major, base, i, cum) of the bases that may be put in front, nearest last;
    forced: how many of them must be. Common ends are trimmed and bases put in front while an
    allele would be empty, so after t trims ext = t + 1 - (shortest allele) of them. Then
    common starts go, never a last base. If no base is left in front, the trim that would
    empty an allele isn't made; an allele empty from the start takes the next base.
    """
    rows = _let(rows, {"_left": F.expr("array_join(transform(context, x -> x.base), '')"), "_m": F.expr("array_min(transform(alleles, a -> length(a)))")})
    rows = _let(rows, {"_room": F.length("_left"), "_rev": F.expr("transform(alleles, a -> split(reverse(concat(_left, a)), ''))")})
    # the common end of all alleles with their context
    rows = _let(rows, {"_k": F.expr("coalesce(array_min(filter(sequence(1, _room + _m), j -> j > 0 AND exists(_rev, r -> r[j - 1] <> _rev[0][j - 1]))) - 1, _room + _m)")})
    # as many trims as leave each allele a base
    rows = _let(rows, {"_t": F.expr("greatest(0, least(_k, _room + _m - 1))")})
    rows = _let(rows, {"ext": F.expr("greatest(forced, least(_room, greatest(0, _t + 1 - _m)))")})
    rows = _let(rows, {"_a": F.expr("transform(alleles, a -> left(concat(right(_left, ext), a), ext + length(a) - _t))")})
    stuck = F.expr("exists(_a, a -> a = '')")
    rows = _let(rows, {"appended": stuck & F.coalesce(F.expr("nxt.major = pos + length(alleles[0]) AND NOT nxt.is_variant"), F.lit(False))})
    rows = _let(rows, {"_a": F.when(F.col("appended"), F.expr("transform(_a, a -> concat(a, nxt.ref))")).otherwise(F.col("_a"))})
    rows = _let(rows, {"_short": F.expr("array_min(transform(_a, a -> length(a)))")})
    rows = _let(rows, {"_s": F.expr("CASE WHEN _short < 2 THEN 0 ELSE coalesce(array_min(filter(sequence(1, _short - 1), j -> exists(_a, a -> substring(a, j, 1) <> substring(_a[0], j, 1)))) - 1, _short - 1) END")})
    return _let(rows, {"pos": F.expr("pos - ext + _s"), "alleles": F.expr("transform(_a, a -> substring(a, _s + 1))")}).drop("_left", "_m", "_room", "_rev", "_k", "_t", "_a", "_s", "_short")


def call_variants(columns: DataFrame, keys: list[str], ambiguous: bool = False, normalize: bool = True, merge_overlapping: bool = False, merge_adjacent: bool = False, min_quality: float = 3.0) -> DataFrame:
    """(keys, sample, pos, ref, alts, gt, gq, qual, filter, rstart, rend) of the variants of columns.

    A run of variant columns is a variant; gaps are taken out, and one that begins on an
    inserted column takes the base before it. rstart and rend are its places within the sample. With
    a merge, variants whose places overlap or touch are one: their haplotypes
    are put together over the whole range, with the bases that the first of them took, and normalised anew; merge_overlapping
    does so until no two have a position in common. Variants whose alleles all equal
    the reference fall away. Inserted columns before the first major one of a sample have no
    base to stand on and are left out. qual is the Phred score of all haplotypes' calls
    over the range, at most CAP.
    """
    sample = Window.partitionBy(*keys, "sample").orderBy("i")
    rows = mark(columns, keys, ambiguous).withColumn("_lp", F.expr("aggregate(logp, 0D, (a, x) -> a + x)"))
    past = sample.rowsBetween(Window.unboundedPreceding, -1)
    ahead = sample.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({
        "cum": F.coalesce(F.sum("_lp").over(past), F.lit(0.0)),
        "_was": F.lag("is_variant", 1, False).over(sample),
        "_grounded": F.max(F.col("minor") == 0).over(sample.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumn("nxt", F.first(F.when(F.col("minor") == 0, F.struct("major", "ref", "is_variant", "i", (F.col("cum") + F.col("_lp")).alias("to_cum"))), True).over(ahead))
    rows = rows.where("_grounded")
    # columns up to a variant and the variant itself share a number
    rows = rows.withColumn("_n", F.sum(F.when(~F.col("is_variant") & F.col("_was"), 1).otherwise(0)).over(sample.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.col("is_variant")
    parts = rows.groupBy(*keys, "sample", "_n").agg(
        F.sort_array(F.array_agg(F.when(~here & (F.col("minor") == 0), F.struct("i", "major", F.col("ref").alias("base"), "cum")))).alias("gap"),
        F.sort_array(F.array_agg(F.when(here, F.struct("i", "major", "minor", "ref", "calls", "_lp", "cum")))).alias("cols"),
        F.max_by("nxt", F.when(here, F.col("i"))).alias("nxt"),
    ).where("size(cols) > 0")
    # sort_array puts an island in order of its places; its first one tells where it stands
    first, final = F.col("cols")[0], F.element_at("cols", -1)
    parts = _let(parts, {"rstart": first["i"], "rend": final["i"] + 1, "from_cum": first["cum"], "to_cum": final["cum"] + final["_lp"], "forced": (first["minor"] != 0).cast("int"), "pos": first["major"] + (first["minor"] != 0).cast("int")})
    alleles = f"concat(array({_gapless('transform(cols, c -> c.ref)')}), transform(sequence(0, size(cols[0].calls) - 1), h -> {_gapless('transform(cols, c -> c.calls[h])')}))"
    # bases before it up to the first break: the k-th from the right stands k + 1 before pos
    broken = "_near[k].major <> pos - 1 - k" + ("" if ambiguous else f" OR instr('{SYMBOLS}', _near[k].base) = 0")
    parts = _let(parts, {"alleles": F.expr(alleles), "_near": F.reverse("gap")})
    parts = _let(parts, {"context": F.expr(f"IF(size(gap) = 0, gap, reverse(slice(_near, 1, coalesce(array_min(filter(sequence(0, size(_near) - 1), k -> {broken})), size(_near)))))")})
    parts = parts.where("exists(alleles, a -> a <> alleles[0])")
    raw = parts.select(*keys, "sample", "pos", "alleles", "context", "gap", "forced", "rstart", "rend", "from_cum", "to_cum", "nxt")
    out = _placed(raw, normalize)
    if merge_overlapping or merge_adjacent:
        # in order of their final places; each was looked at next to the one before
        by_pos = Window.partitionBy(*keys, "sample").orderBy("pos", "raw_rstart")
        prev = F.lag("rend").over(by_pos)
        joins = F.lit(False)
        if merge_overlapping:
            joins = joins | (F.col("rstart") < prev)
        if merge_adjacent:
            joins = joins | (F.col("rstart") == prev)
        out = table(_merged(out, keys, joins, normalize), "variants")
        # put together they may reach farther back, over a base that the one before them took
        meets = F.col("pos") < F.lag(F.expr("pos + length(alleles[0])")).over(by_pos)
        while merge_overlapping and not out.select(meets.alias("meets")).where("meets").isEmpty():
            out = table(_merged(out, keys, meets, normalize), "variants")
    qual = F.round(F.greatest(F.lit(0.0), _phred(1 - F.exp(F.col("to_cum") - F.col("from_cum")))), 3)
    out = _let(out, {"qual": qual, "ref": F.col("alleles")[0], "_calls": F.expr("slice(alleles, 2, size(alleles) - 1)")})
    # an allele that stayed empty has nothing to be written as
    bare = F.expr("exists(_calls, a -> a = '')")
    alts = F.when(bare, F.array(F.lit("."))).otherwise(F.expr("array_sort(array_distinct(filter(_calls, a -> a <> ref)))"))
    out = _let(out, {"alts": alts})
    gt = F.when(bare, F.lit("0")).otherwise(F.expr("array_join(array_sort(transform(_calls, a -> cast(array_position(alts, a) as int))), '/')"))
    kind = F.when(bare, F.lit(".")).when(F.col("qual") >= min_quality, "PASS").otherwise("LowQual")
    return out.where("ref <> ''").select(*keys, "sample", "pos", "ref", "alts", gt.alias("gt"), F.round("qual").cast("int").alias("gq"), "qual", kind.alias("filter"), "rstart", "rend")


def _merged(out: DataFrame, keys: list[str], joins: Column, normalize: bool) -> DataFrame:
    """Rows of _placed(), each put together with the one before it in order of (pos, raw_rstart) where `joins`."""
    by_pos = Window.partitionBy(*keys, "sample").orderBy("pos", "raw_rstart")
    out = out.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    out = out.withColumn("_g", F.sum("_new").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    groups = out.groupBy(*keys, "sample", "_g").agg(F.sort_array(F.array_agg(F.struct("raw_rstart", "raw_pos", "raw_alleles", "raw_context", "raw_gap", "raw_ext", "raw_from", "raw_to", "raw_rend", "raw_nxt"))).alias("v"))
    # bases between two of them belong to every haplotype
    joined = "transform(sequence(0, size(v[0].raw_alleles) - 1), h -> array_join(transform(v, (x, n) -> concat(IF(n = 0, '', array_join(transform(x.raw_gap, g -> g.base), '')), x.raw_alleles[h])), ''))"
    last = F.element_at("v", -1)
    lead = F.col("v")[0]
    raw = groups.select(*keys, "sample", lead["raw_pos"].alias("pos"), F.expr(joined).alias("alleles"), lead["raw_context"].alias("context"), lead["raw_gap"].alias("gap"), lead["raw_ext"].alias("forced"), lead["raw_rstart"].alias("rstart"), last["raw_rend"].alias("rend"), lead["raw_from"].alias("from_cum"), last["raw_to"].alias("to_cum"), last["raw_nxt"].alias("nxt"))
    return _placed(raw.where("exists(alleles, a -> a <> alleles[0])"), normalize)


def _phred(error: Column) -> Column:
    return F.when(error <= 0, F.lit(CAP)).otherwise(F.least(-10 * F.log10(error), F.lit(CAP)))


def _placed(raw: DataFrame, normalize: bool) -> DataFrame:
    """Normal (or just grounded) alleles with the places they span; the raw ones are kept as raw_*."""
    kept = {f"raw_{n}": F.col(c) for n, c in (("rstart", "rstart"), ("rend", "rend"), ("pos", "pos"), ("alleles", "alleles"), ("context", "context"), ("gap", "gap"), ("ext", "ext"), ("from", "from_cum"), ("to", "to_cum"), ("nxt", "nxt"))}
    rows = raw.withColumns({n: c for n, c in kept.items() if n != "raw_ext"})
    if normalize:
        rows = _normal(rows)
    else:
        rows = _let(rows, {"ext": F.expr("least(forced, size(context))"), "appended": F.lit(False)})
        rows = _let(rows, {"alleles": F.expr("transform(alleles, a -> concat(IF(ext > 0, element_at(context, -1).base, ''), a))"), "pos": F.expr("pos - ext")})
    lead = F.expr("IF(ext > 0, element_at(context, -ext), null)")
    rows = _let(rows, {"raw_ext": F.col("ext"), "rstart": F.coalesce(lead["i"], "rstart"), "from_cum": F.coalesce(lead["cum"], "from_cum")})
    # a base taken from the next column belongs to the range, and to its quality
    taken = {"rend": F.col("nxt.i") + 1, "to_cum": F.col("nxt.to_cum")}
    return rows.withColumns({n: F.when(F.col("appended"), c).otherwise(F.col(n)) for n, c in taken.items()}).drop("ext", "appended", "context", "gap", "forced", "nxt")


def reference_rows(columns: DataFrame, keys: list[str], variants: DataFrame | None = None) -> DataFrame:
    """(keys, pos, ref, alts, gt, gq, qual, filter): a gVCF row for each major column.

    qual is the Phred score of the reference symbol's likeliest haplotype. With
    variants(keys, pos, ref), positions that their references cover are left out, so that
    variants and rows together have each position once.
    """
    rows = columns.where("minor = 0").withColumn("qual", F.round(F.greatest(F.lit(0.0), _phred(1 - F.exp("ref_logp"))), 3))
    rows = rows.select(*keys, F.col("major").alias("pos"), "ref", F.array(F.lit(".")).alias("alts"), F.lit("0").alias("gt"), F.round("qual").cast("int").alias("gq"), "qual", F.lit(".").alias("filter"))
    if variants is None:
        return rows
    taken = variants.select(*keys, F.explode(F.expr("sequence(pos, pos + length(ref) - 1)")).alias("pos")).distinct()
    return rows.join(taken, [*keys, "pos"], "left_anti")


def trim_samples(positions: DataFrame, keys: list[str], region: tuple[int, int] | None = None, search: bool = False, width: int = scans.TILE) -> DataFrame:
    """(keys, sample, relation, start, end, differing): which columns of each sample to keep, so that none is kept twice.

    positions: (keys, sample, major, minor), a row for each column. Samples are taken by their first
    column, the longer first. One within an earlier one has no columns (start and
    end null). Neighbours that overlap in equal columns are cut at the middle of the overlap. Where
    their columns differ, `differing` is set and both stay whole, unless `search`: then the
    cut is the major nearest to the middle at which both have as many columns (of two
    equally near the later one; not the middle itself), if each has over three majors there.
    region: (start, end) of majors that are kept at all.
    """
    own = Window.partitionBy(*keys, "sample")
    at = F.struct("major", "minor")
    # columns and ends of samples are read several times below, so they are made once
    cols = table(positions.select(*keys, "sample", "major", "minor").withColumn("i", F.row_number().over(own.orderBy("major", "minor")) - 1), "trim-columns")
    ends = cols.groupBy(*keys, "sample").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    ends = ends.withColumns({"_major": F.col("first.major"), "_minor": F.col("first.minor"), "_less": -F.col("n")})
    order = ["_major", "_minor", "_less", "sample"]
    ends = table(scans.before(table(ends, "trim-ends"), keys, order, {"_reach": ("max", F.col("last"))}, width), "trim-reach")
    within = F.coalesce(F.col("last") <= F.col("_reach"), F.lit(False))
    kept = scans.before(ends.where(~within), keys, order, {"_prev": ("last", F.struct("sample", "last", "n"))}, width)
    relation = F.expr("""CASE WHEN _prev IS NULL THEN 'first'
        WHEN (first.major = _prev.last.major + 1 AND first.minor = 0) OR (first.major = _prev.last.major AND first.minor = _prev.last.minor + 1) THEN 'abut'
        WHEN first <= _prev.last THEN 'overlap' ELSE 'gap' END""")
    kept = table(kept.withColumn("relation", relation), "trim-kept")
    pairs = kept.where("relation = 'overlap'").select(*keys, F.col("_prev.sample").alias("a"), F.col("sample").alias("b"), F.col("_prev.last").alias("stop"), F.col("first").alias("begin"))
    # in the one before: from its last column not past the other's first; in the other: to its first not before the end
    left = cols.join(pairs.select(*keys, F.col("a").alias("sample"), "b", "begin"), [*keys, "sample"]).withColumn("_from", F.max(F.when(at <= F.col("begin"), F.col("i"))).over(Window.partitionBy(*keys, "sample", "b"))).where("i >= _from")
    right = cols.join(pairs.select(*keys, "a", F.col("b").alias("sample"), "stop"), [*keys, "sample"]).withColumn("_upto", F.min(F.when(at >= F.col("stop"), F.col("i"))).over(Window.partitionBy(*keys, "sample", "a"))).where("_upto IS NULL OR i <= _upto")
    shape = lambda df, one, other, n: df.groupBy(*keys, F.col(one).alias("a"), F.col(other).alias("b")).agg(F.sort_array(F.array_agg(F.struct("i", "minor"))).alias(n), F.count_distinct("major").alias(f"{n}_majors"), F.min("i").alias(f"{n}_from"), F.min("major").alias(f"{n}_low"), F.max("major").alias(f"{n}_high"))
    met = shape(left, "sample", "b", "x").join(shape(right, "a", "sample", "y"), [*keys, "a", "b"])
    met = met.withColumn("same", F.expr("transform(x, c -> c.minor) = transform(y, c -> c.minor)"))
    cut = met.select(*keys, "a", "b", "x_majors", "y_majors", "x_low", "x_high", (~F.col("same")).alias("differing"), F.when(F.col("same"), F.expr("x_from + size(x) div 2")).alias("end_a"), F.when(F.col("same"), F.expr("size(y) - (size(y) - size(y) div 2)")).alias("start_b"))
    if search:
        streak = lambda df, one, other, n: df.groupBy(*keys, F.col(one).alias("a"), F.col(other).alias("b"), "major").agg(F.count("*").alias(f"{n}_n"), F.min("i").alias(f"{n}_i"))
        wide = cut.where("differing AND x_majors > 3 AND y_majors > 3").withColumn("mid", F.expr("x_low + (x_high - x_low) div 2"))
        shared = streak(left, "sample", "b", "x").join(streak(right, "a", "sample", "y"), [*keys, "a", "b", "major"]).where("x_n = y_n").join(wide.select(*keys, "a", "b", "mid"), [*keys, "a", "b"]).where("major <> mid")
        best = shared.groupBy(*keys, "a", "b").agg(F.min_by(F.struct("x_i", "y_i"), F.struct(F.abs(F.col("major") - F.col("mid")), -F.col("major"))).alias("_best"))
        cut = cut.join(best, [*keys, "a", "b"], "left").withColumns({"end_a": F.coalesce("end_a", "_best.x_i"), "start_b": F.coalesce("start_b", "_best.y_i")})
    starts = cut.select(*keys, F.col("b").alias("sample"), "start_b", "differing")
    stops = cut.select(*keys, F.col("a").alias("sample"), "end_a")
    out = kept.join(starts, [*keys, "sample"], "left").join(stops, [*keys, "sample"], "left")
    out = out.select(*keys, "sample", "relation", F.coalesce("start_b", F.lit(0)).cast("bigint").alias("start"), F.coalesce("end_a", "n").cast("bigint").alias("end"), F.coalesce("differing", F.lit(False)).alias("differing"))
    none = F.lit(None).cast("bigint")
    out = out.unionByName(ends.where(within).select(*keys, "sample", F.lit("within").alias("relation"), none.alias("start"), none.alias("end"), F.lit(False).alias("differing")))
    if region is None:
        return out
    before = cols.groupBy(*keys, "sample").agg(F.count_if(F.col("major") < region[0]).alias("_lo"), F.count_if(F.col("major") < region[1]).alias("_hi"))
    out = out.join(before, [*keys, "sample"]).withColumns({"start": F.greatest("start", "_lo"), "end": F.when(F.col("end").isNotNull(), F.least("end", "_hi"))}).drop("_lo", "_hi")
    empty = F.col("end").isNull() | (F.col("start") >= F.col("end"))
    return out.withColumns({"start": F.when(~empty, F.col("start")), "end": F.when(~empty, F.col("end"))})
