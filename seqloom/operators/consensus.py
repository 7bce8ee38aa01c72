"""Consensus from probabilities, stitched sequences, variant islands and genotypes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalars import phred
from seqloom.operators import scans
from seqloom.session import ship


def decode(probs: DataFrame, keys: list[str], symbol: str = "symbol", prob: str = "prob", index: str = "index") -> DataFrame:
    """(keys, symbol, quality): the likeliest symbol, of equal ones the least index, and its Phred score."""
    top = probs.groupBy(*keys).agg(F.max_by(F.struct(symbol, prob), F.struct(F.col(prob), -F.col(index))).alias("_t"))
    return top.select(*keys, F.col(f"_t.{symbol}").alias("symbol"), phred(1 - F.col(f"_t.{prob}")).alias("quality"))


def concat_windows(windows: DataFrame, name: str, win: str, seq: str) -> DataFrame:
    """(name, part, record, seq): windows in order; an empty or null one breaks the read.

    A read that comes in one part keeps its name; parts are `name:0`, `name:1`...
    """
    w = Window.partitionBy(name).orderBy(win)
    empty = F.coalesce(F.length(seq), F.lit(0)) == 0
    marked = windows.withColumn("_cut", F.sum(empty.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~empty)
    parts = marked.groupBy(name, "_cut").agg(F.sort_array(F.array_agg(F.struct(win, seq))).alias("_x")).withColumn("seq", F.expr(f"array_join(transform(_x, x -> x.{seq}), '')"))
    p = Window.partitionBy(name)
    parts = parts.withColumn("part", F.row_number().over(p.orderBy("_cut")) - 1).withColumn("_n", F.count("*").over(p))
    return parts.select(name, "part", F.when(F.col("_n") > 1, F.concat_ws(":", name, F.col("part").cast("string"))).otherwise(F.col(name).cast("string")).alias("record"), "seq")


def stitch(samples: DataFrame, drafts: DataFrame, name: str = "name", fill: str = "draft") -> DataFrame:
    """(name, part, seq) of samples(name, start, end, seq) in order of start.

    fill: `draft` puts the draft(name, draft)'s bases in gaps and at the ends, a
    single character is repeated, and `split` begins a new part at each gap.
    """
    w = Window.partitionBy(name).orderBy("start")
    s = samples.join(drafts, name).withColumn("_prev", F.lag("end").over(w)).withColumn("_next", F.lead("start").over(w))
    s = s.withColumn("part", F.sum(F.when(F.col("start") > F.col("_prev"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) if fill == "split" else F.lit(0))
    gap = F.expr("substr(draft, coalesce(_prev, 0) + 1, greatest(0, start - coalesce(_prev, 0)))")
    tail = F.expr("if(_next IS NULL, substr(draft, end + 1), '')")
    if fill == "split":
        piece = F.col("seq")
    elif fill == "draft":
        piece = F.concat(gap, "seq", tail)
    else:
        piece = F.concat(F.repeat(F.lit(fill), F.length(gap)), "seq", F.repeat(F.lit(fill), F.length(tail)))
    return s.withColumn("_p", piece).groupBy(name, "part").agg(F.array_join(F.transform(F.sort_array(F.array_agg(F.struct("start", "_p"))), lambda x: x["_p"]), "").alias("seq"))


def trim_overlaps(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Adds keep_start, keep_end, relation: neighbours cut at the middle of their overlap.

    relation to the one before: first, overlap, abut, gap or within; a sample
    within an earlier one is kept as a row with an empty interval.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rel = samples.withColumn("_before", before)
    rel = rel.withColumn("relation", F.expr("CASE WHEN _before IS NULL THEN 'first' WHEN end <= _before THEN 'within' WHEN start < _before THEN 'overlap' WHEN start = _before THEN 'abut' ELSE 'gap' END"))
    main = rel.where("relation <> 'within'")
    m = Window.partitionBy(*keys).orderBy("start", "end")
    main = main.withColumns({"_pe": F.lag("end").over(m), "_ns": F.lead("start").over(m)})
    main = main.withColumns({"keep_start": F.expr("if(_pe > start, (_pe + start) div 2, start)"), "keep_end": F.expr("if(_ns < end, (end + _ns) div 2, end)")}).drop("_pe", "_ns")
    within = rel.where("relation = 'within'").withColumns({"keep_start": F.col("start"), "keep_end": F.col("start")})
    return main.unionByName(within).drop("_before")


def variant_columns(columns: DataFrame, keys: list[str], ref: str, calls: list[str]) -> DataFrame:
    """Adds is_variant: a call differs from ref; a minor row also if any row of its major does."""
    own = None
    for c in calls:
        own = (F.col(c) != F.col(ref)) if own is None else own | (F.col(c) != F.col(ref))
    out = columns.withColumn("_own", F.coalesce(own, F.lit(False)))
    any_ = F.bool_or("_own").over(Window.partitionBy(*keys, "major"))
    return out.withColumn("is_variant", F.when(F.col("minor") == 0, F.col("_own")).otherwise(any_)).drop("_own")


def variant_islands(columns: DataFrame, keys: list[str], ref: str, calls: list[str], width: int = scans.TILE) -> DataFrame:
    """(keys, island, pos, ref, alts): runs of variant columns with gaps stripped."""
    marked = variant_columns(columns, keys, ref, calls)
    # a run of variants has as many other columns before it all along
    marked = scans.before(marked, keys, ["major", "minor"], {"island": ("sum", (~F.col("is_variant")).cast("int"))}, width)
    marked = marked.where("is_variant").withColumn("island", F.coalesce("island", F.lit(0)))
    joined = lambda c: F.expr(f"replace(array_join(transform(_x, x -> x.{c}), ''), '*', '')")
    out = marked.groupBy(*keys, "island").agg(F.min("major").alias("pos"), F.sort_array(F.array_agg(F.struct("major", "minor", ref, *calls))).alias("_x"))
    return out.select(*keys, "island", "pos", joined(ref).alias("ref"), F.array(*[joined(c) for c in calls]).alias("alts"))


def merge_variants(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or adjacent variants(start, end, ...) as one range each, with a count."""
    from seqloom.operators.intervals import merge_ranges

    return merge_ranges(variants, keys, 0)


def normalise(variants: DataFrame, drafts: DataFrame, name: str = "name") -> DataFrame:
    """(name, pos, ref, alts) in normal form against drafts(name, draft).

    Common ends are trimmed from the right, but never the last base; a variant
    with an empty allele takes the base before it (or after, at the start) and
    moves left while its last base repeats; then common starts are trimmed. Rows
    are independent, so this is a plain map.
    """

    def one(pos: int, ref: str, alts: list[str], draft: str) -> tuple:
        alleles = [ref, *alts]
        while True:
            if any(not a for a in alleles):
                if pos > 0:
                    pos -= 1
                    alleles = [draft[pos] + a for a in alleles]
                else:
                    after = draft[len(alleles[0]) : len(alleles[0]) + 1]
                    if not after or len({a[-1:] for a in alleles if a} | {after}) == 0:
                        break
                    alleles = [a + after for a in alleles]
                    break
            elif len({a[-1] for a in alleles}) == 1 and max(map(len, alleles)) > 1 and (min(map(len, alleles)) > 1 or pos > 0):
                alleles = [a[:-1] for a in alleles]
            else:
                break
        while min(map(len, alleles)) > 1 and len({a[0] for a in alleles}) == 1:
            alleles = [a[1:] for a in alleles]
            pos += 1
        return pos, alleles[0], alleles[1:]

    def run(batches):
        for pdf in batches:
            rows = [(n, *one(p, r, list(a), d)) for n, p, r, a, d in zip(pdf["name"], pdf["pos"], pdf["ref"], pdf["alts"], pdf["draft"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "pos", "ref", "alts"])

    ship(variants.sparkSession)
    # only the stretch before a variant can matter, and a repeat seldom is longer than this
    met = variants.join(drafts, name).select(F.col(name).alias("name"), F.col("pos").cast("bigint").alias("pos"), "ref", "alts", "draft")
    return met.mapInPandas(run, "name string, pos bigint, ref string, alts array<string>").withColumnRenamed("name", name)


def genotype(rows: DataFrame, ref: str, calls: str, quality: str, ploidy: int = 2, min_quality: float = 3.0) -> DataFrame:
    """Adds alts, gt, gq, filter from an array of called alleles.

    alts: distinct, sorted, not the reference; more than ploidy give none.
    gt: sorted allele numbers joined by `/`; filter: `.` without alts, PASS or LowQual.
    """
    alts = F.expr(f"array_sort(array_distinct(filter({calls}, x -> x <> {ref})))")
    out = rows.withColumn("alts", alts).withColumn("alts", F.expr(f"if(size(alts) > {ploidy}, cast(array() AS array<string>), alts)"))
    gt = F.expr(f"array_join(array_sort(transform({calls}, x -> cast(array_position(alts, x) AS int))), '/')")
    f = F.when(F.size("alts") == 0, ".").when(F.col(quality) >= min_quality, "PASS").otherwise("LowQual")
    return out.withColumns({"gt": gt, "gq": F.round(quality).cast("int"), "filter": f})


def reference_quality(probs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, major, quality): Phred of the joint probability of the reference symbols, least over haplotypes.

    probs: keys, hap, major, minor, symbol, ref, prob. Logs are summed over the
    minors of a major with probabilities of 1e-10 at least.
    """
    own = probs.where("symbol = ref").groupBy(*keys, "hap", "major").agg(F.exp(F.sum(F.log(F.greatest("prob", F.lit(1e-10))))).alias("p"))
    return own.groupBy(*keys, "major").agg(phred(1 - F.min("p")).alias("quality"))


def low_quality_sites(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate sites, passing variants): sites of LowQual rows, once each."""
    return variants.where("filter = 'LowQual'").select("chrom", "pos").dropDuplicates(), variants.where("filter = 'PASS'")


def haplotype(rows: DataFrame, lookup: DataFrame | None = None) -> Column | DataFrame:
    """Adds hap: from lookup(read_id, hap) if given, else tag HP, else 0."""
    if lookup is None:
        return rows.withColumn("hap", F.coalesce(F.col("tags")["HP"].cast("int"), F.lit(0)))
    return rows.join(lookup.select("read_id", "hap"), "read_id", "left").withColumn("hap", F.coalesce("hap", F.lit(0)))
