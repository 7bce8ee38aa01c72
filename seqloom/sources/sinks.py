"""Sinks: partitioned and sorted output, and the text formats' writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alias_chain(sheet_alias: str, barcode: str, tags: str, kit: str, demux: bool) -> Column:
    """Sheet alias, else barcode, else tags BC, al, SM without the kit's prefix; else unclassified when demultiplexing."""
    some = lambda c: F.nullif(c, F.lit(""))
    tag = lambda t: some(F.regexp_replace(F.col(tags)[t], F.concat(F.lit("^"), F.coalesce(F.col(kit), F.lit("")), F.lit("_")), ""))
    return F.coalesce(some(F.col(sheet_alias)), some(F.col(barcode)), tag("BC"), tag("al"), tag("SM"), F.lit("unclassified" if demux else ""))


def output_path(experiment: str, sample: str, started: str, position: str, flowcell: str, run: str, kind: str, passed: str, alias: str) -> Column:
    """experiment/sample/{datetime}_{position}_{flowcell}_{run8}/{kind}_{pass|fail}/alias, empty alias left out."""
    stamp = F.date_format(started, "yyyyMMdd_HHmm")
    folder = F.concat_ws("_", stamp, position, flowcell, F.substring(run, 1, 8))
    return F.concat_ws("/", experiment, sample, folder, F.concat(F.lit(f"{kind}_"), F.when(F.col(passed), "pass").otherwise("fail")), F.nullif(F.col(alias), F.lit("")))


def write_partitioned(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """One folder for each value of columns; rows are dealt by them, large values to several files."""
    df.hint("rebalance", *columns).write.partitionBy(*columns).format(fmt).save(path)


def coordinate_sorted(df: DataFrame, tid: str, pos: str, partitions: int) -> DataFrame:
    """Range-partitioned and sorted by (tid, pos); unmapped rows (null or negative tid) last."""
    key = F.when(F.col(tid) >= 0, F.col(tid))
    return df.repartitionByRange(partitions, key.asc_nulls_last(), F.col(pos)).sortWithinPartitions(key.asc_nulls_last(), pos)


def tag_fields(tags: str, types: str | None = None) -> Column:
    """TAG:TYPE:value fields in order of tag; tags that the map `types` lacks are text (Z)."""
    kind = lambda tag: F.coalesce(F.col(types)[tag], F.lit("Z")) if types else F.lit("Z")
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(":"), kind(e["key"]), F.lit(":"), e["value"])), "\t")


def fastq_lines(df: DataFrame) -> DataFrame:
    """(value) of four lines a record, tags in the header."""
    head = F.concat_ws("\t", F.concat(F.lit("@"), "read_id"), F.nullif(tag_fields("tags"), F.lit("")))
    return df.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))


def fasta_lines(df: DataFrame, width: int = 80) -> DataFrame:
    return df.select(F.concat_ws("\n", F.concat(F.lit(">"), "name"), F.array_join(F.regexp_extract_all("seq", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")).alias("value"))


def sam_lines(records: DataFrame, references: DataFrame) -> DataFrame:
    """Header lines, then records by reference and position, those without one last.

    References keep the order of their column `nth` where there is one, else
    that of their names. Tags have the types of the column `tag_types`, else Z.
    """
    nth = F.col("nth") if "nth" in references.columns else F.lit(0)
    refs = references.select("sn", "ln", nth.cast("bigint").alias("nth"))
    head = refs.select(F.lit(0).alias("part"), "nth", F.col("sn").alias("rname"), F.lit(0).cast("bigint").alias("pos"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "sn"), F.concat(F.lit("LN:"), F.col("ln").cast("string"))).alias("value"))
    fields = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    tags = tag_fields("tags", "tag_types" if "tag_types" in records.columns else None)
    body = records.select(F.when(F.coalesce("rname", F.lit("*")) == "*", 2).otherwise(1).alias("part"), "rname", F.col("pos").cast("bigint").alias("pos"), F.concat_ws("\t", *[F.col(f).cast("string") for f in fields], F.nullif(tags, F.lit(""))).alias("value"))
    placed = body.join(refs.select(F.col("sn").alias("_sn"), "nth").dropDuplicates(["_sn"]), F.col("rname") == F.col("_sn"), "left").select(*head.columns)
    return head.unionByName(placed).orderBy("part", F.asc_nulls_last("nth"), "rname", "pos", "value").select("value")


def paf_lines(df: DataFrame) -> DataFrame:
    from seqloom.sources.text import PAF

    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in PAF], F.concat(F.lit("cg:Z:"), "cigar")).alias("value"))


def vcf_lines(variants: DataFrame, contigs: DataFrame, sample: str = "SAMPLE") -> DataFrame:
    """Header lines and one line per variant(chrom, pos 0-based, ref, alts, quality, filter, gt, gq, dp), in order."""
    spark = variants.sparkSession
    fixed = [(0, 0, "##fileformat=VCFv4.2"), (2, 0, '##FILTER=<ID=PASS,Description="All filters passed">'), (2, 1, '##FILTER=<ID=LowQual,Description="Variant quality is low">'), (2, 2, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">'), (2, 3, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), (2, 4, '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">'), (3, 0, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]))]
    head = spark.createDataFrame([(p, "", n, v) for p, n, v in fixed], "part int, chrom string, pos bigint, value string")
    names = contigs.select(F.lit(1).alias("part"), F.col("name").alias("chrom"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("##contig=<ID="), "name", F.lit(",length="), F.col("length").cast("string"), F.lit(">")).alias("value"))
    alt = F.when(F.size("alts") == 0, ".").otherwise(F.array_join("alts", ","))
    body = variants.select(F.lit(4).alias("part"), "chrom", F.col("pos").cast("bigint").alias("pos"), F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", alt, F.format_string("%.3f", F.col("quality").cast("double")), "filter", F.concat(F.lit("DP="), F.col("dp").cast("string")), F.lit("GT:GQ"), F.concat_ws(":", "gt", F.col("gq").cast("string"))).alias("value"))
    return head.unionByName(names).unionByName(body).orderBy("part", "chrom", "pos", "value").select("value")


def region_lines(regions: DataFrame) -> DataFrame:
    return regions.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))


def summary_lines(summary: DataFrame) -> tuple[str, DataFrame]:
    """(header, lines) of a summary as tab-separated text: six decimals, TRUE and FALSE."""
    forms = {"double": lambda c: F.when(F.isnan(c), "nan").otherwise(F.format_string("%.6f", c)), "boolean": lambda c: F.upper(F.col(c).cast("string"))}
    cells = [F.coalesce(forms.get(t, lambda c: F.col(c).cast("string"))(c), F.lit("")) for c, t in summary.dtypes]
    return "\t".join(summary.columns), summary.select(F.concat_ws("\t", *cells).alias("value"))
