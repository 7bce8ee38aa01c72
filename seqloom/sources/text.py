"""Text sources: FASTQ, FASTA, SAM, PAF, BED, regions, sheets and lists.

Line formats are split in Spark expressions. FASTQ needs whole records of four
lines, where `@` may begin a quality line; its lines are numbered for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAG = r"^[A-Za-z][A-Za-z0-9]:[AifZHB]:"


def tag_map(fields: str, types: bool = False) -> Column:
    """TAG:TYPE:VALUE strings as a map from tag to value, or to type; others are ignored, the last of a name wins."""
    taken = "substr(x, 4, 1)" if types else "substr(x, 6)"
    return F.expr(f"map_from_entries(transform(map_values(map_from_entries(transform(array_distinct(transform(filter({fields}, x -> x RLIKE '{TAG}'), x -> left(x, 2))), t -> struct(t AS k, element_at(filter({fields}, x -> left(x, 2) = t AND x RLIKE '{TAG}'), -1) AS v)))), x -> struct(left(x, 2) AS key, {taken} AS value)))")


def numbered_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(file, line, value) of text files, plain or compressed, lines counted from 0 in each file.

    Plain files are read in splits by many tasks. A line's number is its place
    in its split and the lines of the splits before, which are counted first.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = lines.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "_split", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["file", "_split"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, recursive: bool = False, max_reads: int | None = None) -> DataFrame:
    """(file, read_id, seq, qual, tags) of FASTQ files, .gz too; U in sequences becomes T.

    A record is four lines; the header is the id and tab- or space-separated
    tags. Four empty lines are no record; a cut or malformed one is an error.
    max_reads: this many records at most, whichever come first.
    """
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    rows = numbered_lines(spark, path, recursive).groupBy("file", F.expr("line div 4").alias("_record")).agg(part(0).alias("_head"), part(1).alias("seq"), part(2).alias("_plus"), part(3).alias("qual"))
    rows = rows.where("concat(_head, coalesce(seq, ''), coalesce(_plus, ''), coalesce(qual, '')) != ''")
    sound = "startswith(_head, '@') AND startswith(_plus, '+') AND length(seq) = length(qual)"
    where = "concat(file, ': line ', _record * 4 + 1, ' does not begin a record of four lines')"
    rows = rows.withColumn("_head", F.expr(f"IF(coalesce({sound}, false), translate(substr(_head, 2), '\t', ' '), raise_error({where}))"))
    rows = rows.select("file", F.split("_head", " ", 2).alias("_h"), F.translate("seq", "U", "T").alias("seq"), "qual")
    rows = rows.select("file", F.col("_h")[0].alias("read_id"), "seq", "qual", F.expr("split(coalesce(get(_h, 1), ''), ' ')").alias("_f"))
    rows = rows.select("file", "read_id", "seq", "qual", tag_map("_f").alias("tags"))
    return rows if max_reads is None else rows.limit(max_reads)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, tags): records parted at lines that begin with `>`; the rest of a header may hold tags."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    rows = rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"), F.split(F.regexp_replace(head, r"^\S+\s*", ""), r"[\t ]").alias("_f"))
    return rows.select("name", "seq", tag_map("_f").alias("tags"))


def fasta_index(fasta: DataFrame) -> DataFrame:
    """(name, length)."""
    return fasta.select("name", F.length("seq").cast("bigint").alias("length"))


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, references): 11 columns with tags and their types, and @SQ names with lengths and a number that keeps their order.

    `*` and 0 stand for empty fields.
    """
    lines = spark.read.text(path)
    f = F.split("value", "\t")
    text = lambda i: F.coalesce(F.nullif(F.try_element_at(f, F.lit(i + 1)), F.lit("")), F.lit("*"))
    num = lambda i: F.coalesce(F.try_element_at(f, F.lit(i + 1)).try_cast("int"), F.lit(0))
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    records = lines.where("value NOT LIKE '@%' AND value <> ''").withColumn("_f", F.slice(f, 12, F.greatest(F.size(f), F.lit(1))))
    records = records.select(*[(num(i) if n in ("flag", "pos", "mapq", "pnext", "tlen") else text(i)).alias(n) for i, n in enumerate(names)], tag_map("_f").alias("tags"), tag_map("_f", types=True).alias("tag_types"))
    refs = lines.where(F.col("value").startswith("@SQ\t")).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("sn"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("int").alias("ln"), F.monotonically_increasing_id().alias("nth"))
    return records, refs


def primary_only(records: DataFrame) -> DataFrame:
    """Without secondary and supplementary records."""
    return records.where("(flag & 2304) = 0")


def alignment_metrics(records: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, violations): records with coverage, identity, accuracy and ends; those mapped without NM."""
    from seqloom.functions.scalars import accuracies, alignment_counts, cigar_ops

    r = records.withColumn("ops", cigar_ops("cigar")).withColumn("nm", F.col("tags")["NM"].try_cast("int"))
    mapped = r.where("(flag & 4) = 0")
    ok = mapped.where("nm IS NOT NULL").join(references, F.col("rname") == F.col("sn"), "left").withColumn("c", alignment_counts("ops", "nm")).withColumn("a", accuracies("ops", "nm"))
    aligned = F.col("c.matches") + F.col("c.deletions")
    out = ok.select("qname", "rname", "pos", "flag", "mapq", "c.*", F.col("a.snp").alias("identity"), F.col("a.total").alias("accuracy"), F.try_divide(aligned, F.least(F.length("seq"), F.col("ln"))).alias("coverage"), (F.col("pos") - 1 + aligned).alias("genome_end"))
    return out, mapped.where("nm IS NULL").select("qname", F.lit("NM is missing").alias("reason"))


PAF = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block_len", "mapq"]


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """12 columns, the other fields as one string, and the CIGAR of cg:Z:."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(*[(f[i] if n in ("qname", "strand", "tname") else f[i].cast("int")).alias(n) for i, n in enumerate(PAF)], F.array_join(F.slice(f, 13, F.greatest(F.size(f), F.lit(1))), "\t").alias("aux")).withColumn("cigar", F.regexp_extract("aux", r"cg:Z:([^\t]*)", 1))


def read_bed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of BED lines; comments and browser or track lines are left out anywhere.

    A reject has the reason: too few or many columns, another width than the
    file's first row, bad bounds or strand. The strand is `.` where absent.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where("value <> '' AND value NOT LIKE '#%' AND NOT value RLIKE '^(browser|track)\\\\b'").withColumn("f", F.split("value", "\t"))
    widths = lines.groupBy("file").agg(F.min_by(F.size("f"), "line").alias("width"))
    rows = lines.join(widths, "file")
    rows = rows.select("file", "line", "value", F.size("f").alias("n"), "width", F.col("f")[0].alias("chrom"), F.try_element_at("f", F.lit(2)).try_cast("bigint").alias("start"), F.try_element_at("f", F.lit(3)).try_cast("bigint").alias("end"), F.coalesce(F.try_element_at("f", F.lit(6)), F.lit(".")).alias("strand"))
    reason = F.when(~F.col("n").between(3, 12), "column count").when(F.col("n") != F.col("width"), "width differs").when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("start") > F.col("end")), "bounds").when(~F.col("strand").isin("+", "-", "."), "strand")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("chrom", "start", "end", "strand", "value"), rows.where("reason IS NOT NULL").select("file", "line", "value", "reason")


def parse_regions(df: DataFrame, text: str) -> DataFrame:
    """(name, start, end) of comma lists of name, name:, name:s-e, name:s- and name:-e; 1-based closed text to 0-based half-open, open ends null."""
    one = df.select(F.explode(F.split(text, ",")).alias("_r")).select(F.trim("_r").alias("_r")).where("_r <> ''")
    part = lambda i: F.nullif(F.regexp_extract("_r", r"^(.*?)(?::([0-9]*)(?:-([0-9]*))?)?$", i), F.lit(""))
    return one.select(part(1).alias("name"), (part(2).cast("bigint") - 1).alias("start"), part(3).cast("bigint").alias("end"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos) candidate sites."""
    f = F.split("value", r"\s+")
    return spark.read.text(path).where("value <> ''").select(f[0].alias("chrom"), f[1].cast("bigint").alias("pos"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("template string, complement string").option("sep", " ").csv(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


#: The columns a sample sheet may have.
SHEET_COLUMNS = ("flow_cell_id", "position_id", "kit", "sample_id", "experiment_id", "protocol_run_id", "flow_cell_product_code", "barcode", "alias", "type")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sample sheet with any line ends; all columns are strings, `line` is the order."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r\n|\r|\n"), lambda x: F.trim(x) != "")).alias("line", "v"))
    head = [h.strip() for h in raw.where("line = 0").first()["v"].split(",")]
    f = F.split("v", ",")
    return raw.where("line > 0").select("line", *[F.try_element_at(f, F.lit(i + 1)).alias(h) for i, h in enumerate(head)])


def sheet_violations(sheet: DataFrame) -> DataFrame:
    """(line, rule) for each broken rule; line is null where the whole sheet breaks it."""
    have = set(sheet.columns) - {"line"}
    whole = []
    if have - set(SHEET_COLUMNS):
        whole.append("unknown column")
    if not have & {"flow_cell_id", "position_id"}:
        whole.append("flow_cell_id or position_id is needed")
    whole += [f"{c} is needed" for c in ("experiment_id", "kit") if c not in have]
    if ("barcode" in have) != ("alias" in have):
        whole.append("barcode and alias go together")
    rules = []
    for c in ("sample_id", "alias", "experiment_id"):
        if c in have:
            rules.append(F.when(~F.coalesce(F.col(c), F.lit("")).rlike("^[A-Za-z0-9_-]{0,40}$"), f"{c} has other characters or over 40"))
    if "alias" in have:
        rules.append(F.when(F.col("alias").rlike("^(barcode[0-9]{2,}|unclassified)$") & ~F.col("alias").eqNullSafe(F.col("barcode") if "barcode" in have else F.lit(None)), "alias is reserved"))
    spark = sheet.sparkSession
    out = spark.createDataFrame([(None, w) for w in whole], "line int, rule string")
    if rules:
        out = out.unionByName(sheet.select(F.col("line").cast("int").alias("line"), F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule")))
    if "experiment_id" in have:
        out = out.unionByName(sheet.agg(F.count_distinct("experiment_id").alias("n")).where("n > 1").select(F.lit(None).cast("int").alias("line"), F.lit("several experiment_id").alias("rule")))
    if {"barcode", "alias"} <= have:
        keys = [c for c in ("flow_cell_id", "position_id", "experiment_id") if c in have]
        w = Window.partitionBy(*keys, "barcode").orderBy("line")
        out = out.unionByName(sheet.withColumn("_n", F.row_number().over(w)).where("_n > 1 AND barcode <> ''").select(F.col("line").cast("int").alias("line"), F.lit("barcode comes twice").alias("rule")))
    return out
