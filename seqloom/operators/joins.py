"""Keyed joins and deduplication on reads, read groups, sheets and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import table


def by_lists(reads: DataFrame, id_: str, allow: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """Rows whose id is in the allow list and not in the ignore list; ids there are column `id`."""
    if allow is not None:
        reads = reads.join(allow.select(F.col("id").alias("_id")).distinct(), F.col(id_) == F.col("_id"), "left_semi")
    if ignore is not None:
        reads = reads.join(ignore.select(F.col("id").alias("_id")).distinct(), F.col(id_) == F.col("_id"), "left_anti")
    return reads


def read_group_attributes(reads: DataFrame, groups: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join on key; an empty attribute counts as absent and takes its default."""
    named = groups.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in defaults])
    out = reads.join(named, F.col(key) == F.col("_key"), "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.lit(d)) for c, d in defaults.items()}).drop("_key", *[f"_{c}" for c in defaults])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key along `order`, which must be total to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sheet_aliases(reads: DataFrame, sheet: DataFrame, keys: list[str], line: str, barcode: str) -> DataFrame:
    """Adds alias: of the first sheet row with the read's keys and barcode suffix (after the last `_`)."""
    rows = first_wins(sheet, [*keys, "barcode"], [line])
    rows = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("barcode").alias("_barcode"), "alias")
    on = F.regexp_extract(F.col(barcode), "([^_]*)$", 1) == F.col("_barcode")
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return reads.join(rows, on, "left").drop("_barcode", *[f"_{k}" for k in keys])


def pair_join(reads: DataFrame, pairs: DataFrame, id_: str) -> DataFrame:
    """Both reads of each (template, complement); pairs that lack one are dropped."""
    t = reads.select([F.col(c).alias(f"template_{c}") for c in reads.columns])
    c = reads.select([F.col(x).alias(f"complement_{x}") for x in reads.columns])
    return pairs.join(t, F.col("template") == F.col(f"template_{id_}")).join(c, F.col("complement") == F.col(f"complement_{id_}")).drop("template", "complement")


def tag_parents(reads: DataFrame, id_: str) -> DataFrame:
    """Adds is_parent: whether a row with id `template;complement` names this row."""
    parents = reads.where(F.col(id_).contains(";")).select(F.explode(F.split(id_, ";")).alias("_parent")).distinct()
    return reads.join(parents, F.col(id_) == F.col("_parent"), "left").withColumn("is_parent", F.col("_parent").isNotNull()).drop("_parent")


def not_done(reads: DataFrame, done: DataFrame, id_: str, parent: str | None = None) -> DataFrame:
    """Rows whose parent id (or id) no done record names; done ids are cut at `:`, space or tab."""
    own = F.coalesce(F.nullif(F.col(parent), F.lit("")), F.col(id_)) if parent else F.col(id_)
    names = done.select(F.regexp_extract(F.col("id"), r"^([^: \t]*)", 1).alias("_done")).distinct()
    return reads.withColumn("_own", own).join(names, F.col("_own") == F.col("_done"), "left_anti").drop("_own")


def alignment_counts(records: DataFrame, name: str, flag: str) -> DataFrame:
    """(name, mapped, secondary, supplementary) by SAM flag bits."""
    bit = lambda b: F.expr(f"({flag} & {b}) <> 0")
    return records.groupBy(name).agg(F.count_if(~bit(4)).alias("mapped"), F.count_if(bit(256)).alias("secondary"), F.count_if(bit(2048)).alias("supplementary"))


def merge_headers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of header lines(file, kind, key, line).

    Lines are merged by (kind, key) and numbered in the order of key within
    their kind; a key with two different lines is a conflict.
    """
    seen = lines.groupBy("kind", "key").agg(F.count_distinct("line").alias("variants"), F.min("line").alias("line"), F.count_distinct("file").alias("files"))
    merged = seen.where("variants = 1").withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy("key")) - 1)
    return merged.select("kind", "key", "line", "files", "position"), seen.where("variants > 1").select("kind", "key", "variants")


#: Programs of a file that may follow one another.
LONGEST_CHAIN = 1000
#: Different programs of which a copy for each executor is small, some 20 MB.
FEW_PROGRAMS = 100_000


def merge_programs(lines: DataFrame) -> DataFrame:
    """(file, key, line, new_key, new_parent) of program lines(file, key, line, parent), parent being a key of the same file or null.

    A program is known by its line and by what it follows, so equal lines of two files are one
    only where all before them are. Of several programs with one key the first (by line, then
    by the chain) keeps it and the others get `key.N`, N counting renamed ones in order of key; parents are
    renamed with them, so each resolves. A parent that its file doesn't have is taken for none, and
    programs that follow themselves in a circle are known by their lines alone.
    """
    # lines of files repeat, so their tables are small as files and large in a broadcast
    dealt = lambda df: df.hint("merge")
    rows = table(lines.select("file", "key", "line", "parent").distinct(), "programs")
    has = rows.select(F.col("file").alias("_f"), F.col("key").alias("_k")).distinct()
    rows = rows.join(dealt(has), (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_k")), "left").select("file", "key", "line", F.col("_k").alias("parent"))
    known = table(rows.where("parent IS NULL").withColumn("chain", F.sha2("line", 256)), "chains")
    done, n = known, known.count()
    for _ in range(LONGEST_CHAIN):
        if not n:
            break
        before = known.select(F.col("file").alias("_f"), F.col("key").alias("_k"), F.col("chain").alias("_c"))
        known = table(rows.join(dealt(before), (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_k"))).select("file", "key", "line", "parent", F.sha2(F.concat_ws("|", "line", "_c"), 256).alias("chain")), "chains")
        n = known.count()
        done = done.unionByName(known)
    circles = rows.join(dealt(done.select(F.col("file").alias("_f"), F.col("key").alias("_k"))), (F.col("file") == F.col("_f")) & (F.col("key") == F.col("_k")), "left_anti")
    done = done.unionByName(circles.withColumn("chain", F.sha2("line", 256)))
    # programs, not files: as many rows as there are different lines
    programs = done.select("key", "line", "chain").distinct()
    programs = programs.withColumn("_nth", F.row_number().over(Window.partitionBy("key").orderBy("line", "chain")))
    renamed = programs.where("_nth > 1").groupBy("key").agg(F.count("*").alias("_n"))
    offset = renamed.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("key").alias("_rk"), "_off")
    programs = programs.join(offset, F.col("key") == F.col("_rk"), "left").withColumn("new_key", F.when(F.col("_nth") == 1, F.col("key")).otherwise(F.concat_ws(".", "key", (F.col("_off") + F.col("_nth") - 1).cast("string"))))
    programs = table(programs.select(F.col("key").alias("_pk"), F.col("chain").alias("_pc"), "new_key"), "new_keys")
    # few programs go to the lines, never lines to the programs
    programs = F.broadcast(programs) if programs.count() <= FEW_PROGRAMS else dealt(programs)
    named = done.join(programs, (F.col("key") == F.col("_pk")) & (F.col("chain") == F.col("_pc"))).select("file", "key", "line", "parent", "new_key")
    up = named.select(F.col("file").alias("_f"), F.col("key").alias("_k"), F.col("new_key").alias("new_parent"))
    return named.join(dealt(up), (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_k")), "left").select("file", "key", "line", "new_key", "new_parent")


def header_index_map(lines: DataFrame, merged: DataFrame, order: str) -> DataFrame:
    """(file, old, new): where each file's line of a kind went in the merged header."""
    old = F.row_number().over(Window.partitionBy("file", "kind").orderBy(order)) - 1
    return lines.withColumn("old", old).join(merged.select("kind", "key", F.col("position").alias("new")), ["kind", "key"]).select("file", "kind", "old", "new")


def allowed_barcodes(dictionary: DataFrame, sheet: DataFrame | None) -> DataFrame:
    """Dictionary rows whose normalised barcode the sheet lists; all without a sheet."""
    if sheet is None:
        return dictionary
    return dictionary.join(sheet.select(F.col("barcode").alias("_b")).distinct(), F.concat(F.lit("barcode"), F.regexp_extract("name", "([0-9]+)[^0-9]*$", 1)) == F.col("_b"), "left_semi")


def barcode_settings(reads: DataFrame, settings: DataFrame, value: str) -> DataFrame:
    """Adds value: of the read's barcode, else of the row `default`.

    Once any specific row exists an unclassified read gets none.
    """
    specific = settings.where("barcode <> 'default'").select(F.col("barcode").alias("_b"), F.col(value).alias("_v"))
    rest = settings.agg(F.max(F.when(F.col("barcode") == "default", F.col(value))).alias("_default"), F.count_if(F.col("barcode") != "default").alias("_specific"))
    # one row, so a broadcast of fixed size
    out = reads.join(specific, F.col("barcode") == F.col("_b"), "left").join(F.broadcast(rest))
    chosen = F.when(F.col("_b").isNotNull(), F.col("_v")).when((F.col("barcode") == "unclassified") & (F.col("_specific") > 0), None).otherwise(F.col("_default"))
    return out.withColumn(value, chosen).drop("_b", "_v", "_default", "_specific")


def read_group_dimension(runs: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per run and model, with id `run_model`."""
    return runs.dropDuplicates(["run_id", "model"]).select(F.concat_ws("_", "run_id", "model").alias("id"), "run_id", "model", *attributes)


def output_headers(reads: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Adds header: the number of the read's attribute key among all keys in order."""
    numbered = groups.select(*keys).distinct().withColumn("header", F.dense_rank().over(Window.orderBy(*keys)) - 1)
    return reads.join(numbered, keys, "left")
