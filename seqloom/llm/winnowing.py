"""Winnowing fingerprints of whole texts with built-in functions only.

A text is lower-cased and loses its white space. Every K consecutive bytes of
what is left, in UTF-8, are a gram, at each byte and whatever the script; of
every window of W grams the least hash is kept, the rightmost of equal ones. So
any run of W + K - 1 bytes that two texts share leaves a common hash in both. A
kept gram is one long: 33 bits of hash above 31 bits that hold the largest
position less its own, so that the least long of a window is the least hash at
its rightmost place. Hashes compare as signed numbers; positions count from 1.

Bytes are an array with access in constant time, which characters of a string
are not. A byte gram's hash doesn't depend on its place, which is what rolling
hashes are for; it is taken whole, as a running value can't be kept between the
elements of an array here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 16, 16
#: Windows handled at once within a row, so that a very long text needs no arrays of its own length.
STRETCH = 32_768
#: Bytes of text in a range of doc_id, about.
RANGE_BYTES = 64_000_000
POSITION_BITS = 31
LAST = (1 << POSITION_BITS) - 1


def _least_of(a: str, offsets: list[int]) -> str:
    """The array of the least of a[i + o] over the offsets o, the first of them 0."""
    others = "".join(f", {a}[i + {o}]" for o in offsets[1:])
    return f"transform(slice({a}, 1, size({a}) - {offsets[-1]}), (x, i) -> least(x{others}))" if others else a


def _bytes(text: Column) -> Column:
    """What is fingerprinted of a text: lower case, no white space, UTF-8."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "").cast("binary")


def _with_kept(df: DataFrame, source: str, into: str, k: int, w: int) -> DataFrame:
    """Adds array<bigint> `into`: the kept grams of the binary column `source`."""
    # transform(array(x), v -> ...)[0] takes x once and calls it v; a column in a lambda is copied at each use
    grams = lambda a, b: f"transform(sequence({a}, {b}), i -> (xxhash64(substring(bytes, i, {k})) | {LAST}L) - i)"
    last = f"(octet_length({source}) - {k - 1})"
    # least of w neighbours: of some next to each other, then of those
    near = next(p for p in range(1, w + 1) if p * p >= w)
    far = [*range(0, w - near, near), w - near]
    window = f"transform(array({grams(f'c * {STRETCH} + 1', f'least(c * {STRETCH} + {STRETCH + w - 1}, {last})')}), g -> transform(array({_least_of('g', list(range(near)))}), m -> array_distinct({_least_of('m', far)}))[0])[0]"
    kept = f"""transform(array({source}), bytes -> CASE
        WHEN octet_length({source}) = 0 THEN array()
        WHEN octet_length({source}) < {k} THEN array((xxhash64(bytes) | {LAST}L) - 1)
        WHEN {last} <= {w} THEN array(array_min({grams('1', last)}))
        ELSE array_distinct(flatten(transform(sequence(0, ({last} - {w}) div {STRETCH}), c -> {window}))) END)[0]"""
    return df.withColumn(into, F.expr(kept).cast("array<bigint>"))


def with_winnow(df: DataFrame, text: str, into: str, k: int = K, w: int = W) -> DataFrame:
    """Adds array<bigint> `into`: the kept grams of column `text`.

    Null, empty and all-space texts have none; a text of fewer than k bytes
    without its spaces has the hash of all of them.
    """
    return _with_kept(df.withColumn("_b", _bytes(F.col(text))), "_b", into, k, w).drop("_b")


def with_rewinnow(df: DataFrame, text: str, kept: str, edited: str, same: str, into: str, k: int = K, w: int = W) -> DataFrame:
    """Adds array<bigint> `into`: what with_winnow gives for `edited`, made from `kept`, which it gave for `text`.

    The first `same` characters of both are equal. Windows wholly within them
    keep what they kept, so that hashing starts 2 * w - 1 grams before their
    end. Where lower case or spaces make the bytes of the two differ after
    all, or too few are equal, the whole text is hashed.
    """
    df = df.withColumns({"_a": _bytes(F.col(text)), "_b": _bytes(F.col(edited)), "_n": F.octet_length(_bytes(F.expr(f"left({text}, cast({same} as int))")))})
    equal = "octet_length(_a) >= _n AND octet_length(_b) >= _n AND substring(_a, 1, _n) = substring(_b, 1, _n)"
    # the first gram that is hashed; a gram kept w - 1 after it at most was kept by a window of equal bytes
    df = df.withColumn("_from", F.expr(f"IF(_n >= {k + 2 * w - 1} AND {equal}, _n - {k + 2 * w - 3}, 1)"))
    df = _with_kept(df.withColumn("_c", F.expr("substring(_b, _from)")), "_c", "_tail", k, w)
    old = f"IF(_from = 1, cast(array() as array<bigint>), filter({kept}, x -> {LAST}L - (x & {LAST}L) <= _from + {w - 1}))"
    return df.withColumn(into, F.expr(f"array_distinct(concat({old}, transform(_tail, x -> x - (_from - 1))))")).drop("_a", "_b", "_c", "_n", "_from", "_tail")


def hashes(kept: str) -> Column:
    """The distinct hashes of kept grams, without their places."""
    return F.expr(f"array_distinct(transform({kept}, x -> shiftright(x, {POSITION_BITS})))")


def as_text(kept: str) -> Column:
    """Kept grams in order of their places, as decimal numbers with a space between.

    A number x holds both parts: its hash is x >> POSITION_BITS, and the place of the
    gram, from 1, is LAST less its lowest POSITION_BITS bits.
    """
    return F.array_join(F.col(kept).cast("array<string>"), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE cast({both} as double) / (size({a}) + size({b}) - {both}) END")


def with_next(docs: DataFrame, columns: list[str], derive=None) -> DataFrame:
    """Adds next_<c> of the row after in descending (doc_id, text) order, for c in columns.

    derive: a function from rows to rows that adds columns; it sees each row
    once, besides the few that close ranges.

    After the last row comes the first. Null ids stand last. Rows are dealt
    out by ranges of doc_id, one window for each and about RANGE_BYTES of text
    in each; a copy of the first rows of a range closes the range before, so
    that no window spans the table.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []), reverse=True)
    # ranges are numbered from the largest ids on; null ids come after all
    range_of = f"CASE WHEN doc_id IS NULL THEN {len(cuts) + 1} ELSE size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c > doc_id)) END" if cuts else f"IF(doc_id IS NULL, {len(cuts) + 1}, 0)"
    ids = docs.select("doc_id", F.expr(range_of).alias("_range"))
    # one row for each range, so their number is bounded by the setting above
    heads = sorted((r[0], r[1]) for r in ids.groupBy("_range").agg(F.max("doc_id")).collect())
    marked = docs.withColumn("_range", F.expr(range_of)).withColumn("_copy", F.lit(0))
    if not heads:
        closing = marked.where("false")
    else:
        before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
        closing = None
        first = spark.createDataFrame([(r, m) for r, m in heads], "_r int, _head bigint")
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        closing = marked.join(F.broadcast(first), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_head"))).drop("_r", "_head").withColumn("_range", to[F.col("_range")]).withColumn("_copy", F.lit(1))
    w = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    # dealt out before anything is derived, so that derived columns aren't shuffled; by range, as few hashed numbers deal unevenly
    both = marked.unionByName(closing).repartitionByRange(ranges, "_range")
    both = derive(both) if derive else both
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("_copy = 0").drop("_range", "_copy")


def op9_winnowing(spark, sf_dir) -> DataFrame:
    """The contract's query: each text, its edited text, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "fp"], lambda rows: with_winnow(rows, "text", "fp"))
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))"))
    docs = docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited", "fp", "next_fp")
    docs = with_rewinnow(docs, "text", "fp", "edited", "n_chars - n_chars div 3", "edited_fp").drop("text", "edited")
    docs = docs.withColumns({"h": hashes("fp"), "edited_h": hashes("edited_fp"), "next_h": hashes("next_fp")})
    return docs.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), likeness("h", "edited_h").alias("near_edited"), likeness("h", "next_h").alias("near_next"))
