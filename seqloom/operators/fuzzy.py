"""Fuzzy dictionary joins: barcodes, adapters, tags, and k-mer candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.placement import place
from seqloom.functions.scalars import reverse_complement
from seqloom.operators import superkmers
from seqloom.session import drop, ship, table

#: Windows and limits of barcode classification.
WINDOW, PAD_LEFT, PAD_RIGHT = 175, 5, 10
MAX_PENALTY, SEPARATION, WIDE_SEPARATION, NEAR_END = 9, 3, 6, 75
FLANK_SCORE, MIDSTRAND_SCORE = 0.5, 0.95


def nearest(rows: DataFrame, dictionary: DataFrame, id_: str, text: str, max_distance: int = MAX_PENALTY, separation: int = SEPARATION, wide: int = WIDE_SEPARATION) -> DataFrame:
    """(id_, name, distance, second): the dictionary entry nearest to a text, if it stands apart.

    dictionary(name, seq) must be small, a kit of at most a few hundred entries;
    its size is checked, since each distinct text meets each entry. Classified if the
    distance is at most max_distance and the second is `separation` behind, or
    the second is `wide` behind; else name is unclassified.
    """
    if dictionary.limit(2001).count() > 2000:
        raise ValueError("a dictionary of over 2000 entries needs k-mer candidates first")
    texts = rows.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    met = texts.crossJoin(F.broadcast(dictionary.select("name", "seq"))).withColumn("distance", F.levenshtein("_text", "seq"))
    best = met.groupBy("_text").agg(F.min(F.struct("distance", "name")).alias("_b"))
    second = met.join(best, "_text").where("name <> _b.name").groupBy("_text").agg(F.min("distance").alias("second"))
    found = best.join(second, "_text", "left").withColumn("distance", F.col("_b.distance"))
    apart = F.coalesce(F.col("second") - F.col("distance"), F.lit(wide))
    ok = ((F.col("distance") <= max_distance) & (apart >= separation)) | (apart >= wide)
    found = found.select("_text", F.when(ok, F.col("_b.name")).otherwise("unclassified").alias("name"), "distance", "second")
    return rows.select(id_, text).join(found, F.col(text) == F.col("_text"), "left").select(id_, F.coalesce("name", F.lit("unclassified")).alias("name"), "distance", "second")


def classify_barcodes(reads: DataFrame, kit: DataFrame, id_: str, seq: str = "seq") -> DataFrame:
    """(id_, name, penalty, second, flank_score, start, end, end_of_read, reason) of one-flank kits.

    kit(name, front, barcode, rear): the front window and the reverse complement
    of the rear window are placed against front + N's + rear; the padded barcode
    found there is compared with each of the kit's. A flank in the middle of a
    read, or too poor, or no entry that stands apart leaves it unclassified.
    """
    ship(reads.sparkSession)
    flanks = kit.select("front", "rear", F.length("barcode").alias("size")).distinct()
    windows = f"array(struct('front' AS side, left({seq}, {WINDOW}) AS win), struct('rear' AS side, reverse(translate(right({seq}, {WINDOW}), 'ACGTacgt', 'TGCAtgca')) AS win))"
    sides = reads.select(id_, F.explode(F.expr(windows)).alias("x")).select(id_, "x.*")
    placed = sides.crossJoin(F.broadcast(flanks)).withColumn("mask", F.expr("concat(front, repeat('N', size), rear)"))
    placed = placed.withColumn("p", place("mask", "win")).withColumn("flank_score", 1 - F.col("p.dist") / F.greatest(F.lit(1), F.length("front") + F.length("rear")))
    cut = placed.withColumn("piece", F.expr(f"substr(win, greatest(1, p.start + length(front) + 1 - {PAD_LEFT}), size + least({PAD_LEFT}, p.start + length(front)) + {PAD_RIGHT})"))
    entries = kit.select("name", "barcode", F.col("front").alias("_f"), F.col("rear").alias("_r"))
    met = cut.join(F.broadcast(entries), (F.col("front") == F.col("_f")) & (F.col("rear") == F.col("_r")))
    met = met.withColumn("q", place("barcode", "piece")).withColumn("penalty", F.col("q.dist"))
    w = Window.partitionBy(id_).orderBy("penalty", F.desc("flank_score"), "side", "name")
    per_name = met.withColumn("_k", F.row_number().over(Window.partitionBy(id_, "name").orderBy("penalty", F.desc("flank_score"), "side"))).where("_k = 1")
    top = per_name.withColumns({"_n": F.row_number().over(w), "second": F.lead("penalty").over(w)}).where("_n = 1")
    apart = F.coalesce(F.col("second") - F.col("penalty"), F.lit(WIDE_SEPARATION))
    clear = ((F.col("penalty") <= MAX_PENALTY) & (F.col("flank_score") >= FLANK_SCORE) & (apart >= SEPARATION)) | (apart >= WIDE_SEPARATION)
    reason = F.when(F.col("p.start") > NEAR_END, F.when(F.col("flank_score") >= MIDSTRAND_SCORE, "midstrand").otherwise("far from the end")).when(~clear, "not apart")
    return top.withColumn("reason", reason).select(id_, F.when(F.col("reason").isNull(), F.col("name")).otherwise("unclassified").alias("name"), "penalty", "second", "flank_score", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("side").alias("end_of_read"), "reason")


def both_ends(front: DataFrame, rear: DataFrame, id_: str) -> DataFrame:
    """(id_, name) of double-ended kits: both ends must name the same barcode."""
    a, b = front.select(id_, F.col("name").alias("_a")), rear.select(id_, F.col("name").alias("_b"))
    return a.join(b, id_, "full").select(id_, F.when((F.col("_a") == F.col("_b")), F.col("_a")).otherwise("unclassified").alias("name"))


def trim_interval(hits: DataFrame, id_: str, length: str, min_flank: float = 0.6) -> DataFrame:
    """(id_, t_start, t_end) from hits(id_, side, start, end, flank_score, length): ends move past good flanks.

    Rear positions count from the read's end. An empty result keeps the read.
    """
    ok = F.col("flank_score") > min_flank
    a = F.max(F.when(ok & (F.col("side") == "front"), F.col("end")))
    b = F.max(F.when(ok & (F.col("side") == "rear"), F.col("end")))
    out = hits.groupBy(id_, length).agg(F.coalesce(a, F.lit(0)).alias("t_start"), (F.col(length) - F.coalesce(b, F.lit(0))).alias("t_end"))
    whole = F.col("t_start") >= F.col("t_end")
    return out.select(id_, F.when(whole, 0).otherwise(F.col("t_start")).alias("t_start"), F.when(whole, F.col(length)).otherwise(F.col("t_end")).alias("t_end"))


def inner_interval(a: DataFrame, b: DataFrame, id_: str, length: str) -> DataFrame:
    """(id_, t_start, t_end, emptied): two trims combined; an empty one leaves the read whole and is marked."""
    m = a.select(id_, length, F.col("t_start").alias("_s"), F.col("t_end").alias("_e")).join(b.select(id_, F.col("t_start").alias("_s2"), F.col("t_end").alias("_e2")), id_, "left")
    m = m.withColumns({"t_start": F.greatest("_s", F.coalesce("_s2", F.lit(0))), "t_end": F.least("_e", F.coalesce("_e2", F.col(length)))}).withColumn("emptied", F.col("t_start") >= F.col("t_end"))
    return m.select(id_, F.when(F.col("emptied"), 0).otherwise(F.col("t_start")).alias("t_start"), F.when(F.col("emptied"), F.col(length)).otherwise(F.col("t_end")).alias("t_end"), "emptied")


def adapters(reads: DataFrame, queries: DataFrame, id_: str, seq: str = "seq", front: int = 75, rear: int = 150, accept: float = 0.8, near: float = 0.1) -> DataFrame:
    """(id_, side, name, score, start, end): the best adapter or primer at each end.

    queries(name, seq). Candidates are folded by name: a later one wins if its
    score is better by over `near`, or within `near` and its span longer.
    """
    ship(reads.sparkSession)
    sides = reads.select(id_, F.explode(F.expr(f"array(struct('front' AS side, left({seq}, {front}) AS win), struct('rear' AS side, right({seq}, {rear}) AS win))")).alias("x")).select(id_, "x.*")
    met = sides.crossJoin(F.broadcast(queries.select("name", F.col("seq").alias("query")))).withColumn("p", place("query", "win"))
    met = met.select(id_, "side", F.struct("name", (1 - F.col("p.dist") / F.length("query")).alias("score"), F.col("p.start").alias("start"), F.col("p.end").alias("end")).alias("c"))
    listed = met.groupBy(id_, "side").agg(F.sort_array(F.array_agg("c")).alias("cs"))
    fold = F.expr(f"aggregate(slice(cs, 2, size(cs)), cs[0], (a, c) -> if(c.score > a.score + {near} OR (c.score >= a.score - {near} AND c.end - c.start > a.end - a.start), c, a))")
    return listed.withColumn("b", fold).where(F.col("b.score") >= accept).select(id_, "side", "b.*")


def orient_primers(found: DataFrame, id_: str) -> DataFrame:
    """(id_, primer, orientation) from names like X_FORWARD / X_REVERSE at front and rear."""
    wide = found.groupBy(id_).agg(*[F.max(F.when(F.col("side") == s, F.col("name"))).alias(s) for s in ("front", "rear")])
    name = F.regexp_replace(F.coalesce("front", "rear"), "_(FORWARD|REVERSE)$", "")
    agree = F.col("front").isNull() | F.col("rear").isNull() | (F.regexp_replace("front", "_(FORWARD|REVERSE)$", "") == F.regexp_replace("rear", "_(FORWARD|REVERSE)$", ""))
    way = F.when(F.col("front").endswith("_FORWARD") | (F.col("front").isNull() & F.col("rear").endswith("_REVERSE")), "+").when(F.col("front").endswith("_REVERSE") | (F.col("front").isNull() & F.col("rear").endswith("_FORWARD")), "-")
    return wide.select(id_, F.when(agree, name).otherwise("unclassified").alias("primer"), F.when(agree, F.coalesce(way, F.lit("?"))).otherwise("?").alias("orientation"))


def umi(reads: DataFrame, id_: str, trim_start: str, pattern: str = "TTTVVVVTTVVVVTTVVVVTTVVVVTTT", window: int = 40, before: int = 6, accept: float = 0.8, seq: str = "seq", reverse: str | None = None) -> DataFrame:
    """(id_, umi, score) of the pattern in a window from `before` bases ahead of the trim point.

    On reverse reads the window is of the reverse complement. Rows that match
    exactly are found by an expression; only the rest are placed.
    """
    ship(reads.sparkSession)
    letters = {"V": "[ACG]", "N": "[ACGT]"}
    exact = "".join(letters.get(c, c) for c in pattern)
    text = F.when(F.col(reverse), reverse_complement(seq)).otherwise(F.col(seq)) if reverse else F.col(seq)
    win = reads.withColumn("_t", text).withColumn("win", F.expr(f"substr(_t, greatest(1, {trim_start} - {before} + 1), {window})"))
    win = win.withColumn("_x", F.regexp_extract("win", exact, 0))
    sure = win.where("_x <> ''").select(id_, F.col("_x").alias("umi"), F.lit(1.0).alias("score"))
    rest = win.where("_x = ''").withColumn("p", place(F.lit(pattern), F.col("win"))).withColumn("score", 1 - F.col("p.dist") / len(pattern)).where(F.col("score") >= accept)
    return sure.unionByName(rest.select(id_, F.expr("substr(win, p.start + 1, p.end - p.start)").alias("umi"), "score"))


#: Rounds in which k-mers are counted, so that the disk holds the shuffled stretches of one.
ROUNDS = 2


def kmer_pairs(docs: DataFrame, id_: str, text: str, k: int, top: float, min_shared: int) -> DataFrame:
    """(a, b, shared): pairs of different texts that share at least min_shared distinct k-mers, a < b.

    Equal texts are searched once, as their least id; each other id of the text
    is a pair (least id, id) with a null `shared`. Of all distinct k-mers the
    most frequent ones, a fraction `top`, make no pairs: their frequency is the
    cut-off, taken from the counts of the whole table. A group of copies loses no
    link. Of different texts under one least id the one of least digest counts.

    Texts are shuffled as stretches of k-mers with one least m-mer, not as k-mers, and
    k-mers of one bucket that occur in the same texts are kept once, with their number.
    Both go in blocks (operators/superkmers.py).
    """
    spark, kind = docs.sparkSession, docs.schema[id_].dataType
    rows = docs.where(F.col(id_).isNotNull() & F.col(text).isNotNull()).select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    rows = table(rows.select("*", F.sha2("_text", 256).alias("_key"), F.length("_text").alias("_size"), F.monotonically_increasing_id().alias("_row")), "texts")
    # copies, and rows that are not searched; texts themselves are not shuffled
    known = rows.select("_id", "_key", "_row")
    known = table(known.join(known.groupBy(F.col("_key").alias("_lead")).agg(F.min("_id").alias("a")), F.col("_key") == F.col("_lead")).drop("_lead"), "known")
    copies = table(known.where("a <> _id").select("a", F.col("_id").alias("b"), F.lit(None).cast("bigint").alias("shared")), "copies")
    kept = known.where("a = _id").groupBy("a").agg(F.min_by("_row", F.struct("_key", "_row")).alias("_row"))
    # an id twice over with its text stays once
    spare = table(known.select("_row").join(kept, "_row", "left_anti"), "spare")
    texts = rows.where(F.col("_size") >= k).join(spare, "_row", "left_anti")
    if isinstance(kind, T.IntegralType):
        names, texts = None, texts.withColumn("_n", F.col("_id").cast("bigint"))
    else:
        # numbers in the order of ids
        names = table(kept.select("a").repartitionByRange("a").sortWithinPartitions("a").withColumn("_n", F.monotonically_increasing_id()), "names")
        texts = texts.join(names, F.col("_id") == F.col("a"))
    letters = rows.agg(F.sum("_size")).first()[0] or 0
    buckets = max(superkmers.BUCKETS, letters // ROUNDS // superkmers.BLOCK)
    # some buckets a task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    tables = []
    for i in range(ROUNDS):
        blocks = superkmers.stretches(texts, "_n", "_text", k, buckets, i, ROUNDS).repartition(parts, "bucket")
        tables.append(table(superkmers.shared_kmers(blocks, k), "kmers"))
    drop(rows, known, spare)
    seeds = reduce(DataFrame.unionByName, tables)
    # one row for each frequency that occurs
    by_n = seeds.groupBy("n").agg(F.sum("kmers").alias("kmers"), F.sum("sets").alias("sets"))
    histogram = sorted(((r["n"], r["kmers"], r["sets"]) for r in by_n.collect()), reverse=True)
    passed, cut = int(sum(c for _, c, _ in histogram) * top), 0
    for n, c, _ in histogram:
        cut = n
        passed -= c
        if passed < 0:
            break
    pairs = sum(n * (n - 1) // 2 * s for n, _, s in histogram if n <= cut)
    met = superkmers.shared_pairs(seeds.where(F.col("n").between(2, cut)), pairs, min_shared)
    if names is None:
        met = met.withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})
    else:
        for c in ("a", "b"):
            met = met.withColumnRenamed(c, "_n").join(names.select("_n", F.col("a").alias(c)), "_n").drop("_n")
        met = met.select("a", "b", "shared")
    return met.unionByName(copies)


def expand_barcodes(kits: DataFrame) -> DataFrame:
    """(kit, name) for first_index..last_index through a pattern like BC%02i."""
    return kits.withColumn("i", F.explode(F.expr("sequence(first_index, last_index)"))).select("kit", F.expr("format_string(replace(barcode1_pattern, '%02i', '%02d'), i)").alias("name"))
