"""Queries on pileups, votes, consensus, variants, comparisons and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import consensus as C
from seqloom.operators import pileup as P
from seqloom.operators import quality as Q
from seqloom.plans.registry import query
from seqloom.session import read, shared_dir
from seqloom.streaming import processors, stateful

_COLS = "SELECT source, i AS major, lower(w[1:1]) AS symbol, count(*) AS n FROM (SELECT source, unnest(string_split_regex(trim(text), '\\s+')) AS w, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) - 1 AS i FROM documents) GROUP BY ALL"


def _columns(spark, d):
    """Words of all documents of a source, one above another: symbols are first letters."""
    words = read(spark, d, "documents").select("source", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("major", "w"))
    return words.groupBy("source", "major", F.lower(F.substring("w", 1, 1)).alias("symbol")).agg(F.count("*").alias("n"))


@query("pileup", _COLS)
def pileup(spark, d):
    return _columns(spark, d)


@query("majority_consensus", f"""WITH c AS ({_COLS}), r AS (SELECT *, row_number() OVER (PARTITION BY source, major ORDER BY n DESC, symbol = 't' DESC, symbol) AS k FROM c)
SELECT source, major, CASE WHEN n >= 2 THEN symbol ELSE 't' END AS consensus, n AS support FROM r WHERE k = 1""")
def majority_consensus(spark, d):
    return P.vote(_columns(spark, d).withColumn("target", F.lit("t")), ["source", "major"], "symbol", "n", "target")


@query("supported_columns", f"SELECT source, major, count(*) FILTER (n >= 3) AS symbols FROM ({_COLS}) GROUP BY 1, 2 HAVING count(*) FILTER (n >= 3) >= 2")
def supported_columns(spark, d):
    return P.supported_columns(_columns(spark, d), ["source", "major"], "n")


_SEQ = "translate(md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _alignments(spark, d):
    """Lineitems as alignments: 3 + k M, 2I, 4M, 2D, 3M with k the line number."""
    li = read(spark, d, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"), F.col("l_returnflag").alias("rname"), (F.col("l_partkey") % 200).alias("pos"), F.expr("if(l_linestatus = 'F', 16, 0) + if(l_discount > 0.09, 1024, 0)").alias("flag"), F.col("l_quantity").cast("int").alias("mapq"), F.expr("concat(3 + l_linenumber, 'M2I4M2D3M')").alias("cigar"), F.expr(_SEQ).alias("seq"), F.expr("map('RG', l_returnflag)").alias("tags"))


_PILE = f"""WITH a AS (SELECT l_returnflag AS rname, l_partkey % 200 AS pos, l_linestatus = 'F' AS rev, l_linenumber AS k, {_SEQ} AS seq FROM lineitem WHERE l_discount <= 0.09 AND CAST(l_quantity AS INT) >= 5),
b AS (SELECT rname, rev, pos + i AS major, 0 AS minor, seq[i + 1:i + 1] AS s FROM (SELECT *, unnest(range(0, 3 + k)) AS i FROM a)
  UNION ALL SELECT rname, rev, pos + 2 + k, i + 1, seq[3 + k + i + 1:3 + k + i + 1] FROM (SELECT *, unnest(range(0, 2)) AS i FROM a)
  UNION ALL SELECT rname, rev, pos + 3 + k + i, 0, seq[5 + k + i + 1:5 + k + i + 1] FROM (SELECT *, unnest(range(0, 4)) AS i FROM a)
  UNION ALL SELECT rname, rev, pos + 7 + k + i, 0, 'D' FROM (SELECT *, unnest(range(0, 2)) AS i FROM a)
  UNION ALL SELECT rname, rev, pos + 9 + k + i, 0, seq[9 + k + i + 1:9 + k + i + 1] FROM (SELECT *, unnest(range(0, 3)) AS i FROM a)),
p AS (SELECT rname, major, minor, CASE WHEN rev THEN lower(s) ELSE s END AS symbol, count(*) AS n FROM b GROUP BY ALL)"""


def _pile(spark, d):
    return P.pileup(_alignments(spark, d).where(P.passes(min_mapq=5)), "id")


@query("cigar_pileup", _PILE + " SELECT * FROM p")
def cigar_pileup(spark, d):
    return _pile(spark, d)


@query("depth_features", _PILE + ", q AS (SELECT rname, major, sum(n) AS depth FROM p WHERE minor = 0 GROUP BY 1, 2) SELECT p.*, coalesce(depth, 0) AS depth, round(n / greatest(coalesce(depth, 0), 1)::DOUBLE, 6) AS feature FROM p LEFT JOIN q USING (rname, major)")
def depth_features(spark, d):
    return P.depth_features(_pile(spark, d)).withColumn("feature", F.round("feature", 6))


@query("max_insertions", "SELECT l_returnflag AS rname, l_partkey % 200 + 2 + l_linenumber AS major, 2 AS inserted FROM lineitem GROUP BY ALL")
def max_insertions(spark, d):
    return P.max_insertions(_alignments(spark, d), "id")


@query("cigar_cut", """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, (1 + l_linenumber) || 'M2I3M' AS cigar, l_partkey % 200 + 2 AS pos FROM lineitem""")
def cigar_cut(spark, d):
    li = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (F.col("l_partkey") % 200).alias("pos"), F.expr("concat(3 + l_linenumber, 'M2I4M2D3M')").alias("cigar"), F.lit(2).alias("qs"), (F.col("l_linenumber") + 8).alias("qe"), F.monotonically_increasing_id().alias("row"))
    return P.cut_to_query(li, "row", "qs", "qe").join(li.select("row", "id"), "row").select("id", "cigar", "pos")


@query("overlap_windows")
def overlap_windows(spark, d):
    a = _alignments(spark, d).withColumns({"cigar": F.concat(F.col("cigar"), F.lit("60M35D40M")), "tlen": F.lit(400)})
    return P.overlap_windows(a.select("id", "pos", "cigar", "tlen"), "id", 50)


@query("topk_window", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 2000, 10) DESC, p_name || p_partkey) AS rank FROM part QUALIFY rank <= 5")
def topk_window(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 2000).alias("accuracy"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.lit(0).alias("longest_indel"))
    return P.top_overlaps(p, ["p_brand"], "name", 5).select("p_brand", "p_partkey", "rank")


@query("piles", """SELECT l_suppkey AS target, l_partkey AS query, l_orderkey FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity <= 45
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS INT), l_extendedprice) = 1""")
def piles(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("query"), "l_orderkey", F.lit(0).alias("tstart"), F.col("l_quantity").alias("tend"), F.lit(45).alias("tlen"), F.lit(0).alias("qstart"), F.lit(1).alias("qend"), F.lit(1).alias("qlen"), F.struct(F.expr("l_orderkey * 1000 + l_linenumber * 100 + cast(l_quantity AS int)"), "l_extendedprice").alias("o"))
    return P.piles(li, "o").select("target", "query", "l_orderkey")


_VC = "SELECT l_returnflag AS k, l_orderkey AS major, l_linenumber * 10 + row_number() OVER (PARTITION BY l_returnflag, l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 11 AS minor, l_linestatus AS ref, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS c1, CASE WHEN l_tax > 0.04 THEN 'F' ELSE '*' END AS c2 FROM lineitem"


def _vc(spark, d):
    w = Window.partitionBy("l_returnflag", "l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_orderkey").alias("major"), (F.col("l_linenumber") * 10 + F.row_number().over(w) - 11).alias("minor"), F.col("l_linestatus").alias("ref"), F.expr("if(l_quantity > 25, 'F', 'O')").alias("c1"), F.expr("if(l_tax > 0.04, 'F', '*')").alias("c2"))


_VM = f"WITH v AS ({_VC}), m AS (SELECT *, CASE WHEN minor = 0 THEN c1 <> ref OR c2 <> ref ELSE bool_or(c1 <> ref OR c2 <> ref) OVER (PARTITION BY k, major) END AS is_variant FROM v)"


@query("variant_columns", _VM + " SELECT * FROM m")
def variant_columns(spark, d):
    return C.variant_columns(_vc(spark, d), ["k"], "ref", ["c1", "c2"])


@query("variant_islands", _VM + """, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY major, minor) AS i FROM m), g AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY major, minor) AS island FROM n WHERE is_variant)
SELECT k, island, min(major) AS pos, replace(string_agg(ref, '' ORDER BY major, minor), '*', '') AS ref, replace(string_agg(c1, '' ORDER BY major, minor), '*', '') AS a1, replace(string_agg(c2, '' ORDER BY major, minor), '*', '') AS a2 FROM g GROUP BY k, island""")
def variant_islands(spark, d):
    v = C.variant_islands(_vc(spark, d), ["k"], "ref", ["c1", "c2"])
    return v.select("k", "island", "pos", "ref", F.col("alts")[0].alias("a1"), F.col("alts")[1].alias("a2"))


@query("genotype", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, 'N' AS r, l_returnflag AS a, l_linestatus AS b FROM lineitem),
y AS (SELECT *, list_sort(list_distinct(list_filter([a, b], lambda z: z <> r))) AS alts FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(alts, ',') AS alts,
  array_to_string(list_sort([coalesce(list_position(alts, a), 0), coalesce(list_position(alts, b), 0)]), '/') AS gt, CAST(round(q) AS INT) AS gq, CASE WHEN len(alts) = 0 THEN '.' WHEN q >= 10 THEN 'PASS' ELSE 'LowQual' END AS filter FROM y""")
def genotype(spark, d):
    li = read(spark, d, "lineitem").withColumns({"ref": F.lit("N"), "calls": F.array("l_returnflag", "l_linestatus")})
    g = C.genotype(li, "ref", "calls", "l_quantity", min_quality=10)
    return g.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("alts", ",").alias("alts"), "gt", "gq", "filter")


@query("consensus_decode", """WITH x AS (SELECT l_suppkey, l_returnflag || l_linestatus AS symbol, count(*) AS c FROM lineitem GROUP BY 1, 2), y AS (SELECT *, c / sum(c) OVER (PARTITION BY l_suppkey)::DOUBLE AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, symbol) AS k FROM x)
SELECT l_suppkey, symbol, round(least(70.0, -10 * log10(1 - p)), 3) AS quality FROM y WHERE k = 1""")
def consensus_decode(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("symbol")).agg(F.count("*").alias("c"))
    x = x.withColumn("prob", F.col("c") / F.sum("c").over(Window.partitionBy("l_suppkey"))).withColumn("index", F.expr("ascii(symbol) * 256 + ascii(right(symbol, 1))"))
    return C.decode(x, ["l_suppkey"])


@query("concat_windows", """WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS s FROM conversations), y AS (SELECT *, sum(CASE WHEN length(s) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM x),
p AS (SELECT conv_id, c, string_agg(s, '' ORDER BY turn) AS seq FROM y WHERE length(s) > 0 GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY c) - 1 AS part, count(*) OVER (PARTITION BY conv_id) AS n FROM p)
SELECT conv_id, part, CASE WHEN n > 1 THEN conv_id || ':' || part ELSE CAST(conv_id AS VARCHAR) END AS record, md5(seq) AS seq FROM q""")
def concat_windows(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.expr("if(turn % 3 = 2, '', text)").alias("s"))
    return C.concat_windows(c, "conv_id", "turn", "s").select("conv_id", "part", "record", F.md5("seq").alias("seq"))


@query("stitch", """SELECT doc_id AS name, 0 AS part, md5(text) AS seq FROM documents WHERE n_chars >= 300""")
def stitch(spark, d):
    docs = read(spark, d, "documents").where("n_chars >= 300").select(F.col("doc_id").alias("name"), F.col("text").alias("draft"))
    piece = lambda a, b: docs.select("name", F.lit(a).alias("start"), F.lit(b).alias("end"), F.expr(f"substr(draft, {a + 1}, {b - a})").alias("seq"))
    return C.stitch(piece(20, 90).unionByName(piece(150, 260)), docs).select("name", "part", F.md5("seq").alias("seq"))


@query("trim_overlaps", """WITH e AS (SELECT event_id, user_id, event_id * 10 AS s, event_id * 10 + CAST(floor(value * 100) AS BIGINT) AS t FROM events),
r AS (SELECT *, (SELECT max(o.t) FROM e o WHERE o.user_id = e.user_id AND (o.s, o.t) < (e.s, e.t)) AS b FROM e),
k AS (SELECT *, lag(t) OVER w AS pt, lead(s) OVER w AS ns FROM r WHERE b IS NULL OR t > b WINDOW w AS (PARTITION BY user_id ORDER BY s, t))
SELECT event_id, user_id, s AS start, t AS "end", CASE WHEN b IS NULL THEN 'first' WHEN s < b THEN 'overlap' WHEN s = b THEN 'abut' ELSE 'gap' END AS relation, CASE WHEN pt > s THEN (pt + s) // 2 ELSE s END AS keep_start, CASE WHEN ns < t THEN (t + ns) // 2 ELSE t END AS keep_end FROM k
UNION ALL SELECT event_id, user_id, s, t, 'within', s, s FROM r WHERE t <= b""")
def trim_overlaps(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.floor(F.col("value") * 100)).alias("end"))
    return C.trim_overlaps(e, ["user_id"])


@query("frame_compare", """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, q * 1.001 AS q, CASE WHEN l_suppkey % 10 = 0 THEN 'X' ELSE f END AS f FROM a WHERE l_suppkey % 7 <> 0),
m AS (SELECT a.l_suppkey AS ka, b.l_suppkey AS kb, a.q AS aq, b.q AS bq, a.f AS af, b.f AS bf FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey),
o AS (SELECT count(*) FILTER (kb IS NULL) AS only_a, count(*) FILTER (ka IS NULL) AS only_b, count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) AS compared, avg(abs(aq - bq) / greatest(aq, bq) * 100) AS r,
  count(*) FILTER (aq <> bq) AS dq, count(*) FILTER (af <> bf) AS df FROM m)
SELECT 'q' AS "column", only_a, only_b, compared, round(r, 6) AS mean_ratio, dq AS differing, r <= 0.08 AS within FROM o UNION ALL SELECT 'f', only_a, only_b, compared, NULL, df, df = 0 FROM o""")
def frame_compare(spark, d):
    a = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    b = a.where("l_suppkey % 7 <> 0").withColumns({"q": F.col("q") * 1.001, "f": F.expr("if(l_suppkey % 10 = 0, 'X', f)")})
    return Q.compare_frames(a, b, "l_suppkey").withColumn("mean_ratio", F.round("mean_ratio", 6))


@query("quantiles", """SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.75), 6) AS q75, round(regr_slope(l_quantity, l_extendedprice), 9) AS slope, round(regr_intercept(l_quantity, l_extendedprice), 6) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1""")
def quantiles(spark, d):
    q = Q.quantiles_and_fit(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", [0.25, 0.5, 0.75])
    return q.select("l_returnflag", *[F.round(c, 9 if c == "slope" else 6).alias(c) for c in q.columns[1:]])


@query("perf_history", """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (value > 50) AS outliers, round(quantile_cont(value, 0.25) FILTER (value <= 50), 6) AS q1, round(quantile_cont(value, 0.5) FILTER (value <= 50), 6) AS median, round(quantile_cont(value, 0.75) FILTER (value <= 50), 6) AS q3 FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2""")
def perf_history(spark, d):
    h = Q.history(read(spark, d, "events"), ["event_type"], "ts", "2024-01-05 00:00:00", "value", 50)
    return h.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")}).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("classified_rate", "SELECT round(1 - count(*) FILTER (c_mktsegment = 'MACHINERY') / count(*)::DOUBLE, 9) AS classified FROM customer")
def classified_rate(spark, d):
    c = read(spark, d, "customer").select(F.expr("if(c_mktsegment = 'MACHINERY', 'unclassified', c_mktsegment)").alias("b"))
    return Q.classified_rate(c, "b").withColumn("classified", F.round("classified", 9))


@query("duplex_rate", "SELECT round(sum(l_extendedprice * 0.9) FILTER (l_linestatus = 'F') * 2 / sum(l_extendedprice * 0.9) FILTER (l_linestatus = 'O') * 100, 4) AS duplex_rate FROM lineitem")
def duplex_rate(spark, d):
    li = read(spark, d, "lineitem").select(F.expr("if(l_linestatus = 'F', 'duplex', 'simplex')").alias("kind"), F.col("l_extendedprice").alias("bases"), (F.col("l_extendedprice") * 0.1).alias("filtered"))
    return Q.duplex_rate(li).withColumn("duplex_rate", F.round("duplex_rate", 4))


@query("tail_summary", "WITH x AS (SELECT p_size - 5 AS n FROM part), m AS (SELECT n FROM x WHERE n > 0 AND n < 40 GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) SELECT count(*) FILTER (n > 0 AND n < 40) AS called, count(*) FILTER (NOT (n > 0 AND n < 40)) AS not_called, round(avg(n) FILTER (n > 0 AND n < 40), 6) AS mean_length, (SELECT n FROM m) AS modal_length FROM x")
def tail_summary(spark, d):
    return Q.tail_summary(read(spark, d, "part").select((F.col("p_size") - 5).alias("n")), "n", 40).withColumn("mean_length", F.round("mean_length", 6))


@query("homogeneous", "SELECT count(DISTINCT o_orderstatus) AS keys, count(DISTINCT o_orderstatus) = 1 AS ok FROM orders")
def homogeneous(spark, d):
    return Q.homogeneous(read(spark, d, "orders"), "o_orderstatus")


@query("input_consistency", "SELECT unnest(['several read groups', 'several models']) AS problem FROM (SELECT count(*) FROM orders)")
def input_consistency(spark, d):
    return Q.consistency(read(spark, d, "orders").select(F.col("o_orderstatus").alias("read_group"), F.col("o_orderpriority").alias("model"), (F.col("o_custkey") > 0).alias("has_moves")))


@query("record_compare", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'only in the first' WHEN doc_id % 10 = 1 THEN 'seq' WHEN doc_id % 10 = 2 THEN 'tags' END AS problem FROM documents WHERE doc_id % 10 < 3")
def record_compare(spark, d):
    a = read(spark, d, "documents").select("doc_id", F.col("text").alias("seq"), F.col("lang").alias("qual"), F.create_map(F.lit("s"), "source", F.lit("t"), F.lit("1")).alias("tags"))
    b = a.where("doc_id % 10 <> 0").select("doc_id", F.expr("if(doc_id % 10 = 1, concat(seq, '!'), seq)").alias("seq"), "qual", F.expr("if(doc_id % 10 = 2, map('s', 'other'), map('t', '2', 's', tags['s']))").alias("tags"))
    return Q.compare_records(a, b, "doc_id", ["t"])


@query("stream_pairs", """WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS t, lead(event_id) OVER w AS c, lead(epoch_us(ts)) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS template, c AS complement, (t2 - t) // 1000 AS gap_ms FROM x WHERE c IS NOT NULL AND (t2 - t) // 1000 < 7200000""")
def stream_pairs(spark, d):
    s = stateful.read_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.run_to_table(stateful.stream_pairs(s, "user_id", "ts", "event_id", "value", 7_200_000), "pairs")


@query("stream_progress", "WITH w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS n FROM events GROUP BY 1) SELECT epoch_us(s) // 1000000 AS start, n, CAST(sum(n) OVER (ORDER BY s) AS BIGINT) AS total FROM w")
def stream_progress(spark, d):
    s = stateful.read_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    done = stateful.run_to_table(stateful.progress_windows(s, "ts", "1 hour"), "progress", mode="complete")
    # as many rows as there are hours, whatever the number of events
    return done.select(F.unix_seconds("start").alias("start"), "n", F.sum("n").over(Window.orderBy("start")).alias("total"))


def _dealt(spark, df, name: str, parts: int):
    """A stream of df's rows in `parts` micro-batches, each row in one by a hash of it, then a heartbeat far ahead."""
    base = f"{shared_dir(spark)}/streams/in-{name}-{uuid.uuid4().hex}"
    # sorted by the hash, so that rows come in no order of time
    df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")).repartition(parts, "part").write.partitionBy("part").parquet(f"{base}/rows")
    # a folder is read whole in one micro-batch, its files being taken in turns of many
    for n in range(parts):
        spark.read.schema(df.schema).parquet(f"{base}/rows/part={n}").coalesce(1).write.parquet(f"{base}/in/{n:03d}")
    far = [F.col(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    df.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select(*far).coalesce(1).write.parquet(f"{base}/in/{parts:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in")


@query("late_pairs", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + event_id % 1000 * 1000 AS t, 300 + event_id % 1000 AS n FROM events),
x AS (SELECT *, lead(event_id) OVER w AS c, lead(s) OVER w AS s2, lead(n) OVER w AS n2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT user_id, event_id AS template, c AS complement, s2 - t AS gap_ms FROM x WHERE s2 - t >= 0 AND s2 - t < 7200000 AND least(n, n2) >= 500""")
def late_pairs(spark, d):
    """Pairs from shuffled micro-batches: rows come late by up to the whole span and still pair."""
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    e = e.withColumns({"end": F.expr("timestamp_millis(unix_millis(ts) + event_id % 1000 * 1000)"), "bases": F.expr("cast(300 + event_id % 1000 as int)")})
    pairs = processors.pair_reads(_dealt(spark, e, "pairs", 3), "user_id", "ts", "event_id", "end", "bases", 7_200_000, 500, "900 days")
    return stateful.run_to_table(pairs, "late-pairs")


@query("late_parents", "SELECT CAST(event_id AS VARCHAR) AS read_id, event_id IN (SELECT event_id * 2 % 5000 FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id * 3 % 5000 FROM events WHERE event_type = 'purchase') AS is_parent FROM events WHERE event_type <> 'purchase'")
def late_parents(spark, d):
    """Purchases name two other events as their parents; each other event is tagged once."""
    e = read(spark, d, "events").select(F.expr("if(event_type = 'purchase', null, cast(event_id as string))").alias("id"), F.expr("if(event_type = 'purchase', concat(event_id * 2 % 5000, ';', event_id * 3 % 5000), null)").alias("kids"), F.col("ts").cast("timestamp").alias("ts"))
    tagged = processors.tag_parents(_dealt(spark, e, "parents", 3), "id", "kids", "ts", 1000, "900 days")
    return stateful.run_to_table(tagged, "late-parents").where("read_id IS NOT NULL")


@query("window_gate", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem JOIN (SELECT l_orderkey, max(l_linenumber) AS e FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY l_orderkey, e HAVING count(DISTINCT l_linenumber) >= e")
def window_gate(spark, d):
    """Orders announce their lines and lines come in three shuffled micro-batches, the first twice over."""
    at = lambda c: F.col(c).cast("timestamp")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at("l_shipdate").alias("ts"))
    told = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("expected"), F.min("ts").alias("ts"))
    again = li.unionByName(li.where("l_linenumber = 1"))
    gates = processors.open_gates(_dealt(spark, told, "told", 3), _dealt(spark, again, "lines", 3), "l_orderkey", "expected", "l_linenumber", "ts", 1000, "9000 days")
    return stateful.run_to_table(gates, "gates").where("l_orderkey IS NOT NULL")


# a tile's state is the list of its slots' ends
@query("read_slots", """WITH RECURSIVE a AS (SELECT l_returnflag AS rname, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, 2 * l_orderkey + l_linenumber AS s, 2 * l_orderkey + l_linenumber + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
t AS (SELECT *, unnest(range(s // 400, (e - 1) // 400 + 1)) AS tile FROM a),
o AS (SELECT *, greatest(s, tile * 400) AS p, row_number() OVER (PARTITION BY rname, tile ORDER BY s, id, e) AS i FROM t),
r AS (SELECT rname, tile, i, id, p, 0::BIGINT AS slot, [e] AS ends FROM o WHERE i = 1
  UNION ALL SELECT rname, tile, i, id, p, coalesce(free, len(ends) + 1) - 1, CASE WHEN free IS NULL THEN list_append(ends, e) ELSE list_concat(list_append(ends[:free - 1], e), ends[free + 1:]) END
  FROM (SELECT o.*, r.ends, nullif(coalesce(list_position(list_transform(r.ends, lambda x: o.p >= x + 5), true), 0), 0) AS free FROM r JOIN o ON o.rname = r.rname AND o.tile = r.tile AND o.i = r.i + 1))
SELECT rname, tile, id, slot, p AS placed FROM r""")
def read_slots(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("rname"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (2 * F.col("l_orderkey") + F.col("l_linenumber")).alias("s"), F.col("l_quantity").cast("bigint").alias("n"))
    return P.read_slots(li.withColumn("e", F.col("s") + F.col("n")), "id", "rname", "s", "e", 400)


@query("pileup_accuracy", """SELECT l_returnflag AS rname, l_linestatus AS half, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 AND (l_suppkey % 3 = 0 OR 1 - (l_suppkey % 5) / (12.0 + l_linenumber) >= 0.8) GROUP BY 1, 2""")
def pileup_accuracy(spark, d):
    """Lineitems as alignments of 9 + n matches and 3 X, a third of them without NM, a third duplicates."""
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("rname"), F.col("l_linestatus").alias("half"), F.expr("if(l_partkey % 3 = 0, 1024, 0)").alias("flag"), F.lit(60).alias("mapq"), F.expr("concat(9 + l_linenumber, 'M2I3X1D')").alias("cigar"), F.create_map(F.lit("NM"), F.expr("if(l_suppkey % 3 = 0, null, cast(l_suppkey % 5 + 3 AS string))")).alias("tags"))
    return li.where(P.passes(min_snp_accuracy=0.8)).groupBy("rname", "half").agg(F.count("*").alias("n"))


@query("datatype_strata", """SELECT l_linestatus AS half, CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS dtype, CASE l_suppkey % 4 WHEN 2 THEN 'DT is missing' WHEN 3 THEN 'unknown DT t3' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL""")
def datatype_strata(spark, d):
    """Lineitems as alignments of two known types, an unknown one and none."""
    li = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("half"), F.create_map(F.lit("DT"), F.expr("if(l_suppkey % 4 = 2, null, concat('t', l_suppkey % 4))")).alias("tags"))
    typed, wrong = P.datatypes(li, "half", ["t0", "t1"])
    both = typed.select("half", "dtype", F.lit(None).cast("string").alias("reason")).unionByName(wrong.select("half", F.lit(None).cast("int").alias("dtype"), "reason"))
    return both.groupBy("half", "dtype", "reason").agg(F.count("*").alias("n"))
