"""Queries on intervals, islands, chunks and series; events and documents stand in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import intervals as I
from seqloom.operators import series as R
from seqloom.plans.registry import query
from seqloom.session import read

_A = "SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value * 30) AS BIGINT) AS e, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events"
_B = "SELECT event_id AS bid, user_id, epoch_us(ts) // 1000000 - 600 AS bs, epoch_us(ts) // 1000000 + CAST(floor(value * 400) AS BIGINT) AS be, CASE WHEN event_id % 3 = 0 THEN '.' ELSE '+' END AS bstrand FROM events WHERE event_type = 'click'"
_WIDTH = 3600


def _a(spark, d):
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return read(spark, d, "events").select("event_id", "user_id", t.alias("start"), (t + F.floor(F.col("value") * 30)).alias("end"), F.expr("if(event_id % 2 = 0, '+', '-')").alias("strand"))


def _b(spark, d):
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return read(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("bid"), "user_id", (t - 600).alias("b_start"), (t + F.floor(F.col("value") * 400)).alias("b_end"), F.expr("if(event_id % 3 = 0, '.', '+')").alias("b_strand"))


@query("interval_hits", f"WITH a AS ({_A}), b AS ({_B}) SELECT event_id, count(bid) AS hits FROM a LEFT JOIN b ON a.user_id = b.user_id AND s < be AND bs < e AND s < e AND bs < be AND (strand = bstrand OR bstrand = '.') GROUP BY event_id")
def interval_hits(spark, d):
    return I.overlap_counts(_a(spark, d), _b(spark, d), ["user_id"], "event_id", _WIDTH, stranded=True)


@query("interval_hits_inclusive", f"WITH a AS ({_A}), b AS ({_B}) SELECT event_id, count(bid) AS hits FROM a LEFT JOIN b ON a.user_id = b.user_id AND s <= be AND bs <= e GROUP BY event_id")
def interval_hits_inclusive(spark, d):
    return I.overlap_counts(_a(spark, d), _b(spark, d), ["user_id"], "event_id", _WIDTH, inclusive=True)


@query("interval_semi", f"WITH a AS ({_A}), b AS ({_B}) SELECT event_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND s >= bs + 60 AND e <= be - 60 AND s < e)")
def interval_semi(spark, d):
    return I.inside(_a(spark, d), _b(spark, d), ["user_id"], "event_id", _WIDTH, shrink=60).select("event_id")


@query("interval_anti", f"WITH a AS ({_A}), b AS ({_B}) SELECT event_id FROM a WHERE user_id IN (SELECT user_id FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND s < be - 60 AND bs + 60 < e AND s < e AND bs + 60 < be - 60)")
def interval_anti(spark, d):
    return I.inside(_a(spark, d), _b(spark, d), ["user_id"], "event_id", _WIDTH, shrink=60, negate=True).select("event_id")


@query("merge_variants", f"""WITH a AS ({_A}), x AS (SELECT *, s <= max(e) OVER w AS joined FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS k FROM x)
SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM y GROUP BY user_id, k""")
def merge_variants(spark, d):
    from seqloom.operators.consensus import merge_variants as merge

    return merge(_a(spark, d), ["user_id"])


@query("merge_ranges", f"""WITH a AS ({_A}), x AS (SELECT *, s <= max(e) OVER w + 3600 AS joined FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS k FROM x)
SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM y GROUP BY user_id, k""")
def merge_ranges(spark, d):
    return I.merge_ranges(_a(spark, d), ["user_id"], 3600)


@query("rle_runs", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS run, min(event_id) AS "first", max(event_id) AS "last", event_type, count(*) AS n FROM x GROUP BY user_id, event_type, g""")
def rle_runs(spark, d):
    return I.runs(read(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


@query("threshold_clusters", """WITH h AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 400 THEN 0 ELSE 1 END AS nw FROM events WHERE value > 10 AND event_id >= 50),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM h)
SELECT user_id, min(event_id) AS "start", max(event_id) + 1 AS "end", arg_max(event_id, (value, event_id)) AS peak, max(value) AS top FROM c GROUP BY user_id, k""")
def threshold_clusters(spark, d):
    return R.threshold_clusters(read(spark, d, "events"), ["user_id"], "event_id", "value", 10, 400, ignore_prefix=50)


@query("gap_parts", "SELECT event_id, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 100 THEN 0 ELSE 1 END AS nw FROM events)")
def gap_parts(spark, d):
    return I.split_on_gap(read(spark, d, "events"), ["user_id"], "event_id", 100).select("event_id", "part")


@query("tiles", """WITH x AS (SELECT doc_id, n_chars AS len, greatest(1, CAST(ceil((n_chars - 100) / 900.0) AS BIGINT)) AS n FROM documents WHERE n_chars > 0), y AS (SELECT *, unnest(range(0, n)) AS i FROM x)
SELECT doc_id, i * 900 AS tile_start, least(i * 900 + 1000, len) AS tile_end, CASE WHEN i = 0 THEN 0 ELSE i * 900 + 50 END AS start_no_overlap, CASE WHEN i = n - 1 THEN least(i * 900 + 1000, len) ELSE i * 900 + 950 END AS end_no_overlap FROM y""")
def tiles(spark, d):
    return I.tiles(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 1000, 100).drop("n_chars")


@query("equal_windows", """WITH x AS (SELECT doc_id, n_chars AS len, greatest(0, n_chars - 500) AS last FROM documents WHERE n_chars > 0), y AS (SELECT *, unnest(list_distinct(list_append(range(0, last + 1, 400), last))) AS s FROM x)
SELECT doc_id, s AS win_start, least(s + 500, len) AS win_end FROM y""")
def equal_windows(spark, d):
    return I.equal_windows(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 500, 400).drop("n_chars")


_CHUNKS = """WITH x AS (SELECT doc_id, text, n_chars AS len, greatest(0, (n_chars - 600) // 6 * 6) AS last FROM documents WHERE n_chars > 0), y AS (SELECT *, unnest(list_distinct(list_append(range(0, last + 1, 480), last))) AS s FROM x)"""


@query("chunk_offsets", _CHUNKS + " SELECT doc_id, s AS chunk_start, least(s + 600, len) AS chunk_end FROM y")
def chunk_offsets(spark, d):
    return R.chunk_offsets(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 600, 120, 6).drop("n_chars")


@query("balanced_chunks", """WITH x AS (SELECT doc_id, n_chars AS len, CAST(ceil(n_chars / 700.0) AS BIGINT) AS n FROM documents WHERE n_chars > 0), y AS (SELECT *, unnest(range(0, n)) AS i FROM x)
SELECT doc_id, len * i // n // 6 * 6 AS chunk_start, CASE WHEN i + 1 = n THEN len ELSE len * (i + 1) // n // 6 * 6 END AS chunk_end FROM y""")
def balanced_chunks(spark, d):
    return R.balanced_chunks(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 700, 6).drop("n_chars")


@query("chunk_stitch", "SELECT doc_id, md5(text) AS digest FROM documents WHERE length(text) > 0")
def chunk_stitch(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.length("text").alias("n"))
    # the last chunk reaches the end, as stitching is for all of the text
    chunks = R.chunk_offsets(docs, "n", 600, 120).withColumn("text", F.expr("substr(text, cast(chunk_start AS int) + 1, cast(chunk_end - chunk_start AS int))"))
    return R.stitch_chunks(chunks, "doc_id", "chunk_start", "chunk_end", "text").select("doc_id", F.md5("text").alias("digest"))


@query("spacer_parts", """WITH r AS (SELECT doc_id, n_chars AS len, n_chars // 3 AS a, n_chars // 3 + 40 AS b FROM documents WHERE n_chars > 200)
SELECT doc_id, 0 AS part, 0 AS "start", a AS "end" FROM r UNION ALL SELECT doc_id, 1, b, len FROM r""")
def spacer_parts(spark, d):
    docs = read(spark, d, "documents").where("n_chars > 200").select("doc_id", "n_chars")
    s = docs.select("doc_id", F.expr("n_chars div 3").alias("s_start"), F.expr("n_chars div 3 + 40").alias("s_end"))
    return R.split_at_spacers(docs, s, "doc_id", "n_chars").select("doc_id", "part", "start", "end")


@query("region_violations", """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderkey % 1000 AS s, o_orderkey % 1000 + 20 AS e FROM orders), c AS (SELECT CAST(c_custkey AS VARCHAR) AS name, CAST(900 AS BIGINT) AS length FROM customer WHERE c_custkey % 10 <> 0),
x AS (SELECT r.*, c.length, max(e) OVER (PARTITION BY r.name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r LEFT JOIN c USING (name))
SELECT name, s AS "start", e AS "end", CASE WHEN length IS NULL THEN 'unknown contig' WHEN e > length THEN 'out of bounds' ELSE 'overlaps another' END AS reason FROM x WHERE length IS NULL OR e > length OR s < b""")
def region_violations(spark, d):
    r = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 1000 + 20).alias("end"))
    c = read(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("name"), F.lit(900).cast("bigint").alias("length"))
    return I.region_violations(r, c)


@query("size_batches", "SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 20000 AS batch FROM documents")
def size_batches(spark, d):
    return I.batches(read(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", 20000).select("doc_id", "batch")


_LQ = "(SELECT l_returnflag, l_linestatus, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)"


@query("robust_scale", f"""WITH q AS (SELECT l_returnflag, l_linestatus, max(v) FILTER (k = CAST(floor(0.2 * (n - 1)) AS BIGINT) + 1) AS qa, max(v) FILTER (k = CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1) AS qb FROM {_LQ} GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(greatest(10.0, 0.51 * (qa + qb)), 6) AS shift, round(greatest(1.0, 0.53 * (qb - qa)), 6) AS scale FROM q""")
def robust_scale(spark, d):
    s = R.quantile_scaling(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return s.withColumns({"shift": F.round("shift", 6), "scale": F.round("scale", 6)})


@query("med_mad", """WITH m AS (SELECT l_returnflag, max(v) AS med FROM (SELECT l_returnflag, l_quantity AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)) WHERE k = (n - 1) // 2 + 1 GROUP BY 1),
x AS (SELECT l_returnflag, med, abs(l_quantity - med) AS dv FROM lineitem JOIN m USING (l_returnflag)), y AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY dv) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM x)
SELECT l_returnflag, med, round(dv * 1.4826 + 1.1920929e-07, 6) AS mad FROM y WHERE k = (n - 1) // 2 + 1""")
def med_mad(spark, d):
    return R.med_mad(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("mad", F.round("mad", 6))


@query("top_regions", "SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value <= 20 AND value * 20 <= 300) WHERE rank <= 3")
def top_regions(spark, d):
    e = read(spark, d, "events").withColumn("stop", F.col("event_id") + F.col("value") * 20)
    return R.top_regions(e.where("value * 20 <= 300"), ["user_id"], "value", "value", "event_id", "stop", 20, 301, 3).select("event_id", "rank")


_SIGNAL = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events"


def _signal(spark, d):
    return read(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)


# each window that could be the answer is tried by itself: is there a peak up to it, and does it end low?
@query("signal_start", f"""WITH x AS ({_SIGNAL}), u AS (SELECT DISTINCT user_id, n FROM x),
w AS (SELECT user_id, n, unnest(range(0, (n - 10) // 7)) AS p FROM u WHERE n >= 17),
k AS (SELECT w.user_id, w.n, p, count(*) FILTER (value > 12) AS large, max(value) FILTER (i = p * 7 + 16) AS final FROM w JOIN x ON x.user_id = w.user_id AND i BETWEEN p * 7 + 10 AND p * 7 + 16 GROUP BY ALL),
e AS (SELECT a.user_id, a.n, min(a.p) * 7 + 17 AS stop FROM k a WHERE a.final <= 12 AND EXISTS (SELECT 1 FROM k b WHERE b.user_id = a.user_id AND b.p <= a.p AND b.large > 3) GROUP BY 1, 2)
SELECT u.user_id, CASE WHEN stop < u.n - 10 THEN stop ELSE 10 END::BIGINT AS start FROM u LEFT JOIN e ON e.user_id = u.user_id""")
def signal_start(spark, d):
    return R.signal_start(_signal(spark, d), ["user_id"], "i", "value", 12.0, window=7)


@query("step_up", f"""WITH x AS ({_SIGNAL}), u AS (SELECT DISTINCT user_id, n FROM x),
s AS (SELECT user_id, n, unnest(range(4, 3 * n // 4, 2)) AS a FROM u), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS k FROM s),
m AS (SELECT t.user_id, k, a, list_sort(list(value))[(count(*) + 1) // 2] AS med FROM t JOIN x ON x.user_id = t.user_id AND i >= a AND i < a + 10 GROUP BY 1, 2, 3),
r AS (SELECT c.user_id, c.k, c.a, arg_min(o.k, row(o.med, o.k % 5)) AS lk, arg_max(o.k, row(o.med, o.k % 5)) AS hk, min(o.med) AS l, max(o.med) AS h FROM m c JOIN m o ON o.user_id = c.user_id AND o.k BETWEEN c.k - 4 AND c.k WHERE c.k >= 5 GROUP BY 1, 2, 3),
f AS (SELECT user_id, min(a) AS at_ FROM r WHERE hk > lk AND ((h > 14 AND h - l > 5) OR h - l > 8) GROUP BY 1)
SELECT u.user_id, coalesce(at_, 0)::BIGINT AS at FROM u LEFT JOIN f ON f.user_id = u.user_id""")
def step_up(spark, d):
    return R.step_up(_signal(spark, d), ["user_id"], "i", "value", window=10, stride=2, first=4, level=14.0, rise=5.0, rise_alone=8.0)


@query("plateaus")
def plateaus(spark, d):
    e = read(spark, d, "events").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return R.plateaus(e, "user_id", "idx", "value", window=4, max_sd=4.0, low=0.0, high=50.0, gap=6)


@query("min_pool", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pooled FROM events")
def min_pool(spark, d):
    return R.min_pool(read(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id", "pooled")


# one row after another, as the rule says: what a batch has so far and which batch it is
@query("greedy_batches", """WITH RECURSIVE x AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
g AS (SELECT source, doc_id, r, n AS held, 0::BIGINT AS batch FROM x WHERE r = 1
  UNION ALL SELECT x.source, x.doc_id, x.r, CASE WHEN g.held >= 20000 THEN x.n ELSE g.held + x.n END, g.batch + CASE WHEN g.held >= 20000 THEN 1 ELSE 0 END FROM g JOIN x ON x.source = g.source AND x.r = g.r + 1)
SELECT doc_id, source, batch FROM g""")
def greedy_batches(spark, d):
    return I.greedy_batches(read(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20000, 4096).select("doc_id", "source", "batch")


@query("even_parts", """SELECT c_custkey, p AS part, sum(s) OVER (PARTITION BY c_custkey ORDER BY p) - s AS start, sum(s) OVER (PARTITION BY c_custkey ORDER BY p) AS "end" FROM (SELECT c_custkey, p, (c_custkey % 40) // 7 + CASE WHEN p < (c_custkey % 40) % 7 THEN 1 ELSE 0 END AS s FROM customer, range(0, 7) AS t(p)) WHERE s > 0""")
def even_parts(spark, d):
    return I.even_parts(read(spark, d, "customer").select("c_custkey", F.expr("c_custkey % 40").alias("n")), "n", 7).drop("n")
