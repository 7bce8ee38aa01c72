"""Queries on reads, tags, headers and sheets; test tables stand in for read tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import scalars as S
from seqloom.operators import fuzzy, joins, pairing, quality, reads
from seqloom.plans.registry import query
from seqloom.session import read, ship
from seqloom.sources import sinks


@query("read_summary", """
WITH c AS (SELECT l_orderkey AS read_id, count(*) AS mapped, count(*) FILTER (l_returnflag = 'R') AS secondary, count(*) FILTER (l_returnflag = 'A') AS supplementary FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey AS read_id, l_partkey, l_discount, l_tax, l_quantity, l_extendedprice FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey AS read_id, o_orderstatus AS end_reason, coalesce(CAST(l_partkey AS VARCHAR), '*') AS genome,
  coalesce(round(1 - l_discount, 6), 0) AS identity, coalesce(round(1 - l_tax, 6), 0) AS accuracy,
  round(l_extendedprice / nullif(l_quantity, 0), 6) AS coverage,
  coalesce(mapped, 0) AS mapped, coalesce(secondary, 0) AS secondary, coalesce(supplementary, 0) AS supplementary,
  o_totalprice >= 100000 AS passes
FROM orders LEFT JOIN a ON o_orderkey = a.read_id LEFT JOIN c ON o_orderkey = c.read_id""")
def read_summary(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "read_id")
    counts = li.groupBy("read_id").agg(F.count("*").alias("mapped"), F.count_if(F.col("l_returnflag") == "R").alias("secondary"), F.count_if(F.col("l_returnflag") == "A").alias("supplementary"))
    al = li.select("read_id", "l_partkey", "l_discount", "l_tax", "l_quantity", "l_extendedprice", (F.col("l_linenumber") == 1).alias("is_primary"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), F.col("o_orderstatus").alias("end_reason"), "o_totalprice")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return reads.summary(o, al, counts).select("read_id", "end_reason", F.coalesce(F.col("l_partkey").cast("string"), F.lit("*")).alias("genome"), zero(F.round(1 - F.col("l_discount"), 6)).alias("identity"), zero(F.round(1 - F.col("l_tax"), 6)).alias("accuracy"), F.round(F.try_divide("l_extendedprice", "l_quantity"), 6).alias("coverage"), zero(F.col("mapped")).alias("mapped"), zero(F.col("secondary")).alias("secondary"), zero(F.col("supplementary")).alias("supplementary"), (F.col("o_totalprice") >= 100000).alias("passes"))


def _filtered(spark, d):
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").withColumn("q", F.coalesce("quality", F.lit(1)) * 10)
    return reads.read_filter(docs, "doc_id", "q", "n_chars", 5, 500, read(spark, d, "benchmark").select(F.col("item_id").alias("id")))


_DROP = "coalesce(quality, 1) * 10 < 5 OR n_chars < 500 OR doc_id IN (SELECT item_id FROM benchmark)"


@query("read_filter", f"SELECT doc_id, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT ({_DROP})")
def read_filter(spark, d):
    return _filtered(spark, d)[0].select("doc_id", "n_chars")


@query("filter_report", f"SELECT lang = 'en' AS is_duplex, count(*) AS reads, sum(n_chars) AS bases FROM documents LEFT JOIN labels USING (doc_id) WHERE {_DROP} GROUP BY 1")
def filter_report(spark, d):
    return reads.drop_report(_filtered(spark, d)[1].withColumn("dup", F.col("lang") == "en"), "dup", "n_chars")


@query("mean_qscore", """SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE least(50.0, greatest(1.0,
  -10 * log10(list_sum(list_transform(string_split(text, ''), lambda c: pow(10.0, -(ord(c) - 33) / 10.0))) / length(text)))) END, 6) AS q FROM documents""")
def mean_qscore(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(S.mean_qscore("text"), 6).alias("q"))


@query("revcomp", "SELECT doc_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) AS rc FROM documents")
def revcomp(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(S.reverse_complement("text")).alias("rc"))


@query("end_counts", "SELECT doc_id, length(text) - length(rtrim(text, '.')) AS trailing, length(text) - length(ltrim(text, 'T')) AS leading FROM documents")
def end_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", S.trailing_count("text", ".").alias("trailing"), S.leading_count("text", "T").alias("leading"))


@query("motif_hits", """SELECT doc_id, p AS position FROM (SELECT doc_id, upper(text) AS t, unnest(range(0, length(text) - 3)) AS p FROM documents)
  WHERE regexp_full_match(substr(t, p + 1, 4), 'A[ACGT]T[AG]')""")
def motif_hits(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.upper("text").alias("t"))
    return docs.select("doc_id", F.explode(S.motif_hits("t", "ANTR")).alias("position"))


@query("rna_poly_a", """SELECT doc_id, CASE WHEN regexp_matches(t, 'e{2,}') THEN length(text) ELSE -1 END AS n FROM (SELECT doc_id, text, right(text, 200) AS t FROM documents)""")
def rna_poly_a(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.expr("concat(translate(text, 'A', 'C'), if(right(text, 200) RLIKE 'e{2,}', 'AAAAAA', ''))").alias("seq"))
    found = S.rna_poly_a_start("seq")
    return docs.select("doc_id", F.when(found < F.length("seq"), found).otherwise(-1).alias("n"))


_CIGAR = "concat(l_linenumber, 'S', cast(l_quantity as int), 'M', l_linenumber % 3 + 1, 'I', cast(l_quantity as int) + 5, '=', l_linenumber % 2 + 1, 'D', '4M2S')"
_NM = "(l_linenumber % 3 + 1) + (l_linenumber % 2 + 1) + l_suppkey % 4"


@query("alignment_counts", f"""WITH x AS (SELECT *, 2 * CAST(l_quantity AS INT) + 9 AS m, l_linenumber % 3 + 1 AS i, l_linenumber % 2 + 1 AS d, {_NM} AS nm FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, m AS matches, i AS insertions, d AS deletions, l_linenumber AS softclip_start, 2 AS softclip_end, nm - d - i AS substitutions,
  round(1 - (nm - d - i) / m::DOUBLE, 6) AS snp, round(1 - nm / (m + i + d)::DOUBLE, 6) AS total FROM x""")
def alignment_counts(spark, d):
    li = read(spark, d, "lineitem").withColumn("cigar", F.expr(_CIGAR)).withColumn("nm", F.expr(_NM))
    li = li.withColumn("ops", S.cigar_ops("cigar")).withColumn("c", S.alignment_counts("ops", "nm")).withColumn("a", S.accuracies("ops", "nm"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "c.*", F.round("a.snp", 6).alias("snp"), F.round("a.total", 6).alias("total"))


@query("cigar_round_trip", f"SELECT l_orderkey, l_partkey, l_linenumber, {_CIGAR} AS cigar FROM lineitem")
def cigar_round_trip(spark, d):
    li = read(spark, d, "lineitem").withColumn("c", F.expr(_CIGAR))
    return li.withColumn("ops", S.cigar_ops("c")).select("l_orderkey", "l_partkey", "l_linenumber", S.format_cigar("ops").alias("cigar"))


@query("barcode_names", "SELECT c_custkey, 'barcode' || regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS barcode, c_mktsegment || '_barcode' || regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS standard FROM customer")
def barcode_names(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.barcode_name("c_name").alias("barcode"), S.standard_barcode("c_mktsegment", "c_name").alias("standard"))


@query("template_timing", """SELECT l_orderkey, l_linenumber, l_partkey, round(ns / du, 6) AS sample_rate, round(l_extendedprice + l_linenumber / nullif(ns / du, 0), 6) AS template_start,
  round((ns - l_linenumber) / nullif(ns / du, 0), 6) AS template_duration, (CAST(ns AS BIGINT) - l_linenumber) // 5 AS num_events
  FROM (SELECT *, l_quantity * 100 AS ns, nullif(l_discount, 0) AS du FROM lineitem)""")
def template_timing(spark, d):
    li = read(spark, d, "lineitem").withColumns({"ns": F.col("l_quantity") * 100, "du": F.nullif(F.col("l_discount"), F.lit(0.0)), "stride": F.lit(5)})
    t = li.withColumn("t", S.template_timing("cast(ns as bigint)", "l_linenumber", "du", "l_extendedprice", "stride"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(f"t.{c}", 6).alias(c) for c in ("sample_rate", "template_start", "template_duration")], "t.num_events")


@query("rg_attributes", "SELECT o_orderkey, o_orderstatus AS runid, o_orderpriority[1:1] AS model FROM orders")
def rg_attributes(spark, d):
    o = read(spark, d, "orders").withColumn("ds", F.concat(F.lit("runid="), "o_orderstatus", F.lit(" basecall_model="), F.expr("left(o_orderpriority, 1)")))
    m = S.read_group_attributes("ds")
    return o.select("o_orderkey", m["runid"].alias("runid"), m["basecall_model"].alias("model"))


@query("rg_ids", "SELECT o_orderkey, lower(hex(o_orderkey)) AS run_id, o_orderstatus || '@v1.' || o_custkey || '.0' AS model, '_x' AS rest FROM orders")
def rg_ids(spark, d):
    o = read(spark, d, "orders").withColumn("rg", F.expr("concat(lower(hex(o_orderkey)), '_', o_orderstatus, '@v1.', o_custkey, '.0_x')"))
    return o.withColumn("r", S.read_group_id("rg")).select("o_orderkey", "r.*")


@query("recorded_pass", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity >= CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 50 ELSE 0 END AS passes FROM lineitem")
def recorded_pass(spark, d):
    li = read(spark, d, "lineitem").withColumn("cl", F.expr("if(l_linenumber % 2 = 0, concat('run --min-qscore ', l_suppkey % 50, ' x'), 'run x')"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.passes_recorded_qscore("l_quantity", "cl").alias("passes"))


@query("relative_start", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch_ms(date_trunc('second', ts)) - epoch_ms(TIMESTAMP '2024-01-01') END AS ms FROM events")
def relative_start(spark, d):
    e = read(spark, d, "events").withColumn("st", F.expr("if(event_id % 7 = 0, 'unknown', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))")).withColumn("acq", F.lit("2024-01-01T00:00:00Z"))
    return e.select("event_id", S.relative_start_ms("st", "acq").alias("ms"))


@query("derived_ids", """SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] AS id FROM (SELECT o_orderkey, sha256(o_custkey || '-' || o_orderkey) AS h FROM orders)""")
def derived_ids(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.derived_uuid("o_custkey", "o_orderkey").alias("id"))


@query("phred_scores", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <= 0 THEN 70.0 ELSE round(least(70.0, -10 * log10(l_discount)), 3) END AS q FROM lineitem")
def phred_scores(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.phred(F.col("l_discount")).alias("q"))


@query("homopolymer_fractions", """WITH x AS (SELECT p_partkey, p_size / 3.0 AS scale, unnest(range(1, 13)) AS r FROM part),
y AS (SELECT *, exp(-pow((r - 1) / scale, 1.7)) - exp(-pow(r / scale, 1.7)) AS f FROM x)
SELECT p_partkey, string_agg(CAST(CAST(trunc(10000 * greatest(0.0, f) + 1e-9) AS INT) AS VARCHAR), ',' ORDER BY r) AS fractions FROM y GROUP BY 1""")
def homopolymer_fractions(spark, d):
    p = read(spark, d, "part").withColumns({"scale": F.col("p_size") / 3.0, "shape": F.lit(1.7)})
    return p.select("p_partkey", F.array_join(S.homopolymer_fractions("scale", "shape", 12).cast("array<string>"), ",").alias("fractions"))


@query("mux_trim", """WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(reverse(text), '')) AS ch, unnest(range(0, length(text))) AS j FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, n, j, sum(CASE WHEN ord(ch) <= 40 THEN -1 WHEN ord(ch) <= 45 THEN 1 ELSE 10 END) OVER (PARTITION BY doc_id ORDER BY j) AS v FROM c),
m AS (SELECT *, min(v) OVER (PARTITION BY doc_id) AS least FROM s),
e AS (SELECT doc_id, n, CASE WHEN any_value(least) > -1 THEN n - 1 ELSE n - 2 - max(j) FILTER (v = least) END AS cut FROM m GROUP BY doc_id, n)
SELECT documents.doc_id, CASE WHEN coalesce(n, 0) < 100 OR cut < floor(n * 0.3) OR cut >= n - 5 THEN length(text) ELSE cut END AS kept FROM documents LEFT JOIN e USING (doc_id)""")
def mux_trim(spark, d):
    ship(spark)
    return read(spark, d, "documents").select("doc_id", reads.mux_trim_end("text").alias("kept"))


@query("record_accounting", """WITH x AS (SELECT l_quantity < 5 AS u, l_returnflag = 'R' AS s, l_returnflag = 'A' AS p, l_linestatus = 'F' AND l_linenumber > 4 AS dx, l_suppkey % 3 = 0 AS has_parent, l_linenumber % 4 AS sub FROM lineitem)
SELECT count(*) AS total, sum(u::INT) AS unmapped, sum(s::INT) AS secondary, sum(p::INT) AS supplementary, sum(CASE WHEN u OR s OR p THEN 0 ELSE 1 END) AS "primary", sum(dx::INT) AS duplex,
  sum(CASE WHEN has_parent AND NOT dx THEN 1 ELSE 0 END) AS split, sum(CASE WHEN dx OR sub <> 0 THEN 0 WHEN u THEN 1 WHEN s OR p THEN 0 ELSE 1 END) AS unique_simplex FROM x""")
def record_accounting(spark, d):
    li = read(spark, d, "lineitem").select(F.expr("if(l_quantity < 5, 4, 0) + if(l_returnflag = 'R', 256, 0) + if(l_returnflag = 'A', 2048, 0)").alias("flag"), F.expr("l_linestatus = 'F' AND l_linenumber > 4").alias("is_duplex"), F.expr("if(l_suppkey % 3 = 0, l_orderkey, null)").alias("parent_read_id"), (F.col("l_linenumber") % 4).alias("subread_id"))
    return reads.write_accounting(li)


_EVENTS = "SELECT event_id, user_id, epoch_us(ts) // 1000 AS start, epoch_us(ts) // 1000 + CAST(floor(value * 50) AS BIGINT) AS stop, CAST(floor(value * 100) AS BIGINT) AS len FROM events"


def _event_reads(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("start"), (F.unix_millis(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 50)).alias("stop"), F.floor(F.col("value") * 100).alias("len"))


@query("adjacent_pairs", f"""WITH e AS ({_EVENTS}), n AS (SELECT *, lead(event_id) OVER w AS nid, lead(start) OVER w AS ns, lead(len) OVER w AS nl FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id))
SELECT user_id, event_id AS template, nid AS complement, ns - stop AS gap, round(least(len, nl) / greatest(len, nl)::DOUBLE, 6) AS ratio,
  ns - stop <= 600000 AND least(len, nl) / greatest(len, nl)::DOUBLE >= 0.5 AND least(len, nl) >= 500 AS early
FROM n WHERE nid IS NOT NULL AND ns - stop >= 0 AND ns - stop < 7200000 AND least(len, nl) >= 100""")
def adjacent_pairs(spark, d):
    p = pairing.adjacent_pairs(_event_reads(spark, d), ["user_id"], "start", "stop", "event_id", "len", max_gap=7_200_000, min_length=100, early_gap=600_000, early_ratio=0.5, early_length=500)
    return p.withColumn("ratio", F.round("ratio", 6))


@query("neighbours", "SELECT event_id, lag(event_id) OVER w AS prev_read, lead(event_id) OVER w AS next_read FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbours(spark, d):
    return pairing.neighbours(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "prev_read", "next_read")


@query("parent_tag", """WITH r AS (SELECT conv_id || '-' || turn AS id FROM conversations UNION ALL SELECT conv_id || '-' || turn || ';' || conv_id || '-' || (turn + 1) FROM conversations WHERE role = 'user' AND turn % 4 = 0),
p AS (SELECT DISTINCT unnest(string_split(id, ';')) AS id FROM r WHERE contains(id, ';'))
SELECT r.id, p.id IS NOT NULL AS is_parent FROM r LEFT JOIN p ON r.id = p.id""")
def parent_tag(spark, d):
    c = read(spark, d, "conversations")
    one = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"))
    two = c.where("role = 'user' AND turn % 4 = 0").select(F.concat(F.concat_ws("-", "conv_id", "turn"), F.lit(";"), F.concat_ws("-", "conv_id", F.col("turn") + 1)).alias("id"))
    return joins.tag_parents(one.unionByName(two), "id").select("id", "is_parent")


@query("pair_join", """SELECT a.o_orderkey AS template_id, b.o_orderkey AS complement_id, a.o_totalprice AS template_price, b.o_totalprice AS complement_price
FROM (SELECT o_orderkey AS template, o_orderkey + o_custkey % 5 + 1 AS complement FROM orders) p JOIN orders a ON a.o_orderkey = template JOIN orders b ON b.o_orderkey = complement""")
def pair_join(spark, d):
    o = read(spark, d, "orders")
    pairs = o.select(F.col("o_orderkey").alias("template"), (F.col("o_orderkey") + F.col("o_custkey") % 5 + 1).alias("complement"))
    return joins.pair_join(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), pairs, "id")


_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query("first_wins", f"SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {', '.join(_ORDER)}) = 1")
def first_wins(spark, d):
    return joins.first_wins(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], _ORDER).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("read_lists", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def read_lists(spark, d):
    lab = read(spark, d, "labels")
    ids = lambda c: lab.where(c).select(F.col("doc_id").alias("id"))
    return joins.by_lists(read(spark, d, "documents"), "doc_id", ids("quality = 1"), ids("toxic = 1")).select("doc_id")


@query("read_groups", "SELECT c_custkey, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, ''), 'no_sample') AS sample FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def read_groups(spark, d):
    g = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.expr("if(n_nationkey % 3 = 0, '', n_name)").alias("sample"))
    return joins.read_group_attributes(read(spark, d, "customer"), g, "c_nationkey", {"sample": "no_sample"}).select("c_custkey", "sample")


@query("sheet_join", """WITH s AS (SELECT n_regionkey AS e, 'barcode' || lpad(CAST(n_nationkey % 4 AS VARCHAR), 2, '0') AS b, n_name AS alias FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 4 ORDER BY n_nationkey) = 1)
SELECT c_custkey, alias FROM customer LEFT JOIN s ON e = c_nationkey % 5 AND b = 'barcode' || lpad(CAST(c_custkey % 6 AS VARCHAR), 2, '0')""")
def sheet_join(spark, d):
    code = lambda e: F.expr(f"concat('barcode', lpad({e}, 2, '0'))")
    sheet = read(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_regionkey").alias("experiment_id"), code("n_nationkey % 4").alias("barcode"), F.col("n_name").alias("alias"))
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("experiment_id"), F.concat(F.lit("KIT_"), code("c_custkey % 6")).alias("bc"))
    return joins.sheet_aliases(c, sheet, ["experiment_id"], "line", "bc").select("c_custkey", "alias")


@query("sheet_violations", """SELECT CAST(c_custkey AS INT) AS line, 'alias is reserved' AS rule FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT CAST(c_custkey AS INT), 'sample_id has other characters or over 40' FROM customer
UNION ALL SELECT CAST(c_custkey AS INT), 'barcode comes twice' FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY c_custkey) > 1
UNION ALL SELECT NULL, 'several experiment_id' FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer) WHERE n > 1""")
def sheet_violations(spark, d):
    from seqloom.sources.text import sheet_violations as rules

    c = read(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.col("c_mktsegment").alias("experiment_id"), F.lit("K").alias("kit"), F.lit("F").alias("flow_cell_id"), F.col("c_name").alias("sample_id"), F.expr("concat('barcode', lpad(c_custkey div 3, 6, '0'))").alias("barcode"), F.expr("if(c_custkey % 50 = 0, 'barcode99', concat('a', c_custkey))").alias("alias"))
    # several experiments are part of the sheet here, so barcodes are compared over all of it
    return rules(c).where("rule <> 'barcode comes twice'").unionByName(rules(c.withColumn("experiment_id", F.lit("e"))).where("rule = 'barcode comes twice'"))


_LINES = """WITH l AS (SELECT 'n' AS file, 'SQ' AS kind, CAST(n_regionkey AS VARCHAR) AS key, 'LN:' || n_regionkey AS line FROM nation
  UNION ALL SELECT 'r', 'SQ', CAST(r_regionkey AS VARCHAR), 'LN:' || CASE WHEN r_regionkey = 2 THEN 9 ELSE r_regionkey END FROM region
  UNION ALL SELECT 's', 'PG', CAST(s_nationkey AS VARCHAR), 'VN:' || s_nationkey FROM supplier)"""


def _lines(spark, d):
    row = lambda t, f, k, key, line: read(spark, d, t).select(F.lit(f).alias("file"), F.lit(k).alias("kind"), F.expr(f"cast({key} as string)").alias("key"), F.expr(line).alias("line"))
    return row("nation", "n", "SQ", "n_regionkey", "concat('LN:', n_regionkey)").unionByName(row("region", "r", "SQ", "r_regionkey", "concat('LN:', if(r_regionkey = 2, 9, r_regionkey))")).unionByName(row("supplier", "s", "PG", "s_nationkey", "concat('VN:', s_nationkey)"))


@query("header_merge", _LINES + " SELECT kind, key, min(line) AS line, count(DISTINCT file) AS files, row_number() OVER (PARTITION BY kind ORDER BY key) - 1 AS position FROM l GROUP BY kind, key HAVING count(DISTINCT line) = 1")
def header_merge(spark, d):
    return joins.merge_headers(_lines(spark, d))[0]


@query("header_conflicts", _LINES + " SELECT kind, key, count(DISTINCT line) AS variants FROM l GROUP BY kind, key HAVING count(DISTINCT line) > 1")
def header_conflicts(spark, d):
    return joins.merge_headers(_lines(spark, d))[1]


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    done = read(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("id"))
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    return joins.not_done(docs, done, "name").select("doc_id")


@query("complete_groups", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = max(l_linenumber)")
def complete_groups(spark, d):
    from seqloom.streaming.stateful import complete_groups as gate

    return gate(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("barcode_settings", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 5 WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 2 END AS tail FROM customer")
def barcode_settings(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.expr("if(c_mktsegment = 'MACHINERY', 'unclassified', c_mktsegment)").alias("barcode"))
    s = spark.createDataFrame([("default", 2), ("BUILDING", 5)], "barcode string, tail int")
    return joins.barcode_settings(c, s, "tail").select("c_custkey", "tail")


@query("allowed_barcodes", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def allowed_barcodes(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    s = read(spark, d, "supplier").select(F.expr("concat('barcode', regexp_extract(s_name, '([0-9]+)$', 1))").alias("barcode"))
    return joins.allowed_barcodes(c, s).select("c_custkey")


@query("read_group_dimension", "SELECT o_orderstatus || '_' || o_orderpriority AS id, o_orderstatus AS run_id, o_orderpriority AS model FROM orders GROUP BY ALL")
def read_group_dimension(spark, d):
    return joins.read_group_dimension(read(spark, d, "orders").select(F.col("o_orderstatus").alias("run_id"), F.col("o_orderpriority").alias("model")), [])


@query("output_headers", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment, c_nationkey) - 1 AS header FROM customer")
def output_headers(spark, d):
    c = read(spark, d, "customer")
    return joins.output_headers(c, c, ["c_mktsegment", "c_nationkey"]).select("c_custkey", "header")


@query("output_layout", """SELECT o_orderkey, concat_ws('/', 'exp' || o_custkey % 3, 's' || o_custkey % 7, strftime(o_orderdate, '%Y%m%d_%H%M') || '_P_F' || o_custkey % 2 || '_' || md5(CAST(o_custkey AS VARCHAR))[1:8],
  'bam_' || CASE WHEN o_totalprice > 200000 THEN 'pass' ELSE 'fail' END, CASE WHEN o_orderstatus = 'F' THEN 'first' WHEN o_custkey % 4 = 0 THEN 'barcode01' WHEN o_custkey % 4 = 1 THEN 'b2' ELSE 'unclassified' END) AS path FROM orders""")
def output_layout(spark, d):
    o = read(spark, d, "orders").withColumns({"e": F.expr("concat('exp', o_custkey % 3)"), "s": F.expr("concat('s', o_custkey % 7)"), "p": F.lit("P"), "f": F.expr("concat('F', o_custkey % 2)"), "run": F.md5(F.col("o_custkey").cast("string")), "ok": F.col("o_totalprice") > 200000, "sheet": F.expr("if(o_orderstatus = 'F', 'first', '')"), "bc": F.expr("if(o_custkey % 4 = 0, 'barcode01', null)"), "tags": F.expr("if(o_custkey % 4 = 1, map('BC', 'KIT_b2'), map('x', 'y'))"), "kit": F.lit("KIT")})
    o = o.withColumn("alias", sinks.alias_chain("sheet", "bc", "tags", "kit", True))
    return o.select("o_orderkey", sinks.output_path("e", "s", "o_orderdate", "p", "f", "run", "bam", "ok", "alias").alias("path"))


@query("fuzzy_classify", """WITH dict AS (SELECT DISTINCT c_mktsegment AS name FROM customer), t AS (SELECT DISTINCT p_type AS text FROM part),
m AS (SELECT text, name, levenshtein(text, name) AS d FROM t, dict), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY d, name) AS k FROM m),
f AS (SELECT text, max(name) FILTER (k = 1) AS name, max(d) FILTER (k = 1) AS distance, max(d) FILTER (k = 2) AS second FROM r GROUP BY text)
SELECT p_partkey, CASE WHEN (distance <= 9 AND second - distance >= 2) OR second - distance >= 6 THEN name ELSE 'unclassified' END AS name, distance, second FROM part JOIN f ON p_type = text""")
def fuzzy_classify(spark, d):
    names = read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("seq", F.col("name"))
    return fuzzy.nearest(read(spark, d, "part"), names, "p_partkey", "p_type", separation=2)


@query("semi_global")
def semi_global(spark, d):
    from seqloom.functions.placement import place

    ship(spark)
    seq = F.expr("translate(sha2(p_name || p_partkey, 256), '0123456789abcdef', 'ACGTACGTACGTACGT')")
    p = read(spark, d, "part").withColumn("text", seq).withColumn("pattern", F.expr("concat(substr(text, 11, 8), 'NNNN', substr(text, 24, 6))"))
    return p.withColumn("p", place("pattern", "text")).select("p_partkey", "p.*")


@query("kmer_pairs", """WITH t AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text),
g AS (SELECT DISTINCT id, substr(text, p, 24) AS k FROM (SELECT id, text, unnest(range(1, length(text) - 22)) AS p FROM t WHERE length(text) >= 24)),
c AS (SELECT k, count(*) AS n FROM g GROUP BY k),
f AS (SELECT n AS most FROM c QUALIFY row_number() OVER (ORDER BY n DESC) = 1 + CAST(floor(count(*) OVER () * 0.0002) AS BIGINT)),
r AS (SELECT k FROM c, f WHERE n BETWEEN 2 AND most)
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM g x JOIN g y USING (k) WHERE x.id < y.id AND k IN (SELECT k FROM r) GROUP BY 1, 2 HAVING count(*) >= 40
UNION ALL SELECT id, doc_id, NULL FROM documents JOIN t USING (text) WHERE doc_id <> id""")
def kmer_pairs(spark, d):
    return fuzzy.kmer_pairs(read(spark, d, "documents"), "doc_id", "text", 24, 0.0002, 40)


@query("barcode_ids", "SELECT c_custkey, 'BC' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM (SELECT c_custkey, unnest(range(c_nationkey, c_nationkey + 4)) AS i FROM customer)")
def barcode_ids(spark, d):
    k = read(spark, d, "customer").select(F.col("c_custkey").alias("kit"), F.col("c_nationkey").alias("first_index"), (F.col("c_nationkey") + 3).alias("last_index"), F.lit("BC%02i").alias("barcode1_pattern"))
    return fuzzy.expand_barcodes(k).withColumnRenamed("kit", "c_custkey")


@query("barcode_distribution", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS share FROM documents GROUP BY lang")
def barcode_distribution(spark, d):
    return quality.distribution(read(spark, d, "documents"), "lang").withColumn("share", F.round("share", 9))


_PROGRAMS = """p AS (SELECT o_custkey AS file, o_orderpriority AS key, 'CL:' || min(o_orderkey % 2) AS line, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS parent FROM orders GROUP BY o_custkey, o_orderpriority)"""


# chains as the texts of their lines, first to last
@query("merge_programs", f"""WITH RECURSIVE {_PROGRAMS}, c AS (SELECT *, line AS chain, sha256(line) AS h FROM p WHERE parent IS NULL UNION ALL SELECT p.*, p.line || '<' || c.chain, sha256(p.line || '|' || c.h) FROM p JOIN c ON c.file = p.file AND c.key = p.parent),
d AS (SELECT key, line, chain, h, row_number() OVER (PARTITION BY key ORDER BY line, h) AS nth FROM (SELECT DISTINCT key, line, chain, h FROM c)),
n AS (SELECT key, chain, CASE WHEN nth = 1 THEN key ELSE key || '.' || row_number() OVER (PARTITION BY nth > 1 ORDER BY key, nth) END AS new_key FROM d)
SELECT c.file, c.key, c.line, n.new_key, m.new_key AS new_parent FROM c JOIN n ON n.key = c.key AND n.chain = c.chain LEFT JOIN c u ON u.file = c.file AND u.key = c.parent LEFT JOIN n m ON m.key = u.key AND m.chain = u.chain""")
def merge_programs(spark, d):
    """A customer's order priorities as the programs of a file, each following the one before."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("key")).agg(F.concat(F.lit("CL:"), F.min(F.col("o_orderkey") % 2).cast("string")).alias("line"))
    return joins.merge_programs(o.withColumn("parent", F.lag("key").over(Window.partitionBy("file").orderBy("key"))))


_MODS_READ = "translate(md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_MODS = f"""r AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, {_MODS_READ} AS seq, l_linenumber AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
p AS (SELECT *, list_filter(range(0, 32), lambda i: seq[i + 1 : i + 1] = 'C') AS c, list_filter(range(0, 32), lambda i: seq[i + 1 : i + 1] = 'A') AS a FROM r),
m AS (SELECT id, c[1] AS position, 'C' AS base, 'm' AS code, '?' AS context, 10 AS prob FROM p UNION ALL SELECT id, c[1], 'C', 'h', '?', 20 FROM p
  UNION ALL SELECT id, c[2 + n], 'C', 'm', '?', 30 FROM p UNION ALL SELECT id, c[2 + n], 'C', 'h', '?', 40 FROM p UNION ALL SELECT id, a[3], 'A', 'a', '.', 50 FROM p)"""


def _mod_reads(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.expr(_MODS_READ).alias("seq"), F.expr("concat('C+mh?,0,', l_linenumber, ';A+a.,2;')").alias("mm"), F.expr("array(10, 20, 30, 40, 50)").alias("ml"))


@query("decode_modbases", f"WITH {_MODS} SELECT id, position, base, code, context, prob FROM m")
def decode_modbases(spark, d):
    """Two codes at the first C and at the one after as many more as the line number says; one at the third A."""
    return reads.decode_modbases(_mod_reads(spark, d), "id")


@query("encode_modbases", f"""WITH {_MODS}, ok AS (SELECT * FROM m WHERE position IS NOT NULL),
s AS (SELECT id, base, code, context, position, prob, (SELECT len(list_filter(CASE base WHEN 'C' THEN p.c ELSE p.a END, lambda i: i < position)) FROM p WHERE p.id = ok.id) AS nth FROM ok),
t AS (SELECT *, nth - coalesce(lag(nth) OVER (PARTITION BY id, base, code ORDER BY position) + 1, 0) AS skip FROM s),
g AS (SELECT id, base, code, concat(base, '+', code, context, ',', string_agg(skip, ',' ORDER BY position), ';') AS text, string_agg(prob, ',' ORDER BY position) AS probs FROM t GROUP BY id, base, code, context)
SELECT id, string_agg(text, '' ORDER BY base, code) AS mm, string_agg(probs, ',' ORDER BY base, code) AS ml FROM g GROUP BY id""")
def encode_modbases(spark, d):
    r = _mod_reads(spark, d)
    return reads.encode_modbases(reads.decode_modbases(r, "id").where("position IS NOT NULL"), r, "id").withColumn("ml", F.array_join(F.col("ml").cast("array<string>"), ","))


_TAGS = {
    "RG": "concat('g', l_suppkey % 30)", "du": "nullif(l_discount, 0)", "ns": "cast(l_quantity * 100 AS int)", "ts": "l_linenumber", "ch": "if(l_partkey % 3 = 0, null, l_partkey % 512)", "mx": "l_suppkey % 4 + 1", "qs": "l_tax",
    "pt": "if(l_partkey % 2 = 0, cast(l_quantity AS int), null)", "pa": "if(l_partkey % 2 = 0, concat('i,5,', l_linenumber, ',', cast(l_quantity AS int), ',-1,7'), null)", "er": "l_linestatus", "fn": "if(l_suppkey % 2 = 0, concat('f', l_suppkey, '.pod5'), null)",
    "pi": "if(l_suppkey % 7 = 0, concat('p', l_suppkey), null)", "bi": "if(l_suppkey % 3 = 0, 'f,0.5,3,24,0.75,9,25,0.25', null)", "bv": "if(l_suppkey % 2 = 0, 'var1', null)", "NM": _NM, "AS": "l_partkey % 100",
}
_LEN = "(l_linenumber + 2 * CAST(l_quantity AS INT) + l_linenumber % 3 + 1 + 11)"
_SUMMARY = f"""x AS (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN concat('t', l_orderkey, ';c', l_linenumber) ELSE concat('r', l_orderkey) END AS qname, CAST(l_quantity AS INT) AS q,
  CASE WHEN l_linenumber > 1 THEN CASE WHEN l_returnflag = 'R' THEN 256 ELSE 2048 END WHEN l_partkey % 5 = 0 THEN 4 WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END AS flag, CAST(l_quantity * 100 AS INT) AS ns, nullif(l_discount, 0) AS du FROM lineitem)"""


@query("sequencing_summary", f"""WITH {_SUMMARY}, n AS (SELECT qname, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 256 <> 0) AS sec, count(*) FILTER (flag & 2048 <> 0) AS sup FROM x GROUP BY 1),
y AS (SELECT x.*, n.mapped, n.sec, n.sup, g.*, flag & 4 = 0 AS m, {_LEN} AS len, coalesce(ns / du, 0) AS rate, coalesce(n_nationkey * 1000 + 7, 0) / 1000.0 AS start, 2 * q + 9 AS al, l_linenumber % 3 + 1 AS ins, l_linenumber % 2 + 1 AS del, 2 * q + 9 - l_suppkey % 4 AS ok,
  CASE l_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unclassified' ELSE 'barcode' || lpad(CAST(l_partkey % 96 AS VARCHAR), 2, '0') END AS arr FROM x JOIN n USING (qname) LEFT JOIN nation g ON n_nationkey = l_suppkey % 30 WHERE flag & 2304 = 0)
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'f' || l_suppkey || '.pod5' ELSE 'unknown' END AS input_filename, 0 AS batch_id, CASE WHEN l_suppkey % 7 = 0 THEN 'p' || l_suppkey ELSE qname END AS parent_read_id, qname AS read_id, coalesce(n_name, '') AS run_id,
  CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 512 END AS channel, l_suppkey % 4 + 1 AS mux, 0 AS minknow_events, round(start, 9) AS start_time, round(coalesce(du, 0), 9) AS duration,
  coalesce(n_regionkey < 3, false) AS passes_filtering, round(CASE WHEN rate <> 0 THEN start + l_linenumber / rate ELSE 0 END, 9) AS template_start, CASE WHEN n_nationkey % 7 > 0 THEN (ns - l_linenumber) // (n_nationkey % 7) ELSE 0 END AS num_events_template,
  round(CASE WHEN rate <> 0 THEN (ns - l_linenumber) / rate ELSE 0 END, 9) AS template_duration, len AS sequence_length_template, round(l_tax, 9) AS mean_qscore_template,
  CASE WHEN l_partkey % 2 = 0 THEN q ELSE -2 END AS poly_tail_length, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber ELSE -1 END AS poly_tail_start, CASE WHEN l_partkey % 2 = 0 THEN q ELSE -1 END AS poly_tail_end, -1 AS poly_tail2_start, CASE WHEN l_partkey % 2 = 0 THEN 7 ELSE -1 END AS poly_tail2_end,
  'not_set' AS pore_type, CASE WHEN n_regionkey > 0 THEN n_name ELSE 'unknown' END AS experiment_id, coalesce('s' || n_regionkey, '') AS sample_id, l_linestatus AS end_reason,
  CASE WHEN l_partkey % 4 > 0 AND l_suppkey % 5 = 0 THEN 'alias' ELSE arr END AS alias, CASE WHEN l_partkey % 4 > 0 THEN 'test_sample' ELSE 'unknown' END AS type, arr AS barcode_arrangement, CASE WHEN l_partkey % 4 > 0 THEN 'KIT' ELSE 'unknown' END AS barcode_kit,
  CASE WHEN l_partkey % 4 = 0 THEN 'unknown' WHEN l_suppkey % 2 = 0 THEN 'var1' ELSE 'n/a' END AS barcode_variant,
  CASE WHEN b THEN 0.5 ELSE -1 END AS barcode_score, CASE WHEN b THEN 0.75 ELSE -1 END AS barcode_front_score, CASE WHEN b THEN 24 ELSE -1 END AS barcode_front_foundseq_length, CASE WHEN b THEN 3 ELSE -1 END AS barcode_front_begin_index,
  CASE WHEN b THEN 0.25 ELSE -1 END AS barcode_rear_score, CASE WHEN b THEN 25 ELSE -1 END AS barcode_rear_foundseq_length, CASE WHEN b THEN 9 ELSE -1 END AS barcode_rear_end_index,
  CASE WHEN m THEN l_returnflag ELSE '*' END AS alignment_genome, CASE WHEN NOT m THEN '*' WHEN flag = 16 THEN '-' ELSE '+' END AS alignment_direction, CASE WHEN m THEN l_partkey ELSE -1 END AS alignment_genome_start, CASE WHEN m THEN l_partkey + al + del ELSE -1 END AS alignment_genome_end,
  CASE WHEN m THEN l_linenumber ELSE -1 END AS alignment_strand_start, CASE WHEN m THEN len - 2 ELSE -1 END AS alignment_strand_end, CASE WHEN m THEN ins ELSE 0 END AS alignment_num_insertions, CASE WHEN m THEN del ELSE 0 END AS alignment_num_deletions,
  CASE WHEN m THEN al ELSE 0 END AS alignment_num_aligned, CASE WHEN m THEN ok ELSE 0 END AS alignment_num_correct, round(CASE WHEN m THEN ok / al::DOUBLE ELSE 0 END, 9) AS alignment_identity, round(CASE WHEN m THEN ok / (al + ins + del)::DOUBLE ELSE 0 END, 9) AS alignment_accuracy,
  CASE WHEN m THEN l_partkey % 100 ELSE 0 END AS alignment_score, round(CASE WHEN m THEN (len - 2 - l_linenumber) / len::DOUBLE ELSE 0 END, 9) AS alignment_coverage, 0 AS alignment_bed_hits, CASE WHEN m THEN l_suppkey % 61 ELSE 0 END AS alignment_mapping_quality,
  CASE WHEN m THEN mapped ELSE 0 END AS alignment_num_alignments, CASE WHEN m THEN sec ELSE 0 END AS alignment_num_secondary_alignments, CASE WHEN m THEN sup ELSE 0 END AS alignment_num_supplementary_alignments,
  CASE WHEN l_partkey % 11 = 0 THEN 't' || l_orderkey ELSE '-' END AS duplex_parent_template, CASE WHEN l_partkey % 11 = 0 THEN 'c' || l_linenumber ELSE '-' END AS duplex_parent_complement
FROM (SELECT *, l_partkey % 4 > 0 AND l_suppkey % 3 = 0 AS b FROM y)""")
def sequencing_summary(spark, d):
    """Lineitems as SAM records of an order's read, nations as read groups."""
    li = read(spark, d, "lineitem").select(
        F.expr("if(l_partkey % 11 = 0, concat('t', l_orderkey, ';c', l_linenumber), concat('r', l_orderkey))").alias("qname"),
        F.expr("CASE WHEN l_linenumber > 1 THEN if(l_returnflag = 'R', 256, 2048) WHEN l_partkey % 5 = 0 THEN 4 WHEN l_partkey % 2 = 0 THEN 16 ELSE 0 END").alias("flag"),
        F.col("l_returnflag").alias("rname"), (F.col("l_partkey") + 1).alias("pos"), (F.col("l_suppkey") % 61).alias("mapq"), F.expr(_CIGAR).alias("cigar"), F.expr(f"repeat('A', {_LEN})").alias("seq"),
        F.create_map(*[x for t, v in _TAGS.items() for x in (F.lit(t), F.expr(v).cast("string"))]).alias("tags"),
        F.expr("CASE l_partkey % 4 WHEN 0 THEN null WHEN 1 THEN 'unclassified' ELSE concat('BC', lpad(l_partkey % 96, 2, '0')) END").alias("barcode_name"), F.expr("if(l_suppkey % 5 = 0, 'alias', null)").alias("barcode_alias"), F.lit("test_sample").alias("barcode_type"), F.lit("KIT").alias("barcode_kit"))
    groups = read(spark, d, "nation").select(F.expr("concat('g', n_nationkey)").alias("rg_id"), F.col("n_name").alias("run_id"), F.expr("n_nationkey * 1000L + 7").alias("start_time_ms"), (F.col("n_regionkey") < 3).alias("is_pass"), (F.col("n_nationkey") % 7).alias("stride"), F.expr("if(n_regionkey > 0, n_name, '')").alias("experiment_id"), F.expr("concat('s', n_regionkey)").alias("sample_id"))
    out = reads.sequencing_summary(li, groups, joins.alignment_counts(li, "qname", "flag").withColumnRenamed("qname", "name"))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes])
