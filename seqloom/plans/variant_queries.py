"""Queries on consensus columns of contigs: joined samples, variants, reference rows.

Line items in order of their orders are the columns of contigs of a thousand orders. Those with line
number 6 or 7 are inserted columns; bases, calls and probabilities come from other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import variants as V
from seqloom.plans.registry import query
from seqloom.session import read

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]

_COLUMNS = f"""a AS (SELECT *, l_orderkey // 1000 AS contig, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY {', '.join(_ORDER)}) AS n FROM lineitem),
b AS (SELECT *, sum(CASE WHEN l_linenumber >= 6 AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY n) - 1 AS major FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY contig, major ORDER BY n) - 1 AS minor, (l_partkey * 7 + l_suppkey * 3) % 100 AS x1, (l_partkey * 3 + l_suppkey * 11) % 100 AS x2 FROM b),
d AS (SELECT *, CASE WHEN minor > 0 THEN '*' ELSE substr('AACAACGT', l_suppkey % 8 + 1, 1) END AS ref FROM c),
cols AS (SELECT contig, (n - 1) // CUT AS sample, major, minor, ref, CASE WHEN x1 < 4 THEN '*' WHEN x1 < 9 THEN substr('ACGT', x1 % 4 + 1, 1) ELSE ref END AS c1,
  CASE WHEN x2 < 3 THEN '*' WHEN x2 < 9 THEN substr('ACGT', x2 % 4 + 1, 1) ELSE ref END AS c2, ln(1 - l_tax::DOUBLE / 9) + ln(1 - l_discount::DOUBLE / 7) AS lp, ln(1 - l_discount::DOUBLE / 2) AS ref_lp FROM d)"""


def _columns(spark, d: str, cut: int) -> DataFrame:
    li = read(spark, d, "lineitem").select(*_ORDER, "l_tax", "l_discount", F.expr("l_orderkey div 1000").alias("contig"))
    order = Window.partitionBy("contig").orderBy(*_ORDER)
    rows = li.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("major", F.sum(F.expr("if(l_linenumber >= 6 AND n > 1, 0, 1)")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumns({"minor": F.row_number().over(Window.partitionBy("contig", "major").orderBy("n")) - 1, "x1": F.expr("(l_partkey * 7 + l_suppkey * 3) % 100"), "x2": F.expr("(l_partkey * 3 + l_suppkey * 11) % 100")})
    rows = rows.withColumn("ref", F.expr("if(minor > 0, '*', substring('AACAACGT', cast(l_suppkey % 8 + 1 as int), 1))"))
    call = lambda x, least: F.expr(f"CASE WHEN {x} < {least} THEN '*' WHEN {x} < 9 THEN substring('ACGT', cast({x} % 4 + 1 as int), 1) ELSE ref END")
    logp = F.expr("array(ln(1 - cast(l_tax as double) / 9), ln(1 - cast(l_discount as double) / 7))")
    return rows.select("contig", F.expr(f"(n - 1) div {cut}").alias("sample"), "major", "minor", "ref", F.array(call("x1", 4), call("x2", 3)).alias("calls"), logp.alias("logp"), F.expr("ln(1 - cast(l_discount as double) / 2)").alias("ref_logp"))


_MARKED = """, i0 AS (SELECT *, row_number() OVER (PARTITION BY contig, sample ORDER BY major, minor) - 1 AS i, c1 <> ref OR c2 <> ref AS own FROM {0}),
{1} AS (SELECT *, CASE WHEN minor = 0 OR i = 0 THEN own ELSE bool_or(own) OVER (PARTITION BY contig, sample, major) END AS v FROM i0)"""

#: Samples joined one after another: what is left of a sample's split belongs to the one that is open.
_JOINED = _MARKED.format("cols", "m") + """,
s AS (SELECT contig, sample, min(row(major, minor)) AS a, max(row(major, minor)) AS z, max(row(major, minor)) FILTER (minor = 0 AND NOT v AND i > 0) AS split FROM m GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER w AS r, lag(z) OVER w AS before FROM s WINDOW w AS (PARTITION BY contig ORDER BY a)),
open AS (SELECT contig, sample, r, split, a AS left_of, coalesce(split, a) AS now FROM t WHERE r = 1
  UNION ALL SELECT t.contig, t.sample, t.r, t.split, l, coalesce(t.split, l) FROM (SELECT t.*, o.now, CASE WHEN t.a[1] = t.before[1] + 1 OR (t.a[1] = t.before[1] AND t.a[2] = t.before[2] + 1) THEN o.now ELSE t.a END AS l FROM t JOIN open o ON t.contig = o.contig AND t.r = o.r + 1) t),
j AS (SELECT m.contig, major, minor, ref, c1, c2, lp, ref_lp, CASE WHEN split IS NOT NULL AND row(major, minor) >= split THEN split ELSE left_of END AS sample FROM m JOIN open USING (contig, sample))"""

#: Runs of variant columns, with the bases before each up to the last variant or break.
_ISLANDS = _MARKED.replace("i0", "i1").format("j", "k") + """,
u AS (SELECT *, bool_or(minor = 0) OVER w AS grounded, sum(CASE WHEN v THEN 0 ELSE 1 END) OVER w AS g, coalesce(sum(lp) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM k WINDOW w AS (PARTITION BY contig, sample ORDER BY i)),
isl AS (SELECT contig, sample, g, min(i) AS rs, max(i) + 1 AS re, min(major) AS m0, arg_min(minor, i) AS n0, replace(string_agg(ref, '' ORDER BY i), '*', '') AS r, replace(string_agg(c1, '' ORDER BY i), '*', '') AS x, replace(string_agg(c2, '' ORDER BY i), '*', '') AS y, min(cum) FILTER (i = i) AS c0, arg_min(cum, i) AS cum0, arg_max(cum + lp, i) AS cum1
  FROM u WHERE v AND grounded GROUP BY 1, 2, 3)"""


def _variants(df: DataFrame) -> DataFrame:
    return df.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "gt", "gq", "qual", "filter")


@query("join_samples", f"WITH RECURSIVE {_COLUMNS.replace('CUT', '37')}{_JOINED} SELECT contig, major, minor, ref, sample[1] AS sample_major, sample[2] AS sample_minor FROM j")
def join_samples(spark, d):
    out = V.join_samples(_columns(spark, d, 37), ["contig"], 4096)
    return out.select("contig", "major", "minor", "ref", F.col("sample.major").alias("sample_major"), F.col("sample.minor").alias("sample_minor"))


_RAW = """, based AS (SELECT i.*, CASE WHEN n0 <> 0 THEN (SELECT b.ref FROM k b WHERE b.contig = i.contig AND b.sample = i.sample AND b.major = i.m0 AND b.minor = 0) ELSE '' END AS base FROM isl i WHERE NOT (r = x AND r = y)),
ends AS (SELECT *, base || r AS p, base || x AS q, base || y AS z, CASE WHEN n0 <> 0 THEN (SELECT b.cum FROM u b WHERE b.contig = i.contig AND b.sample = i.sample AND b.major = i.m0 AND b.minor = 0) ELSE cum0 END AS since FROM based i),
out AS (SELECT contig, m0 AS pos, p AS ref, [q, z] AS calls, round(greatest(0, least(70, CASE WHEN 1 - exp(cum1 - since) <= 0 THEN 70 ELSE -10 * log10(1 - exp(cum1 - since)) END)), 3) AS qual FROM ends WHERE p <> '')"""
_WRITTEN = """SELECT contig, pos, ref, CASE WHEN list_contains(calls, '') THEN '.' ELSE array_to_string(alts, ',') END AS alts,
  CASE WHEN list_contains(calls, '') THEN '0' ELSE array_to_string(list_sort([coalesce(list_position(alts, calls[1]), 0), coalesce(list_position(alts, calls[2]), 0)]), '/') END AS gt,
  CAST(round(qual) AS INT) AS gq, qual, CASE WHEN list_contains(calls, '') THEN '.' WHEN qual >= 3 THEN 'PASS' ELSE 'LowQual' END AS filter
FROM (SELECT *, list_sort(list_distinct(list_filter(calls, lambda a: a <> ref))) AS alts FROM out)"""


@query("plain_variants", f"WITH RECURSIVE {_COLUMNS.replace('CUT', '37')}{_JOINED}{_ISLANDS}{_RAW} {_WRITTEN}")
def plain_variants(spark, d):
    """Variants of joined samples as they stand; where samples were cut doesn't show."""
    return _variants(V.call_variants(V.join_samples(_columns(spark, d, 37), ["contig"], 4096), ["contig"], normalize=False))


#: Normal form one base at a time: p, q, z are the alleles, `left_` the bases that may still be put in front.
def _steps(source: str, name: str) -> str:
    return f""", {name}_w AS (SELECT id, n, p, q, z, left_, least(length(p), length(q), length(z)) AS short FROM {source} WHERE false),
{name}_s AS (SELECT id, 0 AS n, p, q, z, left_, 0 AS moved, false AS done FROM {source}
  UNION ALL SELECT id, n + 1,
    CASE trim WHEN 1 THEN lead || p[:-2] WHEN 0 THEN lead || p ELSE p END, CASE trim WHEN 1 THEN lead || q[:-2] WHEN 0 THEN lead || q ELSE q END, CASE trim WHEN 1 THEN lead || z[:-2] WHEN 0 THEN lead || z ELSE z END,
    CASE WHEN trim >= 0 AND lead <> '' THEN left_[:-2] ELSE left_ END, moved + CASE WHEN trim >= 0 AND lead <> '' THEN 1 ELSE 0 END, trim < 0
  FROM (SELECT *, CASE WHEN short = 0 AND left_ <> '' THEN 0 WHEN short > 1 AND same THEN 1 WHEN short = 1 AND same AND left_ <> '' THEN 1 ELSE -1 END AS trim, CASE WHEN short < 2 AND left_ <> '' AND (short = 0 OR same) THEN left_[-1:] ELSE '' END AS lead
    FROM (SELECT *, least(length(p), length(q), length(z)) AS short, right(p, 1) = right(q, 1) AND right(p, 1) = right(z, 1) AS same FROM {name}_s WHERE NOT done)))"""


_NORMAL = """, gaps AS (SELECT contig, sample, g, rs, (SELECT max(b.i) FROM u b WHERE b.contig = i.contig AND b.sample = i.sample AND b.i < i.rs AND b.v) AS stop FROM isl i),
near AS (SELECT i.*, coalesce(stop, -1) AS stop, row_number() OVER (ORDER BY i.contig, i.sample, i.rs) AS id FROM isl i JOIN gaps USING (contig, sample, g, rs) WHERE NOT (r = x AND r = y)),
before AS (SELECT id, string_agg(b.ref, '' ORDER BY b.i) AS left_ FROM near n JOIN u b ON b.contig = n.contig AND b.sample = n.sample AND b.i > n.stop AND b.i < n.rs AND b.minor = 0 AND b.grounded GROUP BY id),
start AS (SELECT n.*, coalesce(left_, '') AS left_, m0 + CASE WHEN n0 <> 0 THEN 1 ELSE 0 END AS base_at, r AS p, x AS q, y AS z FROM near n LEFT JOIN before USING (id))"""

_FORM = """, ended AS (SELECT id, p, q, z, moved FROM st_s WHERE done),
forced AS (SELECT s.*, e.p AS ep, e.q AS eq, e.z AS ez, CASE WHEN s.n0 <> 0 AND e.moved = 0 THEN 1 ELSE 0 END AS more, e.moved FROM start s JOIN ended e USING (id)),
grown AS (SELECT *, CASE WHEN more = 1 THEN left_[-1:] ELSE '' END || ep AS a, CASE WHEN more = 1 THEN left_[-1:] ELSE '' END || eq AS b, CASE WHEN more = 1 THEN left_[-1:] ELSE '' END || ez AS c, moved + more AS ext FROM forced),
after AS (SELECT gr.*, (SELECT arg_min(CASE WHEN NOT k.v AND k.major = gr.base_at - gr.ext + length(a) THEN k.ref ELSE '' END, k.i) FROM u k WHERE k.contig = gr.contig AND k.sample = gr.sample AND k.i >= gr.re AND k.minor = 0) AS nxt FROM grown gr),
taken AS (SELECT *, CASE WHEN least(length(a), length(b), length(c)) = 0 THEN coalesce(nxt, '') ELSE '' END AS tail FROM after),
full_ AS (SELECT *, a || tail AS fa, b || tail AS fb, c || tail AS fc FROM taken),
common AS (SELECT *, coalesce((SELECT min(n) FROM range(1, 4000) AS t(n) WHERE n >= least(length(fa), length(fb), length(fc)) OR fa[n:n] <> fb[n:n] OR fa[n:n] <> fc[n:n]), 1) - 1 AS cutoff FROM full_),
out AS (SELECT o.contig, o.base_at - ext + cutoff AS pos, fa[cutoff + 1:] AS ref, [fb[cutoff + 1:], fc[cutoff + 1:]] AS calls,
    round(greatest(0, least(70, CASE WHEN 1 - exp(lps) <= 0 THEN 70 ELSE -10 * log10(1 - exp(lps)) END)), 3) AS qual
  FROM (SELECT o.*, cum1 + CASE WHEN tail <> '' THEN (SELECT arg_min(k.cum + k.lp, k.i) FROM u k WHERE k.contig = o.contig AND k.sample = o.sample AND k.i >= o.re AND k.minor = 0) - cum1 ELSE 0 END
    - CASE WHEN ext > 0 THEN (SELECT k.cum FROM u k WHERE k.contig = o.contig AND k.sample = o.sample AND k.minor = 0 AND k.major = o.base_at - ext) ELSE cum0 END AS lps FROM common o) o WHERE fa[cutoff + 1:] <> '')"""


@query("normal_variants", f"WITH RECURSIVE {_COLUMNS.replace('CUT', '53')}{_JOINED}{_ISLANDS}{_NORMAL}{_steps('start', 'st')}{_FORM} {_WRITTEN}")
def normal_variants(spark, d):
    """The same in normal form, samples cut at other columns."""
    return _variants(V.call_variants(V.join_samples(_columns(spark, d, 53), ["contig"], 4096), ["contig"]))


@query("gvcf_rows", f"""WITH {_COLUMNS.replace('CUT', '37')}, p AS (SELECT contig, major, ref, ref_lp FROM cols WHERE minor = 0)
SELECT contig, major AS pos, ref, '.' AS alts, '0' AS gt, CAST(round(round(least(70, CASE WHEN 1 - exp(ref_lp) <= 0 THEN 70 ELSE -10 * log10(1 - exp(ref_lp)) END), 3)) AS INT) AS gq, round(least(70, CASE WHEN 1 - exp(ref_lp) <= 0 THEN 70 ELSE -10 * log10(1 - exp(ref_lp)) END), 3) AS qual, '.' AS filter FROM p""")
def gvcf_rows(spark, d):
    """A reference row for each position."""
    return _variants(V.reference_rows(_columns(spark, d, 37), ["contig"]))


@query("gvcf_tiles", f"WITH RECURSIVE {_COLUMNS.replace('CUT', '37')} SELECT contig, max(major) + 1 AS covered, max(major) + 1 AS positions, 0 AS first_pos, max(major) AS last_pos FROM cols GROUP BY contig")
def gvcf_tiles(spark, d):
    """Merged variants and the reference rows between them: each position of a contig once."""
    cols = V.join_samples(_columns(spark, d, 37), ["contig"], 4096)
    found = V.call_variants(cols, ["contig"], merge_overlapping=True, merge_adjacent=True)
    spans = found.select("contig", "pos", F.length("ref").alias("n")).unionByName(V.reference_rows(cols, ["contig"], found).select("contig", "pos", F.lit(1).alias("n")))
    places = spans.select("contig", F.explode(F.expr("sequence(pos, pos + n - 1)")).alias("pos"))
    return places.groupBy("contig").agg(F.count("*").alias("covered"), F.count_distinct("pos").alias("positions"), F.min("pos").cast("int").alias("first_pos"), F.max("pos").alias("last_pos"))


#: Samples of 50 columns every 37; in each seventh the inserted columns were not made.
_SAMPLES = _COLUMNS.replace("CUT", "37") + """, w AS (SELECT DISTINCT contig, (n - 1) // 37 - o AS sample, major, minor FROM d, range(0, 2) AS t(o) WHERE n - 1 < ((n - 1) // 37 - o) * 37 + 50 AND (n - 1) // 37 >= o),
pos AS (SELECT *, row_number() OVER (PARTITION BY contig, sample ORDER BY major, minor) - 1 AS i FROM w WHERE minor = 0 OR sample % 7 <> 3)"""


def _samples(spark, d):
    rows = _columns(spark, d, 37).select("contig", F.col("sample").alias("at"), "major", "minor")
    place = F.row_number().over(Window.partitionBy("contig").orderBy("major", "minor")) - 1
    rows = rows.withColumn("i", place).withColumn("sample", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - 1), F.col("at"))))
    return rows.where("i < sample * 37 + 50 AND (minor = 0 OR sample % 7 <> 3)").select("contig", "sample", "major", "minor")


_TRIM = """, e AS (SELECT contig, sample, min(row(major, minor)) AS f, max(row(major, minor)) AS l, count(*) AS n FROM pos GROUP BY 1, 2),
r AS (SELECT *, max(l) OVER (PARTITION BY contig ORDER BY f, -n, sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
k AS (SELECT *, lag(sample) OVER v AS ps, lag(l) OVER v AS pl FROM r WHERE reach IS NULL OR l > reach WINDOW v AS (PARTITION BY contig ORDER BY f, -n, sample)),
g AS (SELECT *, CASE WHEN ps IS NULL THEN 'first' WHEN (f[1] = pl[1] + 1 AND f[2] = 0) OR (f[1] = pl[1] AND f[2] = pl[2] + 1) THEN 'abut' WHEN f <= pl THEN 'overlap' ELSE 'gap' END AS relation FROM k),
x AS (SELECT g.contig, g.ps, g.sample, string_agg(p.minor, ',' ORDER BY p.i) AS m, min(p.i) AS i0, count(*) AS n, count(DISTINCT major) AS mj, min(major) AS lo, max(major) AS hi FROM g JOIN pos p ON p.contig = g.contig AND p.sample = g.ps AND p.i >= (SELECT max(q.i) FROM pos q WHERE q.contig = g.contig AND q.sample = g.ps AND row(q.major, q.minor) <= g.f) WHERE relation = 'overlap' GROUP BY 1, 2, 3),
y AS (SELECT g.contig, g.ps, g.sample, string_agg(p.minor, ',' ORDER BY p.i) AS m, count(*) AS n, count(DISTINCT major) AS mj FROM g JOIN pos p ON p.contig = g.contig AND p.sample = g.sample AND p.i <= coalesce((SELECT min(q.i) FROM pos q WHERE q.contig = g.contig AND q.sample = g.sample AND row(q.major, q.minor) >= g.pl), 1000000) WHERE relation = 'overlap' GROUP BY 1, 2, 3),
cc AS (SELECT x.contig, x.ps, x.sample, x.m <> y.m AS differing, CASE WHEN x.m = y.m THEN i0 + x.n // 2 END AS ea, CASE WHEN x.m = y.m THEN y.n // 2 END AS sb, x.mj > 3 AND y.mj > 3 AS wide, lo + (hi - lo) // 2 AS mid FROM x JOIN y USING (contig, ps, sample))"""


@query("trim_samples", f"""WITH {_SAMPLES}{_TRIM}
SELECT g.contig, g.sample, relation, coalesce(b.sb, 0)::BIGINT AS start, coalesce(a.ea, n)::BIGINT AS "end", coalesce(b.differing, false) AS differing FROM g LEFT JOIN cc b ON b.contig = g.contig AND b.sample = g.sample LEFT JOIN cc a ON a.contig = g.contig AND a.ps = g.sample
UNION ALL SELECT contig, sample, 'within', NULL, NULL, false FROM r WHERE l <= reach""")
def trim_samples(spark, d):
    return V.trim_samples(_samples(spark, d), ["contig"], width=4096)


@query("trim_samples_shared", f"""WITH {_SAMPLES}{_TRIM},
st AS (SELECT contig, sample, major, count(*) AS n, min(i) AS i FROM pos GROUP BY 1, 2, 3),
z AS (SELECT c.contig, c.ps, c.sample, arg_min(a.i, row(abs(a.major - mid), -a.major)) AS za, arg_min(b.i, row(abs(a.major - mid), -a.major)) AS zb FROM cc c JOIN st a ON a.contig = c.contig AND a.sample = c.ps JOIN st b ON b.contig = c.contig AND b.sample = c.sample AND b.major = a.major AND b.n = a.n WHERE differing AND wide AND a.major <> mid GROUP BY 1, 2, 3),
c2 AS (SELECT c.contig, c.ps, c.sample, coalesce(ea, za) AS ea, coalesce(sb, zb) AS sb FROM cc c LEFT JOIN z USING (contig, ps, sample)),
f AS (SELECT g.contig, g.sample, coalesce(b.sb, 0) AS s, coalesce(a.ea, n) AS e FROM g LEFT JOIN c2 b ON b.contig = g.contig AND b.sample = g.sample LEFT JOIN c2 a ON a.contig = g.contig AND a.ps = g.sample),
h AS (SELECT f.contig, f.sample, greatest(s, count(*) FILTER (major < 100)) AS s, least(e, count(*) FILTER (major < 900)) AS e FROM f JOIN pos USING (contig, sample) GROUP BY f.contig, f.sample, s, e)
SELECT contig, sample, CASE WHEN s < e THEN s END AS start, CASE WHEN s < e THEN e END AS "end" FROM h UNION ALL SELECT contig, sample, NULL, NULL FROM r WHERE l <= reach""")
def trim_samples_shared(spark, d):
    """The same with cuts sought where columns differ, within majors 100 to 900."""
    return V.trim_samples(_samples(spark, d), ["contig"], (100, 900), True, 4096).select("contig", "sample", "start", "end")
