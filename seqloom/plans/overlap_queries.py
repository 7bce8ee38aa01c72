"""Queries on candidate overlaps; documents spelled in four letters stand in for reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import overlaps
from seqloom.plans.registry import query
from seqloom.session import read

# letters to bases, spaces and stops away, every other document turned round
_FROM, _TO = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,", "ACGTTGCAACGTTGCAACGTTGCAACACGTTGCAACGTTGCAACGTTGCAAC"
_READS = f"""r AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(dna, 'ACGTacgt', 'TGCAtgca')) ELSE dna END AS seq FROM (SELECT doc_id, translate(text, '{_FROM}', '{_TO}') AS dna FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))"""


def _seeds(name: str) -> str:
    """Minimizers of name(id, seq) for k = 24, w = 17: k-mer values by doubled lengths, least of each window."""
    strands = []
    for way, code, lead in (("f", "strpos('ACGT', c) - 1", "lead"), ("b", "4 - strpos('ACGT', c)", "lag")):
        over = "OVER (PARTITION BY id ORDER BY p)"
        steps = [f"{way}0 AS (SELECT id, p, CASE WHEN c IN ('A', 'C', 'G', 'T') THEN CAST({code} AS UBIGINT) END AS v FROM c)"]
        for i, size in enumerate((1, 2, 4, 8)):
            near, far = ("v", f"{lead}(v, {size}) {over}") if way == "f" else (f"lead(v, {size}) {over}", "v")
            steps.append(f"{way}{i + 1} AS (SELECT id, p, {near} * {4 ** size}::UBIGINT + {far} AS v FROM {way}{i})")
        strands += steps
    # 24 letters are 16 and 8
    strands.append("f AS (SELECT x.id, x.p, x.v * 65536::UBIGINT + y.v AS v FROM f4 x JOIN f3 y ON y.id = x.id AND y.p = x.p + 16)")
    strands.append("b AS (SELECT x.id, x.p, y.v * 4294967296::UBIGINT + x.v AS v FROM b4 x JOIN b3 y ON y.id = x.id AND y.p = x.p + 16)")
    mix = f"{overlaps.MIX}::UHUGEINT"
    whole = "18446744073709551616::UHUGEINT"
    return ",\n".join([
        f"c AS (SELECT id, p, substr(seq, p, 1) AS c FROM (SELECT id, upper(seq) AS seq, unnest(range(1, length(seq) + 1)) AS p FROM {name}))",
        *strands,
        f"""h AS (SELECT id, p, n, CASE WHEN f.v <> b.v THEN least(f.v::UHUGEINT * {mix} % {whole}, b.v::UHUGEINT * {mix} % {whole}) END AS h, b.v::UHUGEINT * {mix} % {whole} < f.v::UHUGEINT * {mix} % {whole} AS reverse
  FROM f JOIN b USING (id, p) JOIN (SELECT id, length(seq) - 23 AS n FROM {name}) USING (id) WHERE p <= n)""",
        "l AS (SELECT id, p, n, min(h * 4294967296::UHUGEINT + p::UHUGEINT) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND 16 FOLLOWING) AS least FROM h)",
        "m AS (SELECT DISTINCT id, CAST(least % 4294967296::UHUGEINT AS BIGINT) AS p FROM l WHERE p <= greatest(1, n - 16) AND least IS NOT NULL)",
        "s AS (SELECT id, p - 1 AS pos, CAST(h.h AS HUGEINT) AS h, reverse FROM m JOIN h USING (id, p))",
    ])


_K, _W = 24, 17


def _reads(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", overlaps.spelled(_FROM, _TO)("text", F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))).alias("seq"))


@query("minimizers", f"""WITH {_READS},
{_seeds('r')}
SELECT id AS doc_id, pos, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash, reverse FROM s""")
def minimizers(spark, d):
    return overlaps.minimizers(_reads(spark, d), "doc_id", "seq", _K, _W)


# a chain's state is a list of its last 64 anchors; each step of the recursion takes one anchor of every pair
@query("overlap_chains", f"""WITH RECURSIVE {_READS},
k AS (SELECT seq, min(id) AS id FROM r GROUP BY seq),
{_seeds('k')},
n AS (SELECT h, count(*) AS n FROM s GROUP BY h),
t AS (SELECT greatest(10, min(m)) AS most FROM (SELECT least(n, 1000) AS m FROM n QUALIFY row_number() OVER (ORDER BY n DESC) = 1 + CAST(floor(count(*) OVER () * 0.0002) AS BIGINT))),
g AS (SELECT s.* FROM s JOIN n USING (h), t WHERE n.n BETWEEN 2 AND most),
a AS (SELECT x.id AS a, y.id AS b, x.reverse <> y.reverse AS rev, x.pos AS x, CASE WHEN x.reverse <> y.reverse THEN -y.pos ELSE y.pos END AS y FROM g x JOIN g y USING (h) WHERE x.id < y.id),
o AS (SELECT *, row_number() OVER (PARTITION BY a, b, rev ORDER BY x, y) AS i FROM a QUALIFY count(*) OVER (PARTITION BY a, b, rev) >= 5),
w AS (SELECT a, b, rev, i, x, y, [{{'s': 24, 'n': 1, 'sx': x, 'sy': y, 'x': x, 'y': y, 'i': i}}] AS l FROM o WHERE i = 1
  UNION ALL SELECT a, b, rev, i, x, y, list_append(l[-63:], CASE WHEN best.g > 24 THEN {{'s': best.g, 'n': best.n + 1, 'sx': best.sx, 'sy': best.sy, 'x': x, 'y': y, 'i': i}} ELSE {{'s': 24, 'n': 1, 'sx': x, 'sy': y, 'x': x, 'y': y, 'i': i}} END)
  FROM (SELECT o.a, o.b, o.rev, o.i, o.x, o.y, w.l, list_max(list_transform(w.l, lambda e: CASE WHEN o.x > e.x AND o.y > e.y AND o.x - e.x <= 5000 AND o.y - e.y <= 5000 AND abs((o.x - e.x) - (o.y - e.y)) <= 150
    THEN {{'g': e.s + least(24, o.x - e.x, o.y - e.y) - abs((o.x - e.x) - (o.y - e.y)) * 24 // 100 - CASE WHEN (o.x - e.x) = (o.y - e.y) THEN 0 ELSE length(ltrim(bin(abs((o.x - e.x) - (o.y - e.y))), '0')) // 2 END, 'i': e.i, 'n': e.n, 'sx': e.sx, 'sy': e.sy}}
    ELSE {{'g': -1::BIGINT, 'i': e.i, 'n': e.n, 'sx': e.sx, 'sy': e.sy}} END)) AS best
    FROM w JOIN o ON o.a = w.a AND o.b = w.b AND o.rev = w.rev AND o.i = w.i + 1)),
z AS (SELECT a, b, rev, l[-1] AS z FROM w QUALIFY row_number() OVER (PARTITION BY a, b, rev ORDER BY l[-1].s DESC, i) = 1)
SELECT a, b, rev AS reverse, z.s AS score, z.n AS anchors, z.sx AS a_start, z.x + 24 AS a_end, CASE WHEN rev THEN -z.y ELSE z.sy END AS b_start, CASE WHEN rev THEN -z.sy ELSE z.y END + 24 AS b_end FROM z WHERE z.s >= 100
UNION ALL SELECT DISTINCT k.id, r.id, false, NULL, NULL, NULL, NULL, NULL, NULL FROM r JOIN k USING (seq) WHERE r.id <> k.id""")
def overlap_chains(spark, d):
    return overlaps.overlaps(_reads(spark, d), "doc_id", "seq", _K, _W, 0.0002, 100)
