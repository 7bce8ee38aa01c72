"""URL filters whose decisions pass to aliases, with built-in functions only.

Rules judge a URL by host and path. URLs that redirect to one another, name one
another as canonical or are spellings of one address form a component of the
link graph; a block reaches all of it, unless a rule allows a URL in it
explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Link targets in html: canonical links, refresh redirects and script redirects.
TARGETS = (
    r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']?([^"'>\s]+)""",
    r"""(?i)<link\b[^>]*\bhref\s*=\s*["']?([^"'>\s]+)["']?[^>]*\brel\s*=\s*["']?canonical\b""",
    r"""(?i)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*["']?([^"'>\s]+)""",
    r"""(?i)\blocation(?:\.href)?\s*=\s*["']([^"'\s]+)["']""",
)
SEPARATE = "(?s)://([^/?#]*)([^?#]*)"


def host(url: str) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lowered; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), SEPARATE, 1), UPPER, LOWER)


def path(url: str) -> Column:
    """From the host to ? or # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), SEPARATE, 2)


def matching_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits columns host and path.

    Rules are configuration, so they become one expression and no join.
    """
    text, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        text, verdict = text.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return text, verdict


def canonical(url: str) -> Column:
    """One spelling for URLs that servers commonly redirect to each other.

    Without scheme, leading www. m. or amp., index page, .html, final slash,
    fragment and tracking parameters; other parameters sorted. Null without ://.
    """
    name = F.regexp_replace(host(url), r"^(www|m|amp)\.", "")
    place = F.regexp_replace(path(url), r"(/index)?([.]html?)?/?$", "")
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_|ref=|fbclid=|gclid=)"))), "&")
    return F.when(F.col(url).contains("://"), F.concat(name, place, F.lit("?"), kept))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): canonical forms of a page and of a redirect or canonical target in its html.

    Targets are absolute, or relative to the scheme (//), the host (/), the
    page (?) or its folder. Those of another kind (mailto:, #) and those that
    climb folders (..) are ignored. pages may lack the column html.
    """
    if "html" not in pages.columns:
        pages = pages.withColumn("html", F.lit(None).cast("string"))
    html = F.coalesce(F.col("html"), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(html, F.lit(t), F.lit(1)) for t in TARGETS])
    out = pages.where("html IS NOT NULL AND url LIKE '%://%'").select("url", F.explode(found).alias("to")).withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract("url", "^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host("url"))
    to = F.col("to")
    absolute = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path("url"), to))
        .when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#|[.][.]/"), F.concat(site, F.regexp_replace(path("url"), "[^/]*$", ""), F.when(path("url") == "", F.lit("/")).otherwise(F.lit("")), to))
    )
    return out.withColumn("to", absolute).select(canonical("url").alias("a"), canonical("to").alias("b")).where("b IS NOT NULL AND a <> b")


def spelling_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each distinct URL, marked u:, and its canonical form, marked c: so that it is the least."""
    return pages.where("url LIKE '%://%'").select(F.concat(F.lit("u:"), "url").alias("a"), F.concat(F.lit("c:"), canonical("url")).alias("b"))


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of pages(page_id, url, html).

    verdict is the rule's. Without a rule: allow if a URL of the component is
    allowed by a rule, else block if one is blocked, else allow. `edges` (a, b)
    adds known redirects between canonical forms. component: the least canonical
    form in it. A URL that is null or has no :// has empty host and path, no
    component and the verdict allow.
    """
    marked = pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path"), F.when(F.col("url").contains("://"), F.concat(F.lit("u:"), "url")).alias("node"))
    text, verdict = matching_rule(rules)
    marked = marked.withColumns({"rule": text, "own": verdict}).drop("url")
    links = link_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    links = links.select(F.concat(F.lit("c:"), "a").alias("a"), F.concat(F.lit("c:"), "b").alias("b")).unionByName(spelling_edges(pages))
    groups = components(links).withColumnRenamed("node", "_node")
    marked = marked.join(groups, F.col("node") == F.col("_node"), "left").withColumn("component", F.expr("substring(component, 3)")).drop("_node", "node")
    # one row for each component with a rule, after partial aggregation
    known = marked.where("own IS NOT NULL AND component IS NOT NULL").groupBy(F.col("component").alias("_c")).agg(F.bool_or(F.col("own") == "allow").alias("allowed"))
    out = marked.join(known, F.col("component") == F.col("_c"), "left")
    inherited = F.when(F.col("allowed"), F.lit("allow")).when(~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", inherited).alias("verdict"), "component")


def op8_url_filter(spark, sf_dir) -> DataFrame:
    """The contract's query over all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


_CANON = """
  CASE WHEN contains({u}, '://') THEN
    regexp_replace(translate(regexp_extract({u}, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m|amp)\\.', '')
    || regexp_replace(regexp_extract({u}, '(?s)://([^/?#]*)([^?#]*)', 2), '(/index)?([.]html?)?/?$', '')
    || '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
       lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=|fbclid=|gclid=)'))), '&')
  END"""


def _sql() -> str:
    quoted = ", ".join("regexp_extract_all(html, '" + t.replace("'", "''") + "', 1)" for t in TARGETS)
    rules = ", ".join(f"('{k}', '{h}', '{p}', {len(h + p)})" for k, h, p in RULES)
    return f"""
WITH RECURSIVE rules(kind, h, p, size) AS (VALUES {rules}),
pg AS (
  SELECT page_id, url, html, {_CANON.format(u="url")} AS node,
    translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
hit AS (
  SELECT pg.page_id, arg_max(r.h || r.p, r.size) AS rule, arg_max(r.kind, r.size) AS own
  FROM pg JOIN rules r ON (pg.host = r.h OR ends_with(pg.host, '.' || r.h)) AND starts_with(pg.path, r.p)
  GROUP BY pg.page_id),
targets AS (
  SELECT url, node, host, path, replace(unnest(list_concat({quoted})), '&amp;', '&') AS t FROM pg WHERE html IS NOT NULL AND node IS NOT NULL),
resolved AS (
  SELECT node AS a, CASE WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?)://', 1) || '://' || host || t
    WHEN starts_with(t, '?') THEN regexp_extract(url, '^(.*?)://', 1) || '://' || host || path || t
    WHEN NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|[.][.]/') THEN regexp_extract(url, '^(.*?)://', 1) || '://' || host || regexp_replace(path, '[^/]*$', '') || CASE WHEN path = '' THEN '/' ELSE '' END || t END AS u FROM targets),
one_way AS (SELECT DISTINCT a, {_CANON.format(u="u")} AS b FROM resolved WHERE u IS NOT NULL),
edges AS (SELECT a, b FROM one_way WHERE a <> b UNION SELECT b, a FROM one_way WHERE a <> b),
reach(n, m) AS (
  SELECT a, a FROM edges UNION SELECT r.n, e.b FROM reach r JOIN edges e ON e.a = r.m),
comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
marked AS (
  SELECT pg.page_id, host, path, rule, own, coalesce(c, node) AS component
  FROM pg LEFT JOIN hit USING (page_id) LEFT JOIN comp ON n = node),
known AS (SELECT component, bool_or(own = 'allow') AS allowed FROM marked WHERE own IS NOT NULL AND component IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allowed = false THEN 'block' ELSE 'allow' END) AS verdict, component
FROM marked LEFT JOIN known USING (component)"""


SQL = _sql()
