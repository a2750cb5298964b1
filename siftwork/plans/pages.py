"""Pages by the selectors of their outlets."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import urls
from siftwork.operators import resolution
from siftwork.plans.texts import _HOST, PUBLISHERS
from siftwork.sources import extraction
from siftwork.sources.tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Outlets of the given pages: domain, title, body and date selectors.
OUTLETS = [
    ("example.com", ["article > h1", "h1"], ["#main p", "div.ad", "article"], ["time[datetime]", ".date"]),
    ("spam-farm.example.org", ["h1.title"], ["div.ad ~ article", "article p"], [".date"]),
    ("example.net", ["h1"], ["div[class*='ad']", "body > article"], ["time"]),
    ("example.org", ["article h1:first-child"], ["article"], ["time"]),
]


def outlets(spark):
    rows = [(i, *o) for i, o in enumerate(OUTLETS)]
    return spark.createDataFrame(rows, "place int, domain string, title_selectors array<string>, body_selectors array<string>, date_selectors array<string>")


def _articles(spark, d):
    return extraction.articles(spread(table(spark, d, "pages")), outlets(spark))


@query()
def ht_extract(spark, d):
    out = _articles(spark, d)
    return out.select("page_id", "outlet", "title", F.length("body").alias("body_chars"), "extraction_method", F.col("published.local_date").alias("published"), F.col("date_source").alias("date_method"))


_TEXT = r"regexp_replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '.'), '&amp;', '&'), '^\s+|\s+$', '', 'g')"
_ARTICLE = r"regexp_extract(html, '(?s)<article\b[^>]*>(.*?)</article>', 1)"
_PARTS = f"list_filter(list_transform(list_transform(string_split_regex({_ARTICLE}, '<p>')[2:], lambda x: regexp_replace(regexp_replace(x, '(?s)</p>.*', ''), '<[^>]*>', '', 'g')), lambda x: {_TEXT.format(x='x')}), lambda x: length(x) > 10)"
_AD = r"regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"
_TRIES = " UNION ALL ".join(f"SELECT '{d}' AS outlet, {i} AS place, '{s}' AS selector, {k} AS step" for i, (d, s, k) in enumerate([("example.com", "#main p", 0), ("example.com", "div.ad", 1), ("example.com", "article", 2), ("spam-farm.example.org", "div.ad ~ article", 2), ("spam-farm.example.org", "article p", 2), ("example.net", "div[class*=''ad'']", 1), ("example.net", "body > article", 2), ("example.org", "article", 2)]))


@query(rf"""WITH p AS (SELECT page_id, {_HOST} AS h, {_TEXT.format(x=_AD)} AS ad, array_to_string({_PARTS}, chr(10)) AS body FROM pages),
  o AS (SELECT page_id, CASE {" ".join(f"WHEN h = '{d}' OR ends_with(h, '.{d}') THEN '{d}'" for d, *_ in OUTLETS)} END AS outlet, ad, body FROM p),
  t AS (SELECT o.outlet, page_id, place, selector, CASE step WHEN 0 THEN NULL WHEN 1 THEN ad ELSE body END AS found FROM o JOIN ({_TRIES}) s ON o.outlet = s.outlet),
  r AS (SELECT *, CASE WHEN found IS NULL THEN 'none' WHEN length(found) >= 100 THEN 'hit' ELSE 'short' END AS outcome FROM t),
  a AS (SELECT *, coalesce(max(CASE WHEN outcome = 'hit' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r),
  l AS (SELECT *, max(CASE WHEN outcome = 'hit' THEN page_id END) OVER (PARTITION BY outlet, selector) AS last FROM a WHERE done = 0)
  SELECT outlet, selector, count(*) AS asked, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'none') AS none, count(*) FILTER (WHERE outcome = 'short') AS short,
    count(*) FILTER (WHERE last IS NULL OR page_id > last) AS misses, count(*) FILTER (WHERE last IS NULL OR page_id > last) >= 3 AS degraded FROM l GROUP BY 1, 2""")  # fmt: skip
def ht_selector_health(spark, d):
    return extraction.health(_articles(spark, d).select("page_id", "outlet", "tries"), "page_id")


_ALIASES = [(i * 2 + j, alias, domain) for i, (name, domain) in enumerate(PUBLISHERS) for j, alias in enumerate((name, f"{name} news"))]
_NAME = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'First News of today' WHEN 2 THEN ' the OTHER paper ' WHEN 3 THEN 'Desk ' || {h} WHEN 4 THEN {h} || ' desk' ELSE NULL END"


@query(rf"""WITH p AS (SELECT page_id, {_HOST} AS h, url FROM pages), c AS (SELECT page_id, {_NAME.format(h='h')} AS name FROM p),
  r AS (SELECT h AS canonical_name, 'Desk ' || h AS alias, min(page_id) % 2 = 0 AS is_active FROM p GROUP BY h),
  k AS (SELECT * FROM (VALUES {", ".join(f"({p}, '{a}', '{d}')" for p, a, d in _ALIASES)}) v(place, alias, domain)),
  n AS (SELECT page_id, name, trim(name) AS raw, lower(trim(name)) AS low FROM c),
  f AS (SELECT *, CASE WHEN regexp_full_match({_HOST.replace("url", "low")}, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,}}') THEN {_HOST.replace("url", "low")} END AS domain,
    (SELECT min_by(domain, place) FROM k WHERE k.alias = n.low) AS exact, (SELECT min_by(domain, place) FROM k WHERE starts_with(n.low, k.alias)) AS prefix,
    (SELECT min_by(domain, place) FROM k WHERE contains(n.low, k.alias)) AS held, (SELECT min(canonical_name) FROM r WHERE canonical_name = n.low) AS registered,
    (SELECT min(canonical_name) FROM r WHERE alias = n.raw AND is_active) AS also FROM n),
  s AS (SELECT page_id, name, coalesce(domain, exact, prefix, held, registered, also) AS canonical, CASE WHEN domain IS NOT NULL THEN 'domain' WHEN exact IS NOT NULL THEN 'exact' WHEN prefix IS NOT NULL THEN 'prefix'
    WHEN held IS NOT NULL THEN 'within' WHEN registered IS NOT NULL THEN 'registered' WHEN also IS NOT NULL THEN 'alias' END AS step FROM f),
  m AS (SELECT s.*, CASE WHEN coalesce(trim(name), '') = '' THEN 'SOURCE_NOT_SUPPLIED' WHEN canonical IS NULL THEN 'SOURCE_UNRECOGNIZED' WHEN NOT coalesce(is_active, true) THEN 'SOURCE_INACTIVE' ELSE 'SOURCE_SELECTED' END AS reason
    FROM s LEFT JOIN r ON r.canonical_name = s.canonical)
  SELECT page_id, name, CASE WHEN reason = 'SOURCE_SELECTED' THEN canonical END AS canonical, CASE WHEN reason = 'SOURCE_SELECTED' THEN step END AS step,
    CASE WHEN reason = 'SOURCE_SELECTED' THEN 'CLAIMED_SOURCE' ELSE 'VERIFIED_SOURCES' END AS mode, reason FROM m""")  # fmt: skip
def jn_source_resolution(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("h"))
    claims = pages.select("page_id", F.expr(_NAME.format(h="h")).alias("name"))
    registry = pages.groupBy("h").agg((F.min("page_id") % 2 == 0).alias("is_active")).select(F.col("h").alias("canonical_name"), F.array(F.concat(F.lit("Desk "), F.col("h"))).alias("aliases"), "is_active")
    aliases = spark.createDataFrame(_ALIASES, "place int, alias string, domain string")
    return resolution.with_mode(resolution.resolved(claims, "name", aliases, registry), "name", registry)


_OUTLET_SQL = ", ".join(f"({i}, '{d}')" for i, (d, *_) in enumerate(OUTLETS))


@query(f"""SELECT page_id, (SELECT min_by(domain, place) FROM (VALUES {_OUTLET_SQL}) v(place, domain) WHERE h = domain OR ends_with(h, '.' || domain)) AS outlet FROM (SELECT page_id, {_HOST} AS h FROM pages)""")
def jn_outlet_by_suffix(spark, d):
    known = outlets(spark).withColumns({k: F.array().cast("array<string>") for k in extraction.KINDS})
    return extraction.by_outlet(table(spark, d, "pages").select("page_id", "url"), extraction.compiled(known)).select("page_id", "outlet")
