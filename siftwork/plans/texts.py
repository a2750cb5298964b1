"""Texts, pages, hashes, similarity and decisions over documents, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import identity, text, urls
from siftwork.operators import decisions, duplicates, ranking, search, similarity
from siftwork.sources import html
from siftwork.sources.staged import staged
from siftwork.sources.tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _any(term: str) -> str:
    return f"(contains(lower(text), '{term}') OR contains(lower(source), '{term}'))"


_SEARCH = "the hand is src1"
_KEYWORDS = ("hand", "src1")
_HITS = " + ".join(f"CAST({_any(k)} AS INTEGER)" for k in _KEYWORDS)


@query(f"""SELECT doc_id, CAST({_HITS} AS INTEGER) AS hits, CAST({_any(_SEARCH)} AS INTEGER) AS phrase_hit FROM documents
  WHERE {" OR ".join(map(_any, _KEYWORDS))} ORDER BY hits DESC, phrase_hit DESC, n_chars DESC, doc_id DESC LIMIT 200""")  # fmt: skip
def kw_search_ranked(spark, d):
    found = search.KeywordSearch(_SEARCH, ["text", "source"]).ranked(table(spark, d, "documents"))
    order = [F.desc("hits"), F.desc("phrase_hit"), F.desc("n_chars"), F.desc("doc_id")]
    return search.page(found, order, 1, 200).select("doc_id", "hits", "phrase_hit")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'hand') AND contains(lower(text), 'thing')")
def pf_every_word(spark, d):
    return table(spark, d, "documents").where(search.KeywordSearch("hand thing", ["text"]).every_word()).select("doc_id")


# ASCII white space alone stands for the Unicode one here: the documents have no other.
_MATCH = r"trim(regexp_replace(lower(nfc_normalize(replace(translate(translate(nfc_normalize(text), '।॥“”‘’—–', '..\"\"''''--'), '০১২৩৪৫৬৭৮৯', '0123456789'), '…', '...'))), '\s+', ' ', 'g'))"
_TOKENS = f"regexp_extract_all({_MATCH}, '[ঀ-৿0-9A-Za-z]+(?:[.,][0-9]+)*')"


@query(f"SELECT doc_id, len({_TOKENS}) AS tokens, len(list_distinct({_TOKENS})) AS different FROM documents")
def tx_tokenize_counts(spark, d):
    words = text.tokens(F.col("text"))
    return spread(table(spark, d, "documents")).select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("different"))


@query(f"SELECT doc_id, sha256({_MATCH}) AS form FROM documents")
def tx_normalize(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.sha2(text.match_form(F.col("text")), 256).alias("form"))


_WORDS = r"list_filter(string_split_regex(nfc_normalize(text), '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, array_to_string(({_WORDS})[1:5], ' ') || CASE WHEN len({_WORDS}) > 5 THEN '...' ELSE '' END AS preview FROM documents")
def tx_preview(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN text[1:400] || '…' ELSE text END AS short FROM documents")
def pf_shortened(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text"), 400).alias("short"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([।.!?‼])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 8)"


@query(f"SELECT doc_id, len({_SENTENCES}) AS sentences, array_to_string({_SENTENCES}, '|') AS joined FROM documents")
def tx_sentences(spark, d):
    parts = text.sentences(F.col("text"))
    return spread(table(spark, d, "documents")).select("doc_id", F.size(parts).cast("long").alias("sentences"), F.array_join(parts, "|").alias("joined"))


@query(f"""SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM
  (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1
  ORDER BY documents DESC, term LIMIT 300""")  # fmt: skip
def ag_term_frequencies(spark, d):
    rows = spread(table(spark, d, "documents")).select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    per = rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).orderBy(F.desc("documents"), "term").limit(300)


def _tok(column: str) -> str:
    return _TOKENS.replace("nfc_normalize(text)", f"nfc_normalize({column})")


def _runs(words: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 4, 1) + 1), lambda k: array_to_string({words}[k:k + 4], ' ')))"


# Pairs: a benchmark item and a document that share a run of five tokens.
_PAIRS = f"""(WITH i AS (SELECT item_id, text AS claim, {_tok("text")} AS a FROM benchmark), d AS (SELECT doc_id, text AS source, {_tok("text")} AS b FROM documents),
  linked AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, unnest({_runs("a")}) AS run FROM i WHERE len(a) > 0) JOIN (SELECT doc_id, unnest({_runs("b")}) AS run FROM d WHERE len(b) > 0) USING (run))
  SELECT item_id, doc_id, claim, source, a, b FROM linked JOIN i USING (item_id) JOIN d USING (doc_id))"""


def pairs(spark, d):
    """item_id, doc_id, claim, source and their tokens a and b."""
    items, docs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim")), spread(table(spark, d, "documents").select("doc_id", F.col("text").alias("source")))
    words = lambda rows, key, column: rows.select(key, text.tokens(F.col(column)).alias("words"))
    linked = similarity.sharing_runs(words(items, "item_id", "claim"), words(docs, "doc_id", "source"), "item_id", "doc_id")
    # As files their size is known, so that documents are not shuffled for a few pairs.
    rows = staged(linked, "linked").join(items, "item_id").join(docs, "doc_id")
    return rows.select("item_id", "doc_id", "claim", "source", text.tokens(F.col("claim")).alias("a"), text.tokens(F.col("source")).alias("b"))


@query(f"""SELECT item_id, doc_id, round(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard
  FROM {_PAIRS}""")  # fmt: skip
def st_jaccard_tokens(spark, d):
    return pairs(spark, d).select("item_id", "doc_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"SELECT item_id, doc_id, list_has_any(a, b) AS overlaps, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_claim FROM {_PAIRS}")
def st_overlap(spark, d):
    return pairs(spark, d).select("item_id", "doc_id", F.arrays_overlap("a", "b").alias("overlaps"), F.size(F.array_except("a", "b")).cast("long").alias("only_claim"))


_PLAIN_STOP = ", ".join(f"'{w}'" for w in text.nfc_words(text.STOPWORDS))
_HEAVY = ", ".join(f"'{w}'" for w in text.nfc_words(text.NEGATIONS + sum(text.QUALIFIERS.values(), ())))


def _content(words: str) -> str:
    return f"list_filter({words}, lambda t: t IN ({_HEAVY}) OR regexp_full_match(t, '[0-9][0-9.,]*') OR (t NOT IN ({_PLAIN_STOP}) AND length(t) >= 2))"


@query(f"""WITH p AS (SELECT item_id, doc_id, {_content("a")} AS a, {_content("b")} AS b FROM {_PAIRS}),
  x AS (SELECT item_id, doc_id, term, count(*) FILTER (WHERE side = 0) AS n, count(*) FILTER (WHERE side = 1) AS m FROM
    (SELECT item_id, doc_id, 0 AS side, unnest(a) AS term FROM p UNION ALL SELECT item_id, doc_id, 1, unnest(b) FROM p) GROUP BY 1, 2, 3),
  w AS (SELECT *, CASE WHEN n > 0 AND m > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS idf FROM x)
  SELECT item_id, doc_id, round(sum(n * m * idf * idf) / (sqrt(sum(n * n * idf * idf)) * sqrt(sum(m * m * idf * idf))), 6) AS cosine FROM w
  GROUP BY 1, 2 HAVING sum(n) > 0 AND sum(m) > 0""")  # fmt: skip
def ta_tfidf_cosine(spark, d):
    rows = pairs(spark, d).select("item_id", "doc_id", text.content_of(F.col("a")).alias("a"), text.content_of(F.col("b")).alias("b"))
    return similarity.tfidf_cosines(rows, ["item_id", "doc_id"], "a", "b").withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH p AS (SELECT item_id, doc_id, list_distinct({_content("a")}) AS a, b FROM {_PAIRS}),
  k AS (SELECT *, list_concat(b, list_transform(list_zip(b[1:-2], b[2:]), lambda z: z[1] || z[2])) AS keys FROM p),
  u AS (SELECT item_id, doc_id, unnest(a) AS t, keys FROM k)
  SELECT item_id, doc_id, round(sum(CASE WHEN list_contains(keys, t) THEN w ELSE 0 END) / sum(w), 6) AS coverage FROM
    (SELECT *, CASE WHEN t IN ({_HEAVY}) OR regexp_full_match(t, '[0-9][0-9.,]*') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM u) GROUP BY 1, 2""")  # fmt: skip
def ta_keyword_coverage(spark, d):
    rows = pairs(spark, d).select("item_id", "doc_id", text.content_of(F.col("a")).alias("a"), "b")
    rows = rows.select("item_id", "doc_id", similarity.units(F.col("a"), text.stem_list(F.col("a"))).alias("units"), similarity.evidence_keys(F.col("b")).alias("keys"))
    return rows.where(F.size("units") > 0).select("item_id", "doc_id", F.round(similarity.coverage(F.col("units"), F.col("keys")), 6).alias("coverage"))


# DuckDB counts edits of bytes: the letters beyond ASCII that the texts have stand as control characters, one byte each.
_ACCENTED = "óñÓíÑÍÊéèêçÈÉÇößäüÖÜÄ"
_ONE_BYTE = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


def _edit_form(column: str) -> str:
    return rf"translate(trim(regexp_replace(nfc_normalize({column}), '\s+', ' ', 'g'))[1:20000], '{_ACCENTED}', '{_ONE_BYTE}')"


@query(f"""SELECT item_id, doc_id, round(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 6) AS similarity
  FROM (SELECT item_id, doc_id, {_edit_form("claim")} AS x, {_edit_form("source")} AS y FROM {_PAIRS})""")  # fmt: skip
def tx_levenshtein_norm(spark, d):
    return pairs(spark, d).select("item_id", "doc_id", F.round(similarity.edit_similarity(F.col("claim"), F.col("source")), 6).alias("similarity"))


@query("SELECT doc_id, CASE WHEN first < doc_id THEN first END AS duplicate_of, h AS content_hash FROM (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)")
def dd_exact(spark, d):
    return duplicates.exact(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "duplicate_of", "content_hash")


@query(r"SELECT doc_id, sha256(lower(regexp_replace(nfc_normalize(text), '^\s+|\s+$', '', 'g'))) AS text_hash FROM documents")
def hs_text_hash(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", identity.text_hash(F.col("text")).alias("text_hash"))


def _esc(x: str) -> str:
    return rf"""'"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"'"""


_CANON = r"trim(regexp_replace(replace(translate(nfc_normalize(text), '।॥“”‘’—–', '..\"\"''''--'), '…', '...'), '\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, sha256('{{"body": ' || CASE WHEN doc_id % 2 = 0 THEN {_esc(f"lower({_CANON})")} ELSE 'null' END || ', "date": null, "headline": ' || {_esc(f"lower({_CANON})")}
  || ', "scope": "' || CASE WHEN doc_id % 2 = 0 THEN 'HEADLINE_WITH_BODY' ELSE 'HEADLINE_ONLY' END || '", "source": ' || {_esc("lower(trim(source))")} || ', "v": "1"}}') AS claim_hash FROM documents""")  # fmt: skip
def hs_content_hash(spark, d):
    scope = F.when(F.col("doc_id") % 2 == 0, "HEADLINE_WITH_BODY").otherwise("HEADLINE_ONLY")
    value = identity.claim_hash(F.col("text"), F.col("source"), scope, F.col("text"), F.lit(None), "1")
    return spread(table(spark, d, "documents")).select("doc_id", value.alias("claim_hash"))


_TRACKED = "utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|mc_cid|mc_eid|ref|referrer|_ga"
_KEPT = f"list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^({_TRACKED})(=|$)'))"


@query(f"""SELECT page_id, sha256(lower(CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN url ELSE regexp_extract(url, '^[^?#]*') ||
  CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END || regexp_extract(url, '#.*$') END)) AS url_hash FROM pages""")  # fmt: skip
def hs_url_hash(spark, d):
    return spread(table(spark, d, "pages")).select("page_id", identity.url_hash(F.col("url")).alias("url_hash"))


_DROPPED = "|".join(urls.DROPPED)
_QUERY = f"list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+$') AND NOT regexp_matches(lower(p), '^({_DROPPED})=')))"
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"""SELECT page_id, 'https://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url
  FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/amp/?$', ''), '/+$', '') AS p, {_QUERY} AS q FROM pages)""")  # fmt: skip
def ur_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@query("""SELECT page_id, regexp_matches(p, '/\\d{4}/\\d{2}/\\d{2}(/|$)') OR len(list_filter(string_split(p, '/'), lambda s: regexp_full_match(s, '[0-9]{4,}|[a-zA-Z]+-[0-9]{3,}') OR
  length(s) >= 8 AND regexp_full_match(s, '[A-Za-z0-9]+') AND regexp_matches(s, '[0-9]'))) > 0 AS article FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")  # fmt: skip
def ur_probable_article(spark, d):
    return table(spark, d, "pages").select("page_id", urls.probable_article(F.col("url")).alias("article"))


# Publishers in canonical order; the first one that a host belongs to wins.
PUBLISHERS = [("blogs", "example.net"), ("farm", "spam-farm.example.org"), ("first", "example.com"), ("other", "example.org"), ("second", "example.com")]
_PUBLISHERS = ", ".join(f"('{n}', '{dom}')" for n, dom in PUBLISHERS)


@query(f"""SELECT page_id, (SELECT min(n) FROM (VALUES {_PUBLISHERS}) v(n, domain) WHERE h = domain OR ends_with(h, '.' || domain)) AS publisher
  FROM (SELECT page_id, {_HOST} AS h FROM pages)""")  # fmt: skip
def jn_host_publisher(spark, d):
    name = urls.host(F.col("url"))
    matches = [F.when(urls.on_domain(name, F.array(F.lit(dom))), F.lit(n)) for n, dom in sorted(PUBLISHERS)]
    return table(spark, d, "pages").select("page_id", F.coalesce(*matches).alias("publisher"))


@query(f"""SELECT host, page_id, url FROM (SELECT {_HOST} AS host, page_id, url, row_number() OVER (PARTITION BY {_HOST} ORDER BY url LIKE 'https%' DESC, length(html) DESC, page_id) AS place FROM pages) WHERE place <= 3""")
def wn_dedup_first_url(spark, d):
    rows = table(spark, d, "pages").select(urls.host(F.col("url")).alias("host"), "page_id", "url", F.length("html").alias("n"))
    return ranking.first_per(rows, ["host"], [F.col("url").startswith("https").desc(), F.desc("n"), F.col("page_id")], 3).drop("n")


@query(f"""SELECT host, min_by(page_id, p * 1000000 + page_id) AS page_id, min(p) AS priority FROM (SELECT {_HOST} AS host, page_id, CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END AS p FROM pages) GROUP BY 1""")
def wn_best_priority(spark, d):
    priority = F.when(F.col("url").startswith("https"), 0).otherwise(1)
    rows = table(spark, d, "pages").select(urls.host(F.col("url")).alias("host"), "page_id", priority.alias("p"))
    return rows.groupBy("host").agg(F.min_by("page_id", F.struct("p", "page_id")).alias("page_id"), F.min("p").alias("priority"))


_VISIBLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(rf"SELECT page_id, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS title, length({_VISIBLE}) AS visible FROM pages")
def ht_title_visible_len(spark, d):
    page = F.col("html")
    return spread(table(spark, d, "pages")).select("page_id", F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title>", 1).alias("title"), F.length(html.visible(page)).cast("long").alias("visible"))


@query(rf"SELECT page_id, regexp_matches(html, '(?i)enable javascript|track\(') AND length({_VISIBLE}) < 2000 AS shell FROM pages")
def pf_shell_page(spark, d):
    page = F.col("html")
    return spread(table(spark, d, "pages")).select("page_id", (page.rlike(r"(?i)enable javascript|track\(") & (F.length(html.visible(page)) < html.SHELL_CHARS)).alias("shell"))


@query()
def ht_links(spark, d):
    return html.links(spread(table(spark, d, "pages")))


_COS = "list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"


@query(f"""WITH e AS (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)
  SELECT a.vec_id, max(b.vec_id) FILTER (WHERE {_COS} >= 0.4) AS match FROM e a LEFT JOIN e b ON a.label = b.label AND b.n < a.n AND b.n >= a.n - 100 GROUP BY 1""")  # fmt: skip
def dd_near_dup(spark, d):
    return duplicates.near(table(spark, d, "embeddings"), "label", [F.col("vec_id")], "vec_id", "embedding", 0.4).select("vec_id", "match")


@query("SELECT vec_id, CAST(least(count(*) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 1, 100) AS BIGINT) AS candidates FROM embeddings")
def wn_recent_candidates(spark, d):
    return ranking.recent_count(table(spark, d, "embeddings").select("vec_id", "label"), "label", [F.col("vec_id")]).select("vec_id", "candidates")


_MEASURES = "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 7 % 100) / 100.0::DOUBLE END AS s, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 13 % 100) / 100.0::DOUBLE END AS t, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id * 29 % 100) / 100.0::DOUBLE END AS p FROM events)"
_LEVEL = """CASE WHEN s IS NULL AND t IS NULL AND p IS NULL THEN 'UNKNOWN' WHEN s IS NOT NULL THEN CASE WHEN s >= 0.85 OR s >= 0.72 AND coalesce(t >= 0.5, false) THEN 'STRONG'
  WHEN s >= 0.55 AND (coalesce(t >= 0.5, false) OR coalesce(p >= 0.6, false)) THEN 'PLAUSIBLE' ELSE 'NONE' END WHEN coalesce(t >= 0.7, false) THEN 'PLAUSIBLE' ELSE 'NONE' END"""


def _measures(spark, d):
    i = F.col("event_id")
    part = lambda k, m: F.when(i % k != 0, (i * m % 100) / F.lit(100.0))
    return table(spark, d, "events").select("event_id", part(5, 7).alias("s"), part(3, 13).alias("t"), part(4, 29).alias("p"))


@query(f"SELECT event_id, {_LEVEL} AS level FROM {_MEASURES}")
def de_correspondence(spark, d):
    return _measures(spark, d).select("event_id", decisions.correspondence(F.col("s"), F.col("t"), F.col("p")).alias("level"))


@query(f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'INCOMPLETE' WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 7 = 0 OR event_id % 2 = 1 THEN 'INCOMPLETE' ELSE 'NOT_FOUND' END
  WHEN level IN ('STRONG', 'PLAUSIBLE') THEN 'CONFIRMED' WHEN level = 'UNKNOWN' OR event_id % 2 = 1 THEN 'INCOMPLETE' ELSE 'NOT_FOUND' END AS status FROM (SELECT event_id, {_LEVEL} AS level FROM {_MEASURES})""")  # fmt: skip
def de_source(spark, d):
    i = F.col("event_id")
    level = decisions.correspondence(F.col("s"), F.col("t"), F.col("p"))
    return _measures(spark, d).select("event_id", decisions.source_status(i % 6 != 0, i % 2 == 0, i % 7 == 0, level, i % 11 == 0).alias("status"))


@query(f"SELECT event_id, round(coalesce(list_avg(list_filter([s, t, p], lambda x: x IS NOT NULL)), 0), 6) AS strength FROM {_MEASURES}")
def de_strength(spark, d):
    return _measures(spark, d).select("event_id", F.round(similarity.mean_of_known(F.col("s"), F.col("t"), F.col("p")), 6).alias("strength"))


@query(f"SELECT event_id, round(least(1.0, 0.55 * s + 0.25 * t + 0.20 * p + CASE WHEN s > 0.85 THEN 0.15 WHEN s > 0.70 THEN 0.08 ELSE 0 END), 6) AS score FROM {_MEASURES} WHERE s IS NOT NULL AND t IS NOT NULL AND p IS NOT NULL")
def ta_rank_score(spark, d):
    rows = _measures(spark, d).dropna(subset=["s", "t", "p"])
    return rows.select("event_id", F.round(decisions.rank_score(F.col("s"), F.col("t"), F.col("p"), F.col("s")), 6).alias("score"))


@query(f"""SELECT event_id, CASE level WHEN 'NONE' THEN 'FAKE' WHEN 'UNKNOWN' THEN NULL ELSE CASE WHEN event_id % 9 = 0 THEN 'ALTERED' WHEN event_id % 8 = 0 THEN 'MISLEADING' ELSE 'REAL' END END AS verdict
  FROM (SELECT event_id, {_LEVEL} AS level FROM {_MEASURES})""")  # fmt: skip
def ta_overall_verdict(spark, d):
    i, level = F.col("event_id"), decisions.correspondence(F.col("s"), F.col("t"), F.col("p"))
    source = F.when(level == "NONE", "NOT_FOUND").when(level == "UNKNOWN", "INCOMPLETE").otherwise("CONFIRMED")
    return _measures(spark, d).select("event_id", decisions.overall(source, F.when(i % 9 == 0, "ALTERED"), F.when(i % 8 == 0, "MISMATCHED")).alias("verdict"))
