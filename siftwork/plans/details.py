"""Smaller operators: accounting, validation, visibility, identity pieces, reuse and result assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import dates, identity, payloads, text, urls, vectors
from siftwork.operators import decisions, duplicates, ranking, records
from siftwork.sources.tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""SELECT user_id % 7 AS provider, event_type AS outcome, count(*) AS n, sum(count(*)) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY user_id % 7) AS attempted
  FROM events GROUP BY 1, 2""")  # fmt: skip
def ag_search_accounting(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("provider"), F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))
    totals = rows.groupBy("provider").agg(F.sum(F.when(F.col("outcome") != "view", F.col("n"))).cast("double").alias("attempted"))
    return rows.join(totals, "provider")


@query("SELECT list_sort(list(DISTINCT source))[1] AS first, left(sha256(array_to_string(list_sort(list(DISTINCT source)), chr(10))), 24) AS digest FROM documents")
def ag_registry_fingerprint(spark, d):
    names = table(spark, d, "documents").select("source").distinct().agg(F.array_sort(F.collect_list("source")).alias("names"))  # one per source
    return names.select(F.col("names")[0].alias("first"), identity.fingerprint(F.col("names")).alias("digest"))


@query("SELECT q.i AS kind, count(e.event_id) AS n FROM range(8) q(i) LEFT JOIN events e ON e.user_id % 9 = q.i GROUP BY 1")
def ag_counts_with_zero(spark, d):
    kinds = spark.range(8).toDF("kind")
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 9).alias("kind")).agg(F.count("event_id").alias("n"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR toxic = 1 THEN false ELSE true END AS visible, coalesce(quality = 1, false) AND doc_id % 5 <> 0 AS can_vote
  FROM documents LEFT JOIN labels USING (doc_id)""")  # fmt: skip
def pf_visibility(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    hidden = (F.col("doc_id") % 4 == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return rows.select("doc_id", (~hidden).alias("visible"), (F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.col("doc_id") % 5 != 0)).alias("can_vote"))


@query("""SELECT s_suppkey, array_to_string(list_distinct_ordered, ',') AS aliases FROM (SELECT s_suppkey, list_transform(list_filter(['  ' || s_name, lower(s_name), s_name || ' ', '', 'x' || s_nationkey],
  lambda a: trim(a) <> ''), lambda a: trim(a)) AS l, list_filter(l, lambda a, i: list_position(l, a) = i) AS list_distinct_ordered FROM supplier)""")  # fmt: skip
def pf_clean_aliases(spark, d):
    given = F.array(F.concat(F.lit("  "), "s_name"), F.lower("s_name"), F.concat("s_name", F.lit(" ")), F.lit(""), F.concat(F.lit("x"), F.col("s_nationkey").cast("string")))
    clean = F.array_distinct(F.filter(F.transform(given, lambda a: F.trim(a)), lambda a: a != ""))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(clean, ",").alias("aliases"))


@query("SELECT s_suppkey, n FROM (SELECT s_suppkey % 10 AS s_suppkey, count(*) AS n FROM supplier GROUP BY 1) WHERE n > 1")
def pf_key_violations(spark, d):
    return table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 10).alias("s_suppkey")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'purchase') WHERE place <= 5""")
def so_newest_five(spark, d):
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return ranking.first_per(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


@query("SELECT event_id FROM events WHERE event_type = 'view' OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-10') ORDER BY ts, event_id LIMIT 21")
def so_look_ahead(spark, d):
    rows = table(spark, d, "events")
    wanted = (F.col("event_type") == "view") | (F.col("event_type") == "click") & (F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return rows.where(wanted).orderBy("ts", "event_id").limit(20 + 1).select("event_id")


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS surrogate, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%d %B %Y') AS written FROM documents")
def hs_surrogates(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("surrogate"), F.date_format(day, "dd MMMM yyyy").alias("written"))


@query("SELECT page_id, lower(regexp_replace(trim(url), '/+$', '')) AS key, regexp_replace(url, '/amp/?$', '') AS bare FROM pages")
def ur_evidence_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.evidence_key(F.col("url")).alias("key"), urls.unwrapped(F.col("url")).alias("bare"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-60.0, least(60.0, value - 20)))), 9) AS sigmoid, greatest(0.0, least(1.0, value / 100)) AS clamped FROM events")
def ma_sigmoid(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(vectors.sigmoid(v - 20), 9).alias("sigmoid"), vectors.clamped(v / 100).alias("clamped"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(j, '$.k') AS INTEGER) AS k, json_extract_string(j, '$.note') AS note FROM
  (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"k": "bad", "note": "n' || event_id || '"}' ELSE '{"k": ' || event_id || '}' END AS j FROM events)""")  # fmt: skip
def js_salvage(spark, d):
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": "bad", "note": "n'), i, F.lit('"}'))).otherwise(F.concat(F.lit('{"k": '), i, F.lit("}")))
    rows = table(spark, d, "events").select("event_id", raw.alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").try_cast("int").alias("k"), F.get_json_object("j", "$.note").alias("note"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'version' WHEN event_id % 5 = 0 THEN 'copy' WHEN event_id % 4 = 0 THEN 'incomplete' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'body' ELSE 'reusable' END AS reason FROM events""")
def ta_reuse_reason(spark, d):
    i = F.col("event_id")
    reason = decisions.reuse_reason(F.when(i % 7 == 0, "old").otherwise("1"), "1", i % 5 == 0, [F.when(i % 4 == 0, "INCOMPLETE").otherwise("CONFIRMED")], [F.when(i % 3 != 0, F.lit(0.5))], i % 2 == 0)
    return table(spark, d, "events").select("event_id", reason.alias("reason"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'INCOMPLETE' WHEN event_id % 2 = 0 THEN 'MATCHED' ELSE 'MISMATCHED' END AS status FROM events""")
def de_date(spark, d):
    i = F.col("event_id")
    day = F.lit("2024-01-01").cast("date")
    article = F.when(i % 5 == 0, F.lit(None).cast("date")).when(i % 2 == 0, day).otherwise(F.date_add(day, 1))
    return table(spark, d, "events").select("event_id", decisions.date_status(day, article, i % 6 != 0).alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'EXACT' WHEN event_id % 9 = 0 THEN 'DIFFERENT' WHEN event_id % 8 = 0 THEN 'SAME_WORDS' WHEN event_id % 7 = 0 THEN 'UNAVAILABLE'
  WHEN e >= 0.8 AND c <= 0.2 THEN 'EQUIVALENT' WHEN c >= 0.7 OR e < 0.5 AND event_id % 2 = 1 THEN 'DIVERGENT' ELSE 'UNDETERMINED' END AS verdict
  FROM (SELECT event_id, (event_id * 37 % 100) / 100.0::DOUBLE AS e, (event_id * 61 % 100) / 100.0::DOUBLE AS c FROM events)""")  # fmt: skip
def de_headline(spark, d):
    i = F.col("event_id")
    e, c = (F.when(i % 7 != 0, (i * m % 100) / F.lit(100.0)) for m in (37, 61))
    return table(spark, d, "events").select("event_id", decisions.headline_verdict(i % 10 == 0, F.when(i % 9 == 0, 1).otherwise(0), i % 8 == 0, e, c, F.lit(0.9), i % 2).alias("verdict"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR trim(text) = '' THEN 'HEADLINE_ONLY' ELSE 'HEADLINE_WITH_BODY' END AS scope, CASE WHEN doc_id % 5 = 0 THEN 'API_FAILED' WHEN length(trim(text[1:10])) >= 8 AND regexp_matches(text[1:10], '\\p{L}') THEN 'SUCCEEDED' ELSE 'INVALID_CONTENT' END AS outcome FROM documents")
def ta_claim_scope(spark, d):
    from siftwork.operators.evidence import claim_scope, extraction_outcome

    kind, error = F.when(F.col("doc_id") % 3 == 0, "PHOTO_CARD").otherwise("TEXT"), F.when(F.col("doc_id") % 5 == 0, "timeout")
    return table(spark, d, "documents").select("doc_id", claim_scope(kind, F.col("text")).alias("scope"), extraction_outcome(error, F.left("text", F.lit(10))).alias("outcome"))


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'A') AS decided_by_admin, max_by(l_linestatus, {'a': l_returnflag = 'A', 'p': l_partkey, 'n': l_linenumber}) AS verdict FROM lineitem GROUP BY 1""")
def dm_admin_overrides(spark, d):
    admin = F.col("l_returnflag") == "A"
    weight = F.struct(admin, "l_partkey", "l_linenumber")  # an admin's word outranks any other row
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(admin).alias("decided_by_admin"), F.max_by("l_linestatus", weight).alias("verdict"))


@query()
def tx_titles(spark, d):
    page = table(spark, d, "pages")
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return page.select("page_id", text.clean_title(title).alias("title"), text.exact_key(title).alias("key"))


@query()
def tx_qualifiers(spark, d):
    rows = spread(table(spark, d, "documents")).select("doc_id", text.tokens(F.col("text")).alias("words"))
    return rows.select("doc_id", text.negated(F.col("words")).alias("negated"), F.array_join(text.qualifier_groups(F.col("words")), ",").alias("groups"), F.size(text.bigrams(F.col("words"))).alias("bigrams"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def dt_card_date(spark, d):
    day = F.col("o_orderdate")
    later = F.date_format(F.date_add(day.cast("date"), 1), "dd.MM.yyyy")
    forms = [F.date_format(day, "d'th' MMMM, yyyy"), F.date_format(day, "MMM d yyyy"), F.date_format(day, "yyyy/M/d"), F.date_format(day, "dd-MM-yyyy"), F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" or "), later)]
    written = F.concat(F.lit("Printed "), F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(" in Dhaka"))
    return table(spark, d, "orders").select("o_orderkey", dates.card_date(written).cast("string").alias("day"))


_PART = "list_cosine_similarity(CAST(b.embedding[{0}] AS DOUBLE[]), CAST(a.embedding[{0}] AS DOUBLE[])) >= {1}"


@query(f"""WITH e AS (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)
  SELECT a.vec_id, max(b.vec_id) FILTER (WHERE {_PART.format("1:32", 0.2)} AND {_PART.format("33:64", 0.2)} AND {_PART.format("1:64", 0.3)}) AS match
  FROM e a LEFT JOIN e b ON a.label = b.label AND b.n < a.n AND b.n >= a.n - 100 GROUP BY 1""")  # fmt: skip
def dd_three_cosines(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("text"), F.slice("embedding", 33, 32).alias("image"), F.col("embedding").alias("combined"))
    return duplicates.near_by_all(rows, "label", [F.col("vec_id")], "vec_id", {"text": 0.2, "image": 0.2, "combined": 0.3}).select("vec_id", "match")


@query("""WITH e AS (SELECT event_id, user_id, event_type, props, json_object('user', user_id, 'value', CAST(floor(value) AS BIGINT)) AS place FROM events)
  SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN json_object('k', user_id, 'kind', event_type, 'at', place) WHEN 1 THEN json_object('kind', event_type, 'at', place)
    ELSE json_merge_patch(props, json_object('kind', event_type, 'at', place)) END AS VARCHAR) AS props FROM e""")  # fmt: skip
def js_merge(spark, d):
    at = F.to_json(F.struct(F.col("user_id").alias("user"), F.floor("value").alias("value")))
    first = payloads.merged(F.col("props"), {"kind": F.to_json(F.struct(F.col("event_type").alias("x"))).substr(F.lit(6), F.length("event_type") + 2), "at": at})
    changed = F.when(F.col("event_id") % 3 == 0, payloads.merged(F.col("first"), {"k": F.col("user_id").cast("string")})).when(F.col("event_id") % 3 == 1, payloads.merged(F.col("first"), {}, drop=("k",))).otherwise(F.col("first"))
    return table(spark, d, "events").withColumn("first", first).select("event_id", changed.alias("props"))


@query("""WITH r AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey - 1 END AS reused, CASE WHEN l_orderkey % 3 <> 0 AND l_orderkey % 7 <> 1 THEN min(l_returnflag) END AS verdict
    FROM lineitem GROUP BY l_orderkey),
  m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey - 1 END AS copy_of, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS verdict FROM customer)
  SELECT o_orderkey, coalesce(r2.verdict, r1.verdict, m2.verdict, m1.verdict) AS verdict, r1.id IS NOT NULL AS structured, r2.id IS NOT NULL AS reused, m2.id IS NOT NULL AS copied FROM orders
  LEFT JOIN r r1 ON r1.id = o_orderkey LEFT JOIN r r2 ON r2.id = r1.reused LEFT JOIN m m1 ON m1.id = o_custkey LEFT JOIN m m2 ON m2.id = m1.copy_of""")  # fmt: skip
def jn_four_way(spark, d):
    """A claim with its result, the result that was reused, its image analysis, and the one that is a copy of."""
    key = F.col("l_orderkey")
    results = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    results = results.select(key.alias("id"), F.when(key % 3 == 0, key - 1).alias("reused"), F.when((key % 3 != 0) & (key % 7 != 1), F.col("flag")).alias("verdict"))
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") - 1).alias("copy_of"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("verdict"))
    named = lambda rows, key, n, *more: rows.select(F.col("id").alias(key), F.col("id").alias(n), *more, F.col("verdict").alias(f"{n}_verdict"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(named(results, "o_orderkey", "r1", "reused"), "o_orderkey", "left")
    rows = records.left_join_known(rows, named(results, "reused", "r2"), "reused", "o_orderkey").join(named(images, "o_custkey", "m1", "copy_of"), "o_custkey", "left")
    rows = records.left_join_known(rows, named(images, "copy_of", "m2"), "copy_of", "o_orderkey")
    known = [F.col(t).isNotNull().alias(n) for t, n in (("r1", "structured"), ("r2", "reused"), ("m2", "copied"))]
    return rows.select("o_orderkey", F.coalesce("r2_verdict", "r1_verdict", "m2_verdict", "m1_verdict").alias("verdict"), *known)
