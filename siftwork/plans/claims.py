"""Claims and their owners: states, listings, joins made where needed, write-backs, labels, payloads and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import identity, payloads, text
from siftwork.operators import entities, labels, records, search, similarity, state
from siftwork.plans.texts import _PAIRS, _TOKENS, pairs
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


# Orders stand for claims: a status from two columns, and every fourth one a copy of an earlier one.
_CLAIMS = """(SELECT o_orderkey AS id, o_custkey AS submitter, CASE WHEN o_orderstatus = 'F' THEN 'FINALIZED' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'ESCALATED'
  WHEN o_orderstatus = 'O' THEN 'EXPERT_REVIEW' WHEN o_orderpriority = '5-LOW' THEN 'FAILED' ELSE 'PROCESSING' END AS status,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 0 THEN o_orderkey // 2 END AS duplicate_of, o_orderdate AS created_at, o_totalprice AS price FROM orders)"""


def claims(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = F.when(s == "F", "FINALIZED").when((s == "O") & (p == "1-URGENT"), "ESCALATED").when(s == "O", "EXPERT_REVIEW").when(p == "5-LOW", "FAILED").otherwise("PROCESSING")
    copy = F.when((F.col("o_orderkey") % 4 == 0) & (F.col("o_orderkey") > 0), F.expr("o_orderkey div 2"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("submitter"), status.alias("status"), copy.alias("duplicate_of"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))


_SOURCES = """(SELECT s_suppkey, replace(lower(s_name), '#', '-') || '.example' AS canonical, [s_name, 'S' || s_nationkey] AS aliases, CASE WHEN s_nationkey % 2 = 0 THEN 'bn' ELSE 'en' END AS language,
  s_acctbal > 0 AS is_active FROM supplier)"""


def sources(spark, d):
    canonical = F.concat(F.replace(F.lower("s_name"), F.lit("#"), F.lit("-")), F.lit(".example"))
    aliases = F.array("s_name", F.concat(F.lit("S"), F.col("s_nationkey").cast("string")))
    language = F.when(F.col("s_nationkey") % 2 == 0, "bn").otherwise("en")
    return table(spark, d, "supplier").select("s_suppkey", canonical.alias("canonical"), aliases.alias("aliases"), language.alias("language"), (F.col("s_acctbal") > 0).alias("is_active"))


@query(f"""SELECT c.id, CASE WHEN c.status IN ('PENDING', 'PROCESSING') THEN 'in_progress' WHEN c.status = 'FINALIZED' OR coalesce(c.duplicate_of IS NOT NULL AND c.status = 'EXPERT_REVIEW' AND o.status = 'FINALIZED', false) THEN 'final'
  WHEN c.status IN ('EXPERT_REVIEW', 'ESCALATED') THEN 'review' WHEN c.status = 'FAILED' THEN 'failed' END AS state FROM {_CLAIMS} c LEFT JOIN {_CLAIMS} o ON o.id = c.duplicate_of""")  # fmt: skip
def pf_user_state(spark, d):
    rows = claims(spark, d)
    theirs = rows.select(F.col("id").alias("duplicate_of"), F.col("status").alias("theirs"))
    joined = records.left_join_known(rows.select("id", "status", "duplicate_of"), theirs, "duplicate_of", "id")
    return joined.select("id", records.user_state(F.col("status"), F.col("duplicate_of").isNotNull(), F.col("theirs")).alias("state"))


@query(f"SELECT s_suppkey, canonical FROM {_SOURCES} WHERE list_contains(aliases, 'S7') AND is_active")
def pf_alias_contains(spark, d):
    return records.with_alias(sources(spark, d), "S7").select("s_suppkey", "canonical")


@query(f"SELECT s_suppkey FROM {_SOURCES} WHERE contains(lower(CAST(to_json(aliases) AS VARCHAR)), '\"s1')")
def pf_json_search(spark, d):
    return records.mentioning(sources(spark, d), '"S1', "aliases").select("s_suppkey")


@query("""SELECT event_id, expires > TIMESTAMP '2024-01-15' AND NOT coalesce(used, false) AND NOT revoked AS live, expires < TIMESTAMP '2024-01-15' AS purged FROM
  (SELECT event_id, ts + to_hours(CAST(floor(value) AS INTEGER)) AS expires, CASE WHEN event_type <> 'view' THEN event_type = 'purchase' END AS used, event_type = 'error' AS revoked FROM events)""")  # fmt: skip
def pf_expiry(spark, d):
    kind, now = F.col("event_type"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    expires = F.col("ts") + F.make_dt_interval(hours=F.floor("value").cast("int"))
    rows = table(spark, d, "events").select("event_id", expires.alias("expires"), F.when(kind != "view", kind == "purchase").alias("used"), (kind == "error").alias("revoked"))
    return rows.select("event_id", records.live(F.col("expires"), now, F.col("used"), F.col("revoked")).alias("live"), (F.col("expires") < now).alias("purged"))


@query(f"SELECT canonical, language FROM {_SOURCES} WHERE is_active AND language = 'bn' ORDER BY canonical LIMIT 25")
def sc_source_page(spark, d):
    return search.page(records.source_listing(sources(spark, d), "bn"), [F.col("canonical")], 1, 25).select("canonical", "language")


@query(f"SELECT count(*) AS everything, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_active AND language = 'en') AS active_en FROM {_SOURCES}")
def sc_source_counts(spark, d):
    s = sources(spark, d)
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    out = one(records.source_listing(s, active_only=False), "everything")
    return out.crossJoin(one(records.source_listing(s), "active")).crossJoin(one(records.source_listing(s, "en"), "active_en"))  # rows of one


@query("""SELECT event_id, array_to_string(list_filter(['Date missing', event_type || ' from Source', 'image ' || event_type, 'no ' || event_type], lambda w: NOT regexp_matches(w, '(?i)date|source')), '|') AS kept FROM events""")
def pf_warnings(spark, d):
    kind = F.col("event_type")
    given = F.array(F.lit("Date missing"), F.concat(kind, F.lit(" from Source")), F.concat(F.lit("image "), kind), F.concat(F.lit("no "), kind))
    return table(spark, d, "events").select("event_id", F.array_join(labels.kept_warnings(given), "|").alias("kept"))


_RESULTS = "(SELECT l_orderkey AS id, max(l_returnflag) AS verdict, count(*) AS evidence FROM lineitem GROUP BY 1)"


def results(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("verdict"), F.count("*").alias("evidence"))


@query(f"SELECT c.id, c.status FROM {_CLAIMS} c JOIN {_RESULTS} r ON r.id = c.id WHERE r.verdict = 'R' UNION ALL SELECT id, 'any' FROM {_CLAIMS}")
def jn_if_needed(spark, d):
    c, r = claims(spark, d), results(spark, d)
    narrowed = records.claims_with_results(c, r, "id", verdict="R").select("id", "status")
    return narrowed.union(records.claims_with_results(c, r, "id", verdict=None).select("id", F.lit("any")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE contains(lower(o_orderpriority), 'urgent')")
def jn_history_search(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    found = records.history(table(spark, d, "lineitem"), orders, "l_orderkey", "urgent", ["o_orderpriority"])
    return found.select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, c_name, epoch_us(last) // 1000000 - epoch_us(o_orderdate) // 1000000 AS elapsed FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")  # fmt: skip
def jn_report_limit(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    newest = rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)  # before the left join, which keeps each row
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return newest.join(last, "o_orderkey", "left").select("o_orderkey", "c_name", (seconds("last") - seconds("o_orderdate")).alias("elapsed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NOT NULL THEN o_orderstatus ELSE l_linestatus END AS l_linestatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '5-LOW') ON o_orderkey = l_orderkey""")
def jn_update_from(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    low = table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return state.updated_from(lines, low, ["l_orderkey"], l_linestatus=F.col("b.o_orderstatus"))


@query("""SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON n_nationkey = c_nationkey
  WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '7') OR coalesce(contains(lower(n_name), '7'), false))""")  # fmt: skip
def jn_profile_search(spark, d):
    profiles = table(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").join(profiles, "c_nationkey", "left")
    return rows.where(search.KeywordSearch("7", ["c_name", "n_name"]).condition()).select("c_custkey", "n_name")


@query("""SELECT event_id, coalesce(nullif(trim(name), ''), 'A reader') AS voter FROM events LEFT JOIN (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN c_name || ' ' END AS name FROM customer WHERE c_custkey < 100) ON c_custkey = user_id""")
def jn_null_names(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(" ")))
    users = table(spark, d, "customer").where("c_custkey < 100").select(F.col("c_custkey").alias("user_id"), name.alias("name"))
    return table(spark, d, "events").join(users, "user_id", "left").select("event_id", records.shown_name(F.col("name")).alias("voter"))


@query(f"""WITH t AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {_TOKENS} AS l FROM documents)),
  c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM t GROUP BY 1, 2),
  r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS place FROM c)
  SELECT doc_id, CAST(place AS INTEGER) AS place, term FROM r WHERE place <= 5""")  # fmt: skip
def ag_top_terms(spark, d):
    return text.top_terms(spread(table(spark, d, "documents")).select("doc_id", text.tokens(F.col("text")).alias("words")), "doc_id", "words", 5)


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY relevance IS NULL, relevance DESC, event_id) AS INTEGER) AS place
  FROM (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN (event_id * 7 % 10) / 10.0::DOUBLE END AS relevance FROM events) WHERE relevance IS NULL OR relevance > 0""")  # fmt: skip
def so_relevance(spark, d):
    from pyspark.sql import Window

    i = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(i % 5 != 0, (i * 7 % 10) / F.lit(10.0)).alias("relevance"))
    order = Window.partitionBy("user_id").orderBy(*records.relevant_first(rows, "relevance", "event_id"))
    return rows.where("relevance is null or relevance > 0").select("user_id", "event_id", F.row_number().over(order).alias("place"))


@query()
def so_collated(spark, d):
    """Names of sources in the order of Bengali collation."""
    names = table(spark, d, "documents").select("source").distinct()
    return names.select("source").orderBy(F.collate("source", "bn"), "source")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ADMIN_DECISION' ELSE 'VOTE' END AS kind, (SELECT count(*) FILTER (WHERE NOT coalesce(seen, false)) FROM (SELECT CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END AS seen FROM events)) AS unread
  FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")  # fmt: skip
def so_activity(spark, d):
    seen = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1)
    return records.activity(table(spark, d, "events"), F.col("event_type") == "error", "ts", "event_id", seen).limit(100).select("event_id", "kind", "unread")


@query(f"""WITH r AS (SELECT c.id, c.duplicate_of, r.verdict FROM {_CLAIMS} c JOIN {_RESULTS} r ON r.id = c.id),
  e AS (SELECT l_orderkey AS id, array_to_string(list(url ORDER BY score DESC, url)[1:5], ' ') AS evidence FROM (SELECT l_orderkey, 'https://' || l_partkey || '/' || l_linenumber AS url, l_discount AS score FROM lineitem) GROUP BY 1)
  SELECT r.id, coalesce(o.verdict, r.verdict) AS verdict, coalesce(e.evidence, '') AS evidence FROM r LEFT JOIN r o ON o.id = r.duplicate_of LEFT JOIN e ON e.id = r.id""")  # fmt: skip
def sc_result_model(spark, d):
    rows = claims(spark, d).select("id", "duplicate_of").join(results(spark, d).select("id", "verdict"), "id")
    url = F.concat(F.lit("https://"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    evidence = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), url.alias("url"), F.col("l_discount").alias("score"))
    return records.result_view(rows, rows.select("id", "verdict"), evidence, "id").select("id", "verdict", F.array_join("evidence", " ").alias("evidence"))


@query("""WITH c AS (SELECT doc_id, text, sha256(text) AS h FROM documents), a AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
  SELECT 'articles' AS tbl, count(*) AS n FROM documents UNION ALL SELECT 'cache', count(DISTINCT h) FROM c UNION ALL SELECT 'queries', 2 * count(*) FROM documents
  UNION ALL SELECT 'results', count(*) FROM documents UNION ALL SELECT 'submissions', count(*) FROM documents""")  # fmt: skip
def sk_persist(spark, d):
    docs = table(spark, d, "documents")
    url = F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    article = lambda u: F.struct(u.alias("url"), F.lit("t").alias("title"), F.col("text").alias("body"))
    checked = docs.select(
        F.col("doc_id").alias("id"), F.lit("h").alias("headline"), F.lit("REAL").alias("verdict"), F.sha2("text", 256).alias("content_hash"),
        F.array(article(url), article(F.upper(url))).alias("articles"), F.array(F.lit("a"), F.lit("b")).alias("queries"),
    )
    counts = [rows.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")) for name, rows in records.persisted(checked).items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


@query("""SELECT place, line FROM (SELECT 0 AS place, '| stage | n | most |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL
  SELECT CAST(1 + row_number() OVER (ORDER BY stage) AS INTEGER), '| ' || stage || ' | ' || n || ' | ' || most || ' |' FROM (SELECT event_type AS stage, count(*) AS n, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY 1))""")  # fmt: skip
def sk_report(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("most"))
    return records.markdown(rows, [F.col("stage")])


@query("""WITH k AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, max(ts) AS stored_at FROM events WHERE event_type = 'view' GROUP BY 1), f AS (SELECT * FROM c WHERE stored_at >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR)
  SELECT k.user_id, f.user_id IS NOT NULL AS hit FROM k LEFT JOIN f ON f.user_id = k.user_id""")  # fmt: skip
def ss_cached(spark, d):
    events = table(spark, d, "events")
    cache = events.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("stored_at"))
    hits, misses = records.cached(events.select("user_id"), cache, "user_id", "stored_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 24)
    return hits.select("user_id", F.lit(True).alias("hit")).union(misses.select("user_id", F.lit(False)))


# --- write-backs


@query(f"""WITH s AS (SELECT id, status FROM {_CLAIMS}), done AS (SELECT id FROM s WHERE status = 'FAILED')
  SELECT id, md5(CAST(id AS VARCHAR)) AS row_id, CASE WHEN status = 'FINALIZED' THEN 'final' ELSE 'preliminary' END AS stage FROM s WHERE status <> 'PROCESSING' AND NOT EXISTS (SELECT 1 FROM done WHERE done.id = s.id)""")  # fmt: skip
def dm_backfill(spark, d):
    rows = claims(spark, d).where("status <> 'PROCESSING'").select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("row_id"), F.when(F.col("status") == "FINALIZED", "final").otherwise("preliminary").alias("stage"))
    return state.insert_absent(claims(spark, d).where("status = 'FAILED'").select("id"), rows, ["id"])


@query("""SELECT reviewer, CASE WHEN total > 0 AND total >= 20 THEN correct * 1.0::DOUBLE / nullif(total, 0) END AS score FROM
  (SELECT l_suppkey AS reviewer, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS correct FROM lineitem WHERE l_quantity < 20 GROUP BY 1)""")  # fmt: skip
def dm_recompute(spark, d):
    profiles = table(spark, d, "lineitem").where("l_quantity < 20").groupBy(F.col("l_suppkey").alias("reviewer")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "A").alias("correct"))
    return state.scored(profiles, "total", "correct", "score", 20).select("reviewer", "score")


@query("""SELECT e.event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN true WHEN c_mktsegment = 'BUILDING' THEN false END AS exact FROM events e LEFT JOIN customer ON c_custkey = user_id""")
def dm_json_backfill(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).join(users, "user_id", "left")
    return rows.select("event_id", F.when(F.col("k") > 50, True).when(F.col("c_mktsegment") == "BUILDING", False).alias("exact"))


_OLD = "(SELECT o_orderkey AS id, 'u' || o_orderkey AS url, 'old ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'b' END AS body, 'a' || o_orderkey AS author, o_orderkey % 3 = 0 AS ok FROM orders WHERE o_orderkey % 5 < 3)"
_NEW = "(SELECT o_orderkey AS id, 'u' || o_orderkey AS url, 'new ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE ' ' END AS body, CASE WHEN o_orderkey % 7 = 0 THEN 'n' END AS author FROM orders WHERE o_orderkey % 5 > 1)"


@query(f"""SELECT id, url, CASE WHEN o.id IS NULL OR fills THEN n.title ELSE o.title END AS title, CASE WHEN o.id IS NULL OR fills THEN n.body ELSE o.body END AS body, CASE WHEN o.id IS NULL THEN n.author WHEN fills THEN coalesce(n.author, o.author) ELSE o.author END AS author,
  CASE WHEN o.id IS NULL THEN trim(n.body) <> '' WHEN fills THEN true ELSE o.ok END AS ok
  FROM (SELECT id, url, o, n, coalesce(n.id IS NOT NULL AND NOT o.ok AND trim(n.body) <> '', false) AS fills FROM {_OLD} o FULL JOIN {_NEW} n USING (id, url))""")  # fmt: skip
def dm_evidence_fill(spark, d):
    i = F.col("o_orderkey")
    key = [i.alias("id"), F.concat(F.lit("u"), i.cast("string")).alias("url")]
    orders = table(spark, d, "orders")
    old = orders.where(i % 5 < 3).select(*key, F.concat(F.lit("old "), i.cast("string")).alias("title"), F.when(i % 3 == 0, "b").alias("body"), F.concat(F.lit("a"), i.cast("string")).alias("author"), (i % 3 == 0).alias("ok"))
    new = orders.where(i % 5 > 1).select(*key, F.concat(F.lit("new "), i.cast("string")).alias("title"), F.when(i % 2 == 0, "new").otherwise(" ").alias("body"), F.when(i % 7 == 0, "n").alias("author"))
    return state.filled_evidence(old, new, ["id", "url"], "ok", "body", keep=["author"])


@query(f"""WITH old AS (SELECT id, status FROM {_CLAIMS} WHERE id % 3 < 2), new AS (SELECT id, 'PENDING' AS status FROM {_CLAIMS} WHERE id % 3 > 0)
  SELECT id, CASE WHEN old.status = 'FINALIZED' THEN old.status ELSE coalesce(new.status, old.status) END AS status FROM old FULL JOIN new USING (id)""")  # fmt: skip
def dm_idempotent(spark, d):
    rows = claims(spark, d).select("id", "status")
    return state.unfinished(rows.where("id % 3 < 2"), rows.where("id % 3 > 0").withColumn("status", F.lit("PENDING")), "id", F.col("status") == "FINALIZED")


_VOTES = "(SELECT event_id, event_type, 'REAL' AS verdict, CASE WHEN event_id % 4 > 0 THEN 'CONFIRMED' END AS source, CASE WHEN event_id % 4 > 0 THEN 'MATCHED' END AS content, CAST(NULL AS VARCHAR) AS date FROM events)"


@query(f"""SELECT v.event_id, CASE WHEN hit AND e.verdict IS NOT NULL THEN e.verdict ELSE v.verdict END AS verdict, CASE WHEN hit THEN coalesce(e.source, v.source) ELSE v.source END AS source,
  CASE WHEN hit AND coalesce(e.source, v.source) IS NOT NULL THEN CASE WHEN coalesce(e.source, v.source) = 'CONFIRMED' THEN coalesce(e.content, v.content) END ELSE v.content END AS content
  FROM {_VOTES} v LEFT JOIN (SELECT event_id, 'FAKE' AS verdict, CASE WHEN event_id % 3 = 0 THEN 'NOT_FOUND' END AS source, CASE WHEN event_id % 3 = 1 THEN 'ALTERED' END AS content FROM events WHERE event_id % 2 = 0) e ON e.event_id = v.event_id,
  LATERAL (SELECT e.event_id IS NOT NULL AND v.event_type <> 'error' AS hit)""")  # fmt: skip
def dm_edit_vote(spark, d):
    i = F.col("event_id")
    events = table(spark, d, "events")
    votes = events.select("event_id", "event_type", F.lit("REAL").alias("verdict"), F.when(i % 4 > 0, "CONFIRMED").alias("source"), F.when(i % 4 > 0, "MATCHED").alias("content"), F.lit(None).cast("string").alias("date"))
    edits = events.where(i % 2 == 0).select("event_id", F.lit("FAKE").alias("verdict"), F.when(i % 3 == 0, "NOT_FOUND").alias("source"), F.when(i % 3 == 1, "ALTERED").alias("content"), F.lit(None).cast("string").alias("date"))
    return state.edited_votes(votes, edits, "event_id", F.col("event_type") != "error").select("event_id", "verdict", "source", "content")


# --- labels and payloads


@query(f"""SELECT id, array_to_string(list_transform(string_split(lower(status), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
  trim('Status: ' || status || '. ' || coalesce('Copy of: ' || duplicate_of || '.', '')) AS reasoning FROM {_CLAIMS}""")  # fmt: skip
def tx_status_labels(spark, d):
    rows = claims(spark, d)
    return rows.select("id", labels.title_case(F.col("status")).alias("label"), labels.reasoning(Status=F.col("status"), Copy_of=F.col("duplicate_of").cast("string")).alias("reasoning"))


@query(f"""SELECT id, CASE status WHEN 'FINALIZED' THEN 'It is review complete. The rest is real.' WHEN 'EXPERT_REVIEW' THEN 'It is awaiting expert review. The rest is real.' ELSE '{labels.LIMITS} The rest is real.' END AS said
  FROM (SELECT id, CASE WHEN status = 'ESCALATED' THEN 'A_CODE' ELSE status END AS status FROM {_CLAIMS}) WHERE status IN ('FINALIZED', 'EXPERT_REVIEW', 'A_CODE')""")  # fmt: skip
def tx_explanation(spark, d):
    status = F.when(F.col("status") == "ESCALATED", "A_CODE").otherwise(F.col("status"))
    rows = claims(spark, d).select("id", status.alias("status")).where(F.col("status").isin("FINALIZED", "EXPERT_REVIEW", "A_CODE"))
    said = F.concat(F.lit("It is "), F.col("status"), F.lit(". It is "), F.col("status"), F.lit(". The rest is REAL."))
    return rows.select("id", labels.readable(said).alias("said"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN 'Image reading attempt 1 timed out.' ELSE 'Image reading attempt 1 failed.' END || '|' ||
  CASE WHEN event_id % 2 = 0 THEN 'Image reading attempt 2 the request was rejected.' ELSE 'Image reading attempt 2 failed.' END AS messages FROM events""")  # fmt: skip
def tx_attempts(spark, d):
    kind = F.col("event_type")
    first = F.when(kind == "view", "success").when(kind == "error", "timeout").otherwise(kind)
    second = F.when(F.col("event_id") % 2 == 0, "permanent_error")
    attempts = F.array(F.struct(F.lit(1).alias("attempt"), first.alias("outcome")), F.struct(F.lit(2).alias("attempt"), second.alias("outcome")))
    said = F.array_join(labels.attempt_messages(attempts), "|")
    return table(spark, d, "events").select("event_id", F.when(kind == "view", F.concat(F.lit("|"), said)).otherwise(said).alias("messages"))


@query("""SELECT p_partkey, sha256('{"body": null, "date": null, "headline": "' || p_name || '", "scope": "HEADLINE_ONLY", "source": "' || lower(p_brand) || '", "v": "2+reader+judge"}') AS card FROM part""")
def hs_card(spark, d):
    return table(spark, d, "part").select("p_partkey", identity.card_hash(F.col("p_name"), F.col("p_brand"), F.lit(None), "2", "reader", "judge").alias("card"))


@query("""SELECT event_id, event_type = 'error' AS daily, CASE WHEN event_id % 3 = 0 THEN event_id % 60 + 0.5::DOUBLE WHEN event_type = 'error' THEN 3600.0::DOUBLE ELSE 60.0::DOUBLE END AS delay FROM events""")
def js_quota(spark, d):
    i, kind = F.col("event_id"), F.col("event_type")
    limit = F.when(kind == "error", "GenerateRequestsPerDay").otherwise("GenerateRequestsPerMinute")
    retry = F.when(i % 3 == 0, F.concat(F.lit(', "retryDelay": "'), (i % 60).cast("string"), F.lit('.5s"'))).otherwise("")
    body = F.concat(F.lit('{"error": {"details": [{"violations": [{"quotaId": "'), limit, F.lit('"}]'), retry, F.lit("}]}}"))
    return table(spark, d, "events").select("event_id", payloads.quota(body).alias("q")).select("event_id", "q.daily", "q.delay")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || '-' || event_id END AS answer FROM events")
def js_parts(spark, d):
    i = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": "hm", "thought": true}, {"text": "'), F.col("event_type"), F.lit('-"}, {"text": "'), i, F.lit('"}]}}, {"content": {"parts": [{"text": "x"}]}}]}'))
    return table(spark, d, "events").select("event_id", payloads.answer_text(F.when(F.col("event_id") % 5 == 0, "no json").otherwise(body)).alias("answer"))


@query("SELECT s_suppkey, s_name || '; S' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '; even' ELSE '' END AS names FROM supplier")
def js_catalogue(spark, d):
    nation = F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))
    given = F.array(F.col("s_name"), nation, F.concat(F.lit(" "), "s_name"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise(" "), nation)
    return table(spark, d, "supplier").select("s_suppkey", payloads.catalogue(given).alias("names"))


_AXES = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'PARTIALLY_TRUE' WHEN 3 THEN 'NOT_FOUND_IN_CLAIMED_SOURCE' END AS label,
  CASE WHEN event_id % 3 = 0 THEN 'MISMATCHED' WHEN event_id % 3 = 1 THEN 'MATCHED' END AS date FROM events)"""


@query(f"""SELECT event_id, source, content, CASE WHEN source = 'NOT_FOUND' THEN 'NOT_FOUND_IN_CLAIMED_SOURCE' WHEN content = 'MATCHED' THEN 'TRUE' WHEN content = 'ALTERED' THEN 'FALSE' END AS back,
  CASE WHEN source = 'NOT_FOUND' THEN 'FAKE' WHEN content = 'ALTERED' THEN 'ALTERED' WHEN date = 'MISMATCHED' THEN 'MISLEADING' ELSE 'REAL' END AS verdict FROM
  (SELECT event_id, date, CASE WHEN label = 'NOT_FOUND_IN_CLAIMED_SOURCE' THEN 'NOT_FOUND' WHEN label IS NOT NULL THEN 'CONFIRMED' END AS source, CASE WHEN label = 'TRUE' THEN 'MATCHED' WHEN label IN ('FALSE', 'PARTIALLY_TRUE') THEN 'ALTERED' END AS content FROM {_AXES})""")  # fmt: skip
def ta_axes(spark, d):
    i = F.col("event_id")
    label = F.when(i % 5 == 0, "TRUE").when(i % 5 == 1, "FALSE").when(i % 5 == 2, "PARTIALLY_TRUE").when(i % 5 == 3, "NOT_FOUND_IN_CLAIMED_SOURCE")
    date = F.when(i % 3 == 0, "MISMATCHED").when(i % 3 == 1, "MATCHED")
    rows = table(spark, d, "events").select("event_id", labels.axes(label).alias("a"), date.alias("date")).select("event_id", "a.source", "a.content", "date")
    return rows.select("event_id", "source", "content", labels.from_axes(F.col("source"), F.col("content")).alias("back"), labels.verdict_of_axes(F.col("source"), F.col("content"), F.col("date")).alias("verdict"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND (s IS NOT NULL OR c IS NOT NULL) THEN 'no axes' WHEN event_type <> 'error' AND s IS DISTINCT FROM 'CONFIRMED' AND c IS NOT NULL THEN 'no source' END AS fault,
  CASE c WHEN 'ALTERED' THEN 'ALTERED' WHEN 'MATCHED' THEN CASE WHEN event_id % 7 = 0 THEN 'EXACT_MATCHED' ELSE 'MEANING_PRESERVED' END END AS headline,
  event_id % 5 > 0 AND event_id % 6 >= event_id % 5 OR event_id % 4 > 0 AND event_id % 3 >= event_id % 4 AS failed FROM
  (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'NOT_FOUND' END AS s, CASE event_id % 4 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'ALTERED' END AS c FROM events)""")  # fmt: skip
def ta_vote_checks(spark, d):
    i = F.col("event_id")
    s, c = F.when(i % 3 == 0, "CONFIRMED").when(i % 3 == 1, "NOT_FOUND"), F.when(i % 4 == 0, "MATCHED").when(i % 4 == 1, "ALTERED")
    kind = F.when(F.col("event_type") == "error", "MULTIMODAL").otherwise("SOURCE_BASED")
    exact = F.when(i % 2 == 0, i % 7 == 0)
    headline = labels.headline_status(c, exact, F.when((i % 7 == 0) & (i % 2 == 1), "exact"), F.lit(None).cast("boolean"))
    return table(spark, d, "events").select("event_id", labels.vote_fault(kind, s, c, F.lit(None).cast("string")).alias("fault"), headline.alias("headline"), labels.retrieval_failed(i % 5, i % 6, i % 4, i % 3).alias("failed"))


@query("""SELECT event_id, coalesce(e >= 0.8 AND coalesce(c, 0) <= 0.2 AND cos >= 0.7, false) AS same, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 'FAKE' ELSE 'REAL' END AS verdict FROM
  (SELECT event_id, event_type, CASE WHEN event_id % 6 > 0 THEN (event_id * 7 % 11) / 10.0::DOUBLE END AS e, CASE WHEN event_id % 4 > 0 THEN (event_id % 5) / 10.0::DOUBLE END AS c, CASE WHEN event_id % 9 > 0 THEN (event_id * 3 % 11) / 10.0::DOUBLE END AS cos FROM events)""")  # fmt: skip
def ta_equivalence(spark, d):
    i, kind = F.col("event_id"), F.col("event_type")
    e, c, cos = F.when(i % 6 > 0, (i * 7 % 11) / F.lit(10.0)), F.when(i % 4 > 0, (i % 5) / F.lit(10.0)), F.when(i % 9 > 0, (i * 3 % 11) / F.lit(10.0))
    prediction = F.when(kind == "view", F.lit(None).cast("string")).when(kind == "error", "FAKE").otherwise("NON_FAKE")
    return table(spark, d, "events").select("event_id", labels.equivalent(e, c, cos).alias("same"), labels.predicted_verdict(prediction).alias("verdict"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN final IS NOT NULL THEN 'Final decision: ' || final END, CASE s WHEN 'NOT_FOUND' THEN 'Not found in the claimed source' WHEN 'INCOMPLETE' THEN 'Source check incomplete' END,
  CASE WHEN s = 'CONFIRMED' THEN 'Headline: ' || coalesce(h, 'No verdict') END], lambda l: l IS NOT NULL), '; ') AS lines,
  CASE WHEN final IS NOT NULL THEN 'final:REAL' WHEN s IS NOT NULL THEN 'preliminary' END AS stage FROM
  (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'INCOMPLETE' END AS s, CASE WHEN event_id % 8 = 0 THEN 'Meaning Preserved' END AS h, CASE WHEN event_id % 5 = 0 THEN 'Real' END AS final FROM events)""")  # fmt: skip
def ta_summary(spark, d):
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    source = F.when(i % 4 == 0, "CONFIRMED").when(i % 4 == 1, "NOT_FOUND").when(i % 4 == 2, "INCOMPLETE")
    final = F.when(i % 5 == 0, "REAL")
    status = F.when(final.isNotNull(), "FINALIZED").otherwise("EXPERT_REVIEW")
    out = labels.summary(F.lit("SOURCE_BASED"), status, source, F.when(i % 8 == 0, "MEANING_PRESERVED"), none, none, none, final)
    return table(spark, d, "events").select("event_id", out.alias("s")).select("event_id", F.array_join("s.lines", "; ").alias("lines"), "s.stage")


# --- pages, names and models' stand-ins

_CLEANED = rf"""regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(string_split({{x}}, chr(10)), lambda l: trim(l) = '' OR length(trim(l)) >= 8 OR NOT regexp_matches(trim(l), '{text.METADATA_LINE.replace("'", "''")}')),
  lambda l: regexp_replace(l, '[ \t]+', ' ', 'g')), chr(10)), '\n(?:[ \t]*\n){{{{2,}}}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')""".replace("{{{{", "{").replace("}}}}", "}").replace("{{x}}", "{x}")


def _without_boilerplate(column: str) -> str:
    out = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for pattern in text.BOILERPLATE:
        out = f"regexp_replace({out}, '(?i){pattern}', '', 'g')"
    return out


@query("SELECT doc_id, CASE WHEN length(t) >= 100 THEN sha256(t) END AS cleaned FROM (SELECT doc_id, " + _CLEANED.replace("{x}", _without_boilerplate("text")) + " AS t FROM documents)")
def tx_clean_extracted(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.sha2(text.clean_extracted(F.col("text")), 256).alias("cleaned"))


@query()
def ht_records(spark, d):
    rows = html.records(spread(table(spark, d, "pages")), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return rows.select("page_id", "title", F.length("body").alias("body_chars"), F.array_join("headlines", "|").alias("headlines"))


_MENTIONS = f"list_distinct(regexp_extract_all({{c}}, '{entities.MENTION.replace('{', '{{').replace('}', '}}')}', 1))"


@query(f"SELECT doc_id, len({_MENTIONS.format(c='text')}) AS names FROM documents")
def ud_mentions(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.size(entities.mentions(F.col("text"))).cast("long").alias("names"))


_KEY = "' ' || array_to_string(regexp_extract_all(lower({c}), '[ঀ-৿0-9a-z]+'), ' ') || ' '"


@query(rf"""WITH p AS (SELECT item_id, doc_id, list_transform({_MENTIONS.format(c="source")}, lambda m: {_KEY.format(c="m")}) AS keys, {_KEY.format(c="source")} AS t, {_MENTIONS.format(c="claim")} AS ms FROM {_PAIRS}),
  m AS (SELECT item_id, doc_id, keys, t, unnest(ms) AS m FROM p),
  k AS (SELECT *, {_KEY.format(c="m")} AS k, contains(trim({_KEY.format(c="m")}), ' ') AS several FROM m),
  h AS (SELECT *, len(list_filter(keys, lambda e: contains(e, k) AND e <> k)) AS holding, len(list_filter(keys, lambda e: contains(k, e) AND e <> k AND trim(e) <> '')) AS held,
    len(list_filter(keys, lambda e: contains(k, e) AND e <> k AND contains(trim(e), ' '))) AS long_held FROM k)
  SELECT item_id, doc_id, m AS mention, CASE WHEN trim(k) = '' THEN 'unmatched' WHEN list_contains(keys, k) THEN 'exact' WHEN several AND (holding > 0 OR long_held > 0) THEN 'span'
    WHEN NOT several AND holding > 0 THEN 'ambiguous' WHEN contains(t, k) THEN 'text' WHEN several AND held > 0 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM h""")  # fmt: skip
def ta_entities(spark, d):
    rows = pairs(spark, d).select("item_id", "doc_id", text.nfc(F.col("claim")).alias("claim"), text.nfc(F.col("source")).alias("source"))
    return rows.select("item_id", "doc_id", F.explode(entities.matches(F.col("claim"), F.col("source"))).alias("m")).select("item_id", "doc_id", "m.mention", "m.status")


@query(f"""SELECT item_id, doc_id, round(CASE WHEN a = b THEN 0.97 ELSE 0.9 * held END, 6) AS entailment, round(CASE WHEN a = b THEN 0.01 ELSE 0.1 * (1 - held) END, 6) AS contradiction, round(held + 0.1 / len(b), 6) AS rerank
  FROM (SELECT item_id, doc_id, a, b, len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(a)) AS held FROM {_PAIRS})
  WHERE len(list_filter(a, lambda t: t IN ('not', 'no', 'never'))) % 2 = len(list_filter(b, lambda t: t IN ('not', 'no', 'never'))) % 2""")  # fmt: skip
def ud_models(spark, d):
    # Staged: the test would else become a key of the join of items and documents, worked out from the texts again and again.
    rows = staged(pairs(spark, d).select("item_id", "doc_id", "a", "b"), "pairs").where(text.negated(F.col("a")) == text.negated(F.col("b")))
    rows = rows.select("item_id", "doc_id", similarity.entailment(F.col("b"), F.col("a")).alias("n"), similarity.rerank_score(F.col("a"), F.col("b")).alias("rerank"))
    return rows.select("item_id", "doc_id", F.round("n.entailment", 6).alias("entailment"), F.round("n.contradiction", 6).alias("contradiction"), F.round("rerank", 6).alias("rerank"))


@query()
def ud_indel(spark, d):
    rows = pairs(spark, d)
    return rows.select("item_id", "doc_id", F.round(similarity.indel_ratio(similarity.edit_form(F.col("claim")), similarity.edit_form(F.col("source"))), 6).alias("ratio"))
