"""Reports, joins, votes, pages and state changes over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.dates import on_days, retry_delay
from siftwork.operators import ranking, search, state, votes
from siftwork.operators.decisions import adequate
from siftwork.sources.tables import one, table

QUERIES, SQL = {}, {}
#: Weight tiers by accuracy per cent; shared borders go to the lower tier.
TIERS = [(0.0, 40.0, 0.5, "low"), (40.0, 70.0, 1.0, "middle"), (70.0, 90.0, 1.5, "high"), (90.0, 100.0, 2.0, "top")]
_TIER_ROWS = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE, '{n}')" for a, b, w, n in TIERS)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "low double, high double, weight double, label string")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10")
def ag_top_sources(spark, d):
    rows = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "source").limit(10)


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS open,
  count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS large, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'error')) AS closed,
  round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS mean_purchase, count(DISTINCT user_id) AS users FROM events""")  # fmt: skip
def ag_public_stats(spark, d):
    e, kind = table(spark, d, "events"), F.col("event_type")
    return e.agg(
        F.count("*").alias("total"), F.count_if(kind == "error").alias("failed"), F.count_if(kind.isin("view", "click")).alias("open"),
        F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("large"), F.count_if(~kind.isin("view", "click", "error")).alias("closed"),
        F.round(F.avg(F.when(kind == "purchase", F.col("value"))), 6).alias("mean_purchase"), F.count_distinct("user_id").alias("users"),
    )


@query("""SELECT source, count(*) AS total, count(quality) AS finalized, count(*) - count(quality) AS review, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")  # fmt: skip
def ag_explorer_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("finalized"), (F.count("*") - F.count("quality")).alias("review"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT o_orderstatus, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def ag_distinct_under_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey")
    joined = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count_distinct("o_orderkey").alias("orders"), F.count("l_orderkey").alias("lines"))


@query("""SELECT s_suppkey, s_name, CAST(last AS VARCHAR)[1:10] AS last_day FROM supplier LEFT JOIN
  (SELECT l_suppkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey
  ORDER BY last DESC NULLS LAST, s_name LIMIT 12""")  # fmt: skip
def ag_last_activity_per_user(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.orderBy(F.desc_nulls_last("last"), "s_name").limit(12).select("s_suppkey", "s_name", F.date_format("last", "yyyy-MM-dd").alias("last_day"))


_REVIEWS = "(SELECT l_suppkey AS reviewer, l_linestatus AS vote, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS final FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_ACCURACY = f"(SELECT reviewer, count(final) AS decided, count(*) FILTER (WHERE vote = final) AS correct, count(*) FILTER (WHERE vote = final)::DOUBLE / nullif(count(final), 0) AS accuracy FROM {_REVIEWS} GROUP BY reviewer)"


def _accuracy(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("reviewer"), F.col("l_linestatus").alias("vote"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("final"))
    return votes.accuracy(lines.join(orders, "l_orderkey"), "reviewer", F.col("vote"), F.col("final"))


@query(f"SELECT reviewer, decided, correct, round(accuracy, 9) AS accuracy FROM {_ACCURACY}")
def ag_reviewer_accuracy(spark, d):
    return _accuracy(spark, d).withColumn("accuracy", F.round("accuracy", 9))


_TALLY = "(SELECT l_orderkey AS claim, l_returnflag AS verdict, round(sum(l_quantity), 6) AS weight FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT claim, verdict, weight FROM {_TALLY}")
def ag_weighted_tally(spark, d):
    return votes.tally(table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "claim", "l_returnflag": "verdict"}), "claim", "verdict", "l_quantity")


_CONSENSUS = f"""(SELECT claim, voters, top_weight, next_weight, CASE WHEN top_weight > next_weight THEN verdict END AS leader,
  top_weight > next_weight AND top_weight >= 60 AND voters >= 3 AND round(top_weight - next_weight, 6) >= 10 AS passes
  FROM (SELECT claim, verdict, weight AS top_weight, coalesce(lead(weight) OVER w, 0) AS next_weight, row_number() OVER w AS place
        FROM {_TALLY} WINDOW w AS (PARTITION BY claim ORDER BY weight DESC, verdict DESC))
  JOIN (SELECT l_orderkey AS claim, count(DISTINCT l_suppkey) AS voters FROM lineitem GROUP BY 1) USING (claim) WHERE place = 1)"""


def _consensus(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), "l_suppkey", F.col("l_returnflag").alias("verdict"), "l_quantity")
    return votes.consensus(rows, "claim", "l_suppkey", "verdict", "l_quantity", votes.Consensus(60.0, 3, 10.0))


@query(f"SELECT * FROM {_CONSENSUS}")
def ag_consensus(spark, d):
    return _consensus(spark, d)


@query(f"SELECT coalesce(leader, 'tie') AS leader, passes, count(*) AS claims FROM {_CONSENSUS} GROUP BY 1, 2")
def ag_consensus_summary(spark, d):
    return _consensus(spark, d).groupBy(F.coalesce("leader", F.lit("tie")).alias("leader"), "passes").agg(F.count("*").alias("claims"))


@query("SELECT count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') AS in_1997, count(*) AS total FROM orders")
def ag_global_counts(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(on_days(F.col("o_orderdate"), "1997-01-01", "1997-12-31")).alias("in_1997"), F.count("*").alias("total"))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS final,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
  bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY o_custkey""")  # fmt: skip
def ag_user_status_counts(spark, d):
    s = F.col("o_orderstatus")
    counts = [F.count("*").alias("total"), F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("final"), F.count_if(s == "P").alias("pending")]
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").groupBy("o_custkey").agg(*counts, F.count_if(urgent).alias("urgent"), F.bool_or(urgent).alias("any_urgent"))


@query("""SELECT event_type AS stage, count(*) AS n, round(quantile_cont(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.5), 6) AS median,
  max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY 1""")  # fmt: skip
def js_stage_median(spark, d):
    rows = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,int>")).alias("key", "ms"))
    timed = rows.where("key = 'k'").select(F.col("event_type").alias("stage"), "ms")
    return ranking.medians(timed, "stage", "ms").withColumn("median", F.round("median", 6))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS none, '{\"timings\": ' || json_extract_string(props, '$.k') || '}' AS merged FROM events")
def js_props_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"), F.concat(F.lit('{"timings": '), k, F.lit("}")).alias("merged"))


@query("SELECT event_type, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, count(*) AS attempted, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) >= 2 AND sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::DOUBLE / count(*) >= 0.5 AS adequate FROM events GROUP BY 1, 2")
def de_adequacy(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("attempted"))
    return rows.withColumn("adequate", adequate(F.col("attempted"), F.col("attempted") - F.col("failed")))


@query(f"""SELECT reviewer, decided, coalesce(t.label, 'none') AS label, CASE WHEN decided < 10 THEN 1.0::DOUBLE ELSE coalesce(t.weight, 1.0::DOUBLE) END AS weight
  FROM {_ACCURACY} a LEFT JOIN LATERAL (SELECT * FROM (VALUES {_TIER_ROWS}) v(low, high, weight, label) WHERE a.accuracy * 100 >= low AND a.accuracy * 100 <= high ORDER BY low LIMIT 1) t ON true""")  # fmt: skip
def jn_tier_range(spark, d):
    rows = _accuracy(spark, d).withColumn("pct", F.col("accuracy") * 100)
    out = votes.first_range(rows, "pct", tiers(spark), "low", "high")
    return out.select("reviewer", "decided", F.coalesce("label", F.lit("none")).alias("label"), votes.vote_weight(F.col("decided"), F.col("weight")).alias("weight"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)")
def jn_anti_unvoted(spark, d):
    mine = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(mine, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus)")
def jn_not_exists(spark, d):
    marks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(marks, ["o_orderkey", "o_orderstatus"], "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jn_semi_exists(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'A') AS experts,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS admins FROM orders""")  # fmt: skip
def jn_scalar_counts(spark, d):
    admin = F.col("l_returnflag") == "A"
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(~admin).alias("experts"), F.count_if(admin).alias("admins"))
    return table(spark, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("experts", F.lit(0)).alias("experts"), F.coalesce("admins", F.lit(0)).alias("admins"))


@query("""WITH t AS (SELECT doc_id, source, sha256(text) AS h FROM documents), o AS (SELECT h, min(doc_id) AS original FROM t GROUP BY h)
  SELECT t.doc_id, CASE WHEN original < t.doc_id THEN original END AS duplicate_of, s.source AS original_source, coalesce(m.quality, l.quality) AS effective
  FROM t JOIN o USING (h) JOIN documents s ON s.doc_id = original LEFT JOIN labels l ON l.doc_id = t.doc_id LEFT JOIN labels m ON m.doc_id = original""")  # fmt: skip
def jn_self_original(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min_by("source", "doc_id").alias("original_source"), F.min("doc_id").alias("original"))
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.join(first, "h").join(label.withColumnRenamed("quality", "own"), "doc_id", "left")
    rows = rows.join(label.withColumnsRenamed({"doc_id": "original", "quality": "theirs"}), "original", "left")
    return rows.select("doc_id", F.when(F.col("original") < F.col("doc_id"), F.col("original")).alias("duplicate_of"), "original_source", F.coalesce("theirs", "own").alias("effective"))


@query("SELECT event_id, s_name FROM events JOIN supplier ON s_name = 'Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') WHERE event_type = 'error'")
def jn_computed_key(spark, d):
    events = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("s_name"))
    return events.join(table(spark, d, "supplier").select("s_name"), "s_name").select("event_id", "s_name")


@query("SELECT r_name, n_name, g.i AS grp FROM region CROSS JOIN nation CROSS JOIN range(3) g(i)")
def jn_fanout(spark, d):
    regions = table(spark, d, "region").select("r_name")
    return regions.crossJoin(table(spark, d, "nation").select("n_name")).select("r_name", "n_name", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("grp"))


@query("""SELECT o_orderkey, c_name, n_name, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE c_mktsegment END AS verdict
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000""")  # fmt: skip
def jn_left_details(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    rows = table(spark, d, "orders").where("o_totalprice > 300000").join(c, "o_custkey", "left").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", "left")
    return rows.select("o_orderkey", "c_name", "n_name", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("c_mktsegment")).alias("verdict"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('P') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def so_page(spark, d):
    return search.page(table(spark, d, "orders").where(~F.col("o_orderstatus").isin("P")).select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus NOT IN ('P')")
def so_page_count(spark, d):
    return search.page_count(table(spark, d, "orders").where(~F.col("o_orderstatus").isin("P")), 20)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500")
def so_nulls_last(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_last("quality"), "doc_id").limit(500)


@query("""SELECT event_id, event_type FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END,
  CASE WHEN event_type = 'error' THEN ts END ASC NULLS LAST, CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, event_id LIMIT 3000""")  # fmt: skip
def so_case_queue(spark, d):
    error = F.col("event_type") == "error"
    order = [F.when(error, 0).otherwise(1), F.when(error, F.col("ts")).asc_nulls_last(), F.when(~error, F.col("ts")).desc_nulls_last(), F.col("event_id")]
    return table(spark, d, "events").select("event_id", "event_type", "ts").orderBy(*order).limit(3000).select("event_id", "event_type")


@query("""WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_discount AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_partkey, l_linenumber) AS place FROM lineitem)
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, score, place FROM s WHERE place = 1 OR place <= 5 AND score >= 0.05""")  # fmt: skip
def so_topk_floor(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("score"))
    rows = rows.withColumn("tie", F.struct("l_orderkey", "l_partkey", "l_linenumber"))
    return ranking.top_with_floor(rows, "l_suppkey", "score", "tie").drop("tie").withColumn("place", F.col("place").cast("long"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey
  ORDER BY l_returnflag = 'A', l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM lineitem""")  # fmt: skip
def wn_running_number(spark, d):
    rows = table(spark, d, "lineitem")
    order = [F.col("l_returnflag") == "A", *map(F.col, ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))]
    number = ranking.running_number(rows, "l_orderkey", order, F.col("l_returnflag") != "A")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", number.alias("number"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def wn_changes(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return ranking.changes(rows, "user_id", [F.col("ts"), F.col("event_id")], "event_type").drop("ts")


@query("""WITH t AS (SELECT p_size * 2.0::DOUBLE AS low, p_size * 2.0::DOUBLE + count(*) % 4 AS high FROM part GROUP BY p_size),
  o AS (SELECT *, lead(low) OVER (ORDER BY low, high) AS next, row_number() OVER (ORDER BY low, high) = 1 AS opens FROM t)
  SELECT high AS border, unnest(list_filter([CASE WHEN opens AND low <> 2 THEN 'start' END, CASE WHEN next IS NULL AND high <> 102 THEN 'end' END,
    CASE WHEN next > high THEN 'gap' END, CASE WHEN next < high THEN 'overlap' END], lambda x: x IS NOT NULL)) AS fault FROM o""")  # fmt: skip
def wn_tier_gaps(spark, d):
    tiers = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select((F.col("p_size") * F.lit(2.0)).alias("low"), (F.col("p_size") * F.lit(2.0) + F.col("n") % 4).alias("high"))
    return votes.range_faults(tiers, "low", "high", 2.0, 102.0)


_SHARES = "SELECT l_suppkey, round(100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS share FROM lineitem GROUP BY 1"


@query(f"""WITH t AS (SELECT r_regionkey AS tier, 20.0::DOUBLE * r_regionkey AS low, 20.0::DOUBLE * (r_regionkey + 1) AS high, 1.0::DOUBLE + r_regionkey AS weight FROM region),
  good AS (SELECT tier, low, CASE WHEN tier = 1 THEN 50.0::DOUBLE WHEN tier = 2 THEN 60.0::DOUBLE ELSE high END AS high, CASE WHEN tier = 1 THEN 9.0::DOUBLE ELSE weight END AS weight FROM t WHERE tier <> 2
    UNION ALL SELECT 7, 50.0::DOUBLE, 60.0::DOUBLE, 0.5::DOUBLE),
  s AS ({_SHARES})
  SELECT 'tiles' AS change, l_suppkey, (SELECT min_by(tier, low) FROM good WHERE share BETWEEN low AND high) AS tier FROM s
  UNION ALL SELECT 'leaves a gap', l_suppkey, (SELECT min_by(tier, low) FROM t WHERE share BETWEEN low AND high) FROM s""")  # fmt: skip
def dm_tiers(spark, d):
    number = F.col("r_regionkey").cast("int")
    tiers = table(spark, d, "region").select(number.alias("tier"), (number * F.lit(20.0)).alias("low"), ((number + 1) * F.lit(20.0)).alias("high"), (number + F.lit(1.0)).alias("weight"))
    one_wider = spark.createDataFrame([(1, 20.0, 50.0, 9.0), (7, 50.0, 60.0, 0.5)], tiers.schema)
    share = F.round(F.lit(100.0) * F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6)
    shares = table(spark, d, "lineitem").groupBy("l_suppkey").agg(share.alias("share"))
    out = []
    for change, new, gone in (("tiles", one_wider, [2]), ("leaves a gap", one_wider.where("tier = 7"), [2])):
        kept, _ = votes.changed_ranges(tiers, "tier", new, gone, "low", "high")
        out.append(votes.first_range(shares, "share", kept, "low", "high").select(F.lit(change).alias("change"), "l_suppkey", "tier"))
    return out[0].union(out[1])


@query("SELECT event_id, strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d') AS local_day FROM events")
def dt_local_day(spark, d):
    utc = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp(utc, "Asia/Dhaka"), "yyyy-MM-dd").alias("local_day"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def dt_whole_day(spark, d):
    return table(spark, d, "events").where(on_days(F.col("ts"), "2024-01-05", "2024-01-07")).select("event_id")


@query("SELECT event_id, least(3600.0::DOUBLE, 30.0::DOUBLE * pow(2.0::DOUBLE, least(event_id % 10, 7))) AS delay FROM events")
def dt_retry_delay(spark, d):
    return table(spark, d, "events").select("event_id", retry_delay(F.col("event_id") % 10).alias("delay"))


_JOBS = """(SELECT event_id AS id, user_id % 2 AS lane, CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'DONE' END AS status,
  CAST(event_id % 4 AS INTEGER) AS attempts, ts AS created_at, CASE WHEN event_type = 'click' THEN ts END AS locked_at FROM events)"""


def _jobs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "QUEUED").when(kind == "click", "RUNNING").when(kind == "error", "FAILED").otherwise("DONE")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("lane"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.col("ts").alias("created_at"), F.when(kind == "click", F.col("ts")).alias("locked_at"))


@query(f"""SELECT id, lane, 'RUNNING' AS status, CAST(attempts + 1 AS INTEGER) AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY created_at, id) AS place FROM {_JOBS}
  WHERE status = 'QUEUED' OR status = 'RUNNING' AND locked_at < TIMESTAMP '2024-01-15' - INTERVAL 120 SECOND) WHERE place <= 4""")  # fmt: skip
def ss_claim_next(spark, d):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return state.claim_next(_jobs(spark, d), now, "lane", 4).select("id", "lane", "status", "attempts")


@query(f"SELECT id FROM {_JOBS} WHERE status = 'RUNNING' AND locked_at < TIMESTAMP '2024-01-15' - INTERVAL 120 SECOND")
def ss_reclaim_stale(spark, d):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return _jobs(spark, d).where((F.col("status") == "RUNNING") & state.claimable(now)).select("id")


@query(f"SELECT id, CASE WHEN status = 'RUNNING' THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'QUEUED' END ELSE status END AS status FROM {_JOBS}")
def ss_release_or_fail(spark, d):
    return state.release_or_fail(_jobs(spark, d), F.col("status") == "RUNNING").select("id", "status")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' AND NOT EXISTS
  (SELECT 1 FROM events e WHERE e.event_type = 'signup' AND e.user_id = events.user_id AND e.value > 100)) ORDER BY ts, event_id LIMIT 100""")  # fmt: skip
def ss_outbox(spark, d):
    e = table(spark, d, "events")
    done = e.where("event_type = 'signup' and value > 100").select("user_id")
    return state.due_deliveries(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), done, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("""SELECT o_orderkey, n AS votes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'O' AND (coalesce(n >= 6, false) OR date_diff('hour', o_orderdate, TIMESTAMP '2000-01-01') >= 24 * 365 * 3) ORDER BY o_orderdate, o_orderkey LIMIT 50""")  # fmt: skip
def ss_escalation(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("votes"))
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").join(n, "o_orderkey", "left")
    hours = F.timestamp_diff("HOUR", F.col("o_orderdate").cast("timestamp"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return rows.where(votes.overdue(F.col("votes"), hours, 6, 24 * 365 * 3)).orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "votes")


@query("""WITH n AS (SELECT s_suppkey + 50 AS s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '!' END AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier)
  SELECT coalesce(n.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(n.s_name, s.s_name) AS s_name, coalesce(n.s_acctbal, s.s_acctbal) AS s_acctbal
  FROM supplier s FULL JOIN n ON s.s_suppkey = n.s_suppkey""")  # fmt: skip
def dm_upsert(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("!"))).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return state.upsert(old, new, ["s_suppkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_totalprice > 250000 THEN 'E' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def dm_cas(spark, d):
    allowed = F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 250000)
    return state.set_where(table(spark, d, "orders"), allowed, o_orderstatus=F.lit("E")).select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def dm_delete_missing(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return state.delete_missing(rows, rows.where("s_suppkey % 3 = 0"), "s_suppkey")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def dm_cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.cascade(table(spark, d, "lineitem").select("l_orderkey"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("""SELECT min(user_id) AS user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 200 AND event_type = 'click') c
  WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.value > 200 AND e.user_id = c.user_id) GROUP BY user_id, event_type""")  # fmt: skip
def dm_insert_absent(spark, d):
    e = table(spark, d, "events").where("value > 200")
    return state.insert_absent(e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'click'").select("user_id", "event_type"), ["user_id"])


@query("""SELECT 'stored' AS kind, * FROM (SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1)
  UNION ALL SELECT 'default', coalesce(min(o_orderkey), 0), coalesce(min(o_orderpriority), '3-MEDIUM') FROM orders WHERE o_totalprice < 0""")  # fmt: skip
def sc_settings(spark, d):
    orders, columns = table(spark, d, "orders"), ("o_orderkey", "o_orderpriority")
    defaults = {"o_orderkey": 0, "o_orderpriority": "3-MEDIUM"}
    oldest = lambda rows, kind: one(rows, F.struct("o_orderdate", "o_orderkey"), defaults).select(F.lit(kind).alias("kind"), *columns)
    return oldest(orders, "stored").union(oldest(orders.where("o_totalprice < 0"), "default"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_totalprice < 20000 THEN 'price' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'priority' END AS error FROM orders""")
def pf_first_error(spark, d):
    checks = {"price": F.col("o_totalprice") >= 20000, "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")}
    return table(spark, d, "orders").select("o_orderkey", search.first_error(checks).alias("error"))


@query("SELECT CAST(quality AS INTEGER) AS label, CAST(CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS INTEGER) AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def ml_confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(F.col("quality").alias("label"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("pred")).agg(F.count("*").alias("n"))
