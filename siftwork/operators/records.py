"""Records of claims and their owners: states, live tokens, optional joins, feeds, and the tables that a checked claim fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.search import KeywordSearch, all_of

# The states in which a claim is being worked on, reviewed, or done with.
WORKING, REVIEWING, DONE, FAILED = ("PENDING", "PROCESSING"), ("EXPERT_REVIEW", "ESCALATED"), "FINALIZED", "FAILED"


def user_state(status: Column, is_copy: Column, original_status: Column) -> Column:
    """in_progress, review, final or failed, as a claim's owner sees it; null for other states.

    A copy in expert review is final as soon as its original is.
    """
    answered = F.coalesce(is_copy & (status == "EXPERT_REVIEW") & (original_status == DONE), F.lit(False))
    return F.when(status.isin(*WORKING), "in_progress").when(answered | (status == DONE), "final").when(status.isin(*REVIEWING), "review").when(status == FAILED, "failed")


def live(expires: Column, now: Column, *spent: Column) -> Column:
    """Whether a token is still good: not expired, and none of spent (used, revoked) holds; null counts as not."""
    good = [~F.coalesce(s, F.lit(False)) for s in spent]
    return F.coalesce(all_of(expires > now, *good), F.lit(False))


def with_alias(sources: DataFrame, alias: str, aliases: str = "aliases", active: str = "is_active") -> DataFrame:
    """Active sources one of whose aliases is exactly this."""
    return sources.where(F.array_contains(aliases, alias) & F.col(active))


def mentioning(rows: DataFrame, text: str, column: str) -> DataFrame:
    """Rows whose array or struct column holds text anywhere in its JSON, whatever the case."""
    return rows.where(F.contains(F.lower(F.to_json(column)), F.lit(text.lower())))


def source_listing(sources: DataFrame, language: str | None = None, active_only: bool = True) -> DataFrame:
    """Sources, of one language and active ones only where asked for."""
    return sources.where(all_of(F.col("is_active") if active_only else None, F.col("language") == language if language else None))


def claims_with_results(claims: DataFrame, results: DataFrame, key: str, **wanted: str | None) -> DataFrame:
    """claims whose result has the wanted values; results are joined only if a value is given."""
    given = {c: v for c, v in wanted.items() if v is not None}
    if not given:
        return claims
    return claims.join(results.select(key, *given), key).where(all_of(*[F.col(c) == v for c, v in given.items()])).drop(*given)


def history(votes: DataFrame, claims: DataFrame, key: str, query: str | None, columns: list[str]) -> DataFrame:
    """votes on claims that match a search; claims are joined only if there is one."""
    condition = KeywordSearch(query, columns).condition()
    return votes if condition is None else votes.join(claims.where(condition).select(key), key, "left_semi")


def shown_name(name: Column, fallback: str = "A reader") -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(fallback))


def activity(votes: DataFrame, admin: Column, time: str, key: str, seen: Column) -> DataFrame:
    """votes, newest first, with kind (VOTE or ADMIN_DECISION, by a flag: no union) and unread, the number not seen in all."""
    unread = votes.agg(F.count_if(~F.coalesce(seen, F.lit(False))).alias("unread"))
    return votes.withColumn("kind", F.when(admin, "ADMIN_DECISION").otherwise("VOTE")).crossJoin(F.broadcast(unread)).orderBy(F.desc(time), F.desc(key))  # one row


def relevant_first(rows: DataFrame, relevance: str, position: str) -> list[Column]:
    """The order of search results: known relevance before unknown, high before low, then as found."""
    return [F.col(relevance).isNull(), F.desc(relevance), F.col(position)]


def left_join_known(rows: DataFrame, other: DataFrame, key: str, spread: str) -> DataFrame:
    """rows.join(other, key, "left") for an integer key that may be null: rows without one, which would all meet in one task, are dealt by spread."""
    apart = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    same = F.pmod(F.col(key), F.lit(1)).cast("long")  # 0, but not a constant, which would not be a key of the join
    return rows.withColumn("_apart", apart).join(other.withColumn("_apart", same), [key, "_apart"], "left").drop("_apart")


def result_view(results: DataFrame, originals: DataFrame, evidence: DataFrame, key: str, most: int = 5) -> DataFrame:
    """A row per result with its effective verdict (the original's for a copy) and its evidence, ranked, as one array.

    evidence (key, url, score): per key one aggregate of at most the evidence of one claim.
    """
    rank = F.struct((-F.col("score")).alias("by"), F.col("url"))
    ranked = evidence.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(rank)), 1, most).alias("_e"))
    ranked = ranked.select(key, F.transform("_e", lambda e: e["url"]).alias("evidence"))
    theirs = originals.select(F.col(key).alias("duplicate_of"), F.col("verdict").alias("_theirs"))
    rows = left_join_known(results, theirs, "duplicate_of", key).join(ranked, key, "left")
    return rows.withColumns({"verdict": F.coalesce("_theirs", "verdict"), "evidence": F.coalesce("evidence", F.array().cast("array<string>"))}).drop("_theirs")


def persisted(checked: DataFrame) -> dict[str, DataFrame]:
    """The tables that checked claims (id, headline, verdict, content_hash, articles array<struct<url, title, body>>, queries array<string>) fill.

    Keys are made of the claim's id, so that a second run gives the same rows.
    """
    articles = checked.select("id", F.posexplode("articles").alias("place", "a")).select("id", F.sha2(F.lower(F.trim("a.url")), 256).alias("url_hash"), "a.url", F.left("a.title", F.lit(500)).alias("title"), "a.body", F.coalesce(F.trim("a.body") != "", F.lit(False)).alias("extraction_success"))
    return {
        "submissions": checked.select("id", "headline", F.lit("EXPERT_REVIEW").alias("status")),
        "results": checked.select("id", "verdict"),
        "articles": articles.dropDuplicates(["id", "url_hash"]),
        "queries": checked.select("id", F.posexplode("queries").alias("place", "query")),
        "cache": checked.select("content_hash", "id").groupBy("content_hash").agg(F.max("id").alias("id")),
    }


def cached(wanted: DataFrame, cache: DataFrame, key: str, stored_at: str, now: Column, hours: float) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): wanted keys with what the cache holds of them, not older than so many hours, and the distinct rest to work out."""
    fresh = cache.where(F.col(stored_at) >= now - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours * 60) % 60)))
    keys = wanted.select(key).distinct()
    return keys.join(fresh, key), keys.join(fresh.select(key), key, "left_anti")


def markdown(rows: DataFrame, order: list[Column]) -> DataFrame:
    """A small report as the lines (place, line) of a Markdown table; numbers should be rounded beforehand."""
    names = rows.columns
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "place int, line string")
    listed = rows.orderBy(*order).agg(F.collect_list(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names]), F.lit(" |"))).alias("lines"))  # an aggregate's few rows
    return head.union(listed.select(F.posexplode("lines").alias("place", "line")).select((F.col("place") + 2).alias("place"), "line"))
