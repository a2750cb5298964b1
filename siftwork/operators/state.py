"""State changes as DataFrames: a table and what happens to it in, the new table out.

Parquet has no row updates: each function gives the whole new table, which one writer puts in place of the old. All of
them change nothing when run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """rows with values where condition holds (a compare-and-set if condition names the allowed states)."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_nulls: bool = True) -> DataFrame:
    """old with rows of new in place of those of equal key; null values of new keep the old ones."""
    others = [c for c in old.columns if c not in keys]
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    pick = lambda c: (F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if keep_old_nulls else F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))) if c in new.columns else F.col(f"a.{c}")
    return a.join(b, keys, "full").select(*keys, *[pick(c).alias(c) for c in others])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old doesn't have, one per key."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def delete_missing(old: DataFrame, submitted: DataFrame, key: str) -> DataFrame:
    """Rows of old that aren't in submitted: those to delete."""
    return old.join(submitted.select(key), key, "left_anti")


def claimable(now: Column, stale_seconds: int = 120) -> Column:
    """Queued jobs, and running ones whose lock is older than stale_seconds."""
    stale = (F.col("status") == "RUNNING") & (F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(stale_seconds)))
    return (F.col("status") == "QUEUED") | F.coalesce(stale, F.lit(False))


def claim_next(jobs: DataFrame, now: Column, lane: str, n: int, stale_seconds: int = 120) -> DataFrame:
    """The n oldest claimable jobs of each lane, locked and with one attempt more."""
    order = Window.partitionBy(lane).orderBy("created_at", "id")
    free = jobs.where(claimable(now, stale_seconds)).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")
    return free.withColumns({"status": F.lit("RUNNING"), "attempts": F.col("attempts") + 1, "locked_at": now})


def release_or_fail(jobs: DataFrame, failed: Column, most_attempts: int = 3) -> DataFrame:
    """Failed jobs are queued again until their attempts are used up."""
    status = F.when(F.col("attempts") >= most_attempts, "FAILED").otherwise("QUEUED")
    return set_where(jobs, failed, status=status, locked_at=F.lit(None).cast("timestamp_ntz"))


def due_deliveries(claims: DataFrame, delivered: DataFrame, keys: list[str], order: list[Column], most: int = 100) -> DataFrame:
    """The oldest claims that have no delivery marker of their keys yet."""
    return claims.join(delivered.select(*keys).distinct(), keys, "left_anti").orderBy(*order).limit(most)


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent wasn't deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def updated_from(rows: DataFrame, source: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """rows with values, which may name columns of source, where source has the key (an update from a join)."""
    mine = {c: F.col(f"a.{c}") for c in rows.columns}
    joined = rows.alias("a").join(source.withColumn("_hit", F.lit(True)).alias("b"), keys, "left")
    return joined.select(*[F.when(F.col("_hit"), values[c]).otherwise(mine[c]).alias(c) if c in values else (F.col(c) if c in keys else mine[c]) for c in rows.columns])


def scored(profiles: DataFrame, total: str, correct: str, score: str, least: int) -> DataFrame:
    """profiles with score worked out anew: the share of correct votes once there are enough, else null."""
    return profiles.withColumn(score, F.when((F.col(total) > 0) & (F.col(total) >= least), F.try_divide(F.col(correct).cast("double"), F.nullif(F.col(total), F.lit(0)))))


def filled_evidence(old: DataFrame, new: DataFrame, keys: list[str], success: str, body: str, keep: list[str]) -> DataFrame:
    """old with new rows; an old row is filled only if nothing was extracted yet and new has a body, and keeps values that new lacks."""
    others = [c for c in old.columns if c not in keys and c != success]
    fills = F.col("_new") & ~F.coalesce(F.col(f"a.{success}"), F.lit(False)) & (F.coalesce(F.trim(F.col(f"b.{body}")), F.lit("")) != "")
    fresh = F.col("_old").isNull()
    value = lambda c: F.when(fresh, F.col(f"b.{c}")).when(fills, F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in keep else F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    joined = old.withColumn("_old", F.lit(True)).alias("a").join(new.withColumn("_new", F.lit(True)).alias("b"), keys, "full")
    done = F.when(fresh, F.coalesce(F.trim(F.col(f"b.{body}")), F.lit("")) != "").when(fills, F.lit(True)).otherwise(F.col(f"a.{success}"))
    return joined.select(*[F.col(c) if c in keys else done.alias(c) if c == success else value(c).alias(c) for c in old.columns if c in keys or c == success or c in others])


def unfinished(old: DataFrame, new: DataFrame, key: str, finished: Column) -> DataFrame:
    """old with rows of new in place of those of equal key, but for finished ones, which nothing touches."""
    open_ = new.join(old.where(finished).select(key), key, "left_anti")
    return upsert(old, open_, [key])


def edited_votes(votes: DataFrame, edits: DataFrame, key: str, editable: Column) -> DataFrame:
    """votes with edits (key and the columns verdict, source, content, date) where editable; null edits keep the old value.

    Content and date fall away where the source isn't confirmed; a vote without findings and without new ones stays so.
    """
    axes = ("verdict", "source", "content", "date")
    joined = votes.withColumn("_may", editable).alias("a").join(edits.select(key, *axes).withColumn("_edit", F.lit(True)).alias("b"), key, "left")
    hit = F.col("_edit") & F.coalesce(F.col("_may"), F.lit(False))
    merged = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in axes}
    kept = merged["source"].eqNullSafe(F.lit("CONFIRMED"))
    new = merged | {c: F.when(merged["source"].isNull(), F.col(f"a.{c}")).when(kept, merged[c]) for c in ("content", "date")}
    return joined.select(*[F.col(c) if c == key else F.when(hit, new[c]).otherwise(F.col(f"a.{c}")).alias(c) if c in axes else F.col(f"a.{c}") for c in votes.columns])
