"""Balanced label propagation: linked documents move towards each other's shards while shards stay even.

Links are given as groups: a group joins all its documents (a plain link is a group of two). Each round, one join brings
the shards of a group's documents together as counts per (group, shard), at most one number per shard; the group then
asks for the shard that holds most of it among those with room. Requests are granted in seeded order of the groups, by
sums per (shard, hash bucket) instead of a list of groups, so that what shards hold of linked documents never exceeds
their quota. Documents without links fill the rest and are moved last, when sizes are made even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import discard, left_join_hot, stored

SHARDS, ROUNDS, BUCKETS, SEED = 24, 6, 256, 17


def _bucket(*columns: str | Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def quotas(rows: int, shards: int) -> list[int]:
    """Rows per shard, at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked (row_id, link, shard) with shard moved towards neighbours; at most quota[i] linked rows in shard i."""
    spark, shards = linked.sparkSession, len(quota)
    now, path = stored(linked, "shards")
    for step in range(rounds):
        counts = now.groupBy("link", "shard").agg(F.count("*").alias("n"))
        held = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        free = [max(0, quota[i] - held.get(i, 0)) for i in range(shards)]
        tie = F.xxhash64("link", "shard", F.lit(SEED))
        # The shard with most of the group; of equal ones, a seeded choice that all members share.
        best = counts.groupBy("link").agg(F.sum("n").alias("size"), F.max(F.struct("n", tie.alias("tie"), "shard")).alias("best"))
        wanted = best.select("link", F.col("best.shard").alias("to"), (F.col("size") - F.col("best.n")).alias("moving"), "size").where("moving > 0")
        # A group that is refused tries another shard in the next round: by rotating among those with room.
        if step:
            open_ = [i for i in range(shards) if free[i] > 0]
            if not open_:
                break
            spread = F.element_at(F.array(*[F.lit(i) for i in open_]), (F.pmod(F.xxhash64("link", F.lit(step)), F.lit(len(open_))) + 1).cast("int"))
            full = F.array(*[F.lit(free[i] == 0) for i in range(shards)])
            blocked = best.select("link", F.col("best.shard").alias("to"), "size", F.col("best.n").alias("n")).where("size > n")
            gone = F.element_at(full, F.col("to") + 1)
            wanted = blocked.select("link", F.when(gone, spread).otherwise(F.col("to")).alias("to"), F.when(gone, F.col("size")).otherwise(F.col("size") - F.col("n")).alias("moving"), "size")
        asked, asked_at = stored(wanted.withColumn("bucket", _bucket("link", F.lit(step))), "wanted")
        sums = asked.groupBy("to", "bucket").agg(F.sum("moving").alias("moving")).orderBy("to", "bucket").collect()  # shards x buckets at most
        granted, left = [], list(free)
        for r in sums:
            part = min(1.0, left[r["to"]] / r["moving"])
            if part > 0:
                granted.append((r["to"], r["bucket"], part))
            left[r["to"]] -= min(left[r["to"]], r["moving"])
        if not granted:
            discard(spark, asked_at)
            break
        may = spark.createDataFrame(granted, "to int, bucket int, part double")
        grants = asked.join(F.broadcast(may), ["to", "bucket"]).select("link", "to", "part", "moving", "size")  # shards x buckets rows
        moved = left_join_hot(now, grants, "link", "size")
        # Of a bucket with too many rows, small groups wait for the next round; of a group that no shard can hold, as
        # many rows go as fit on average, and counts are made exact later.
        large = F.col("moving") > max(1, quota[0] // 4)
        goes = F.col("to").isNotNull() & ((F.col("part") >= 1) | large & (F.pmod(F.xxhash64("row_id", F.lit(step)), F.lit(1 << 20)) < F.col("part") * (1 << 20)))
        after, after_at = stored(moved.select("row_id", "link", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shards")
        discard(spark, path, asked_at)
        now, path = after, after_at
    return now


def numbered(rows: DataFrame, by: str, order: Column, bucket: Column) -> DataFrame:
    """rows with slot, numbered from 0 without gaps within each value of by.

    Rows are put in order within (by, bucket) only, and buckets are joined by the sums of those before them.
    """
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(by, "_bucket", ahead.alias("_ahead"))
    inside = rows.withColumn("_row", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(order)))
    return inside.join(offsets, [by, "_bucket"]).withColumn("slot", (F.col("_ahead") + F.col("_row") - 1).cast("long")).drop("_bucket", "_row", "_ahead")


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (row_id unique, link or null) with shard and slot: counts of shards at most one apart, groups together.

    A group larger than a shard fills what room there is and stays spread beyond it. row_id may be any type.
    """
    spark = rows.sparkSession
    n = rows.count()
    quota = quotas(n, shards)
    start = F.pmod(F.xxhash64("row_id", F.lit(SEED)), F.lit(shards)).cast("int")
    grouped = rows.where("link is not null").select("row_id", "link", start.alias("shard"))
    linked = propagate(grouped, quota, rounds).select("row_id", F.lit(0).alias("rest"), "shard")
    single = rows.where("link is null").select("row_id", F.lit(1).alias("rest"), start.alias("shard"))
    placed, placed_at = stored(linked.union(single), "placed")
    # Linked rows come first, so that rows beyond a quota are single ones as far as there are any.
    spread = F.col("rest") * BUCKETS + _bucket("row_id", F.lit(SEED + 1))
    slots, _ = stored(numbered(placed, "shard", F.struct(F.xxhash64("row_id"), F.col("row_id")), spread), "slots")
    discard(spark, placed_at)
    held = {r["shard"]: r["n"] for r in slots.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over, to, gaps = 0, 0, []
    for i in range(shards):
        if (missing := quota[i] - held.get(i, 0)) > 0:
            gaps.append((i, to, to + missing, held.get(i, 0)))
            to += missing
    starts = []
    for i in range(shards):
        starts.append((i, quota[i], over))
        over += max(0, held.get(i, 0) - quota[i])
    limits = spark.createDataFrame(starts, "shard int, quota long, first long")
    rows_ = slots.join(F.broadcast(limits), "shard")  # one row per shard
    stay = rows_.where("slot < quota").select("row_id", "shard", "slot")
    spill = rows_.where("slot >= quota").select("row_id", (F.col("first") + F.col("slot") - F.col("quota")).alias("at"))
    holes = spark.createDataFrame(gaps, "shard int, low long, high long, used long")
    moved = spill.join(F.broadcast(holes), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))  # one row per shard
    return stay.union(moved.select("row_id", "shard", (F.col("used") + F.col("at") - F.col("low")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: shard counts are at most one apart. Linked are documents of equal text (null texts with each
    other, empty ones too). Null texts have size 8 and the checksum of no bytes. Rows that repeat a doc_id and its text
    are told apart by a running number; a null doc_id is a value like another. Texts of any length count by size and
    digest only; ties are broken by hashes of the rows. No rows give no rows; other columns are dropped.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(F.concat(body, F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.lit("+")).cast("binary"))).alias("digest"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(0)))
    base, base_at = stored(rows.withColumn("copy", copy), "rows")
    shared, shared_at = stored(base.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", "n", F.lit(True).alias("linked")), "shared")
    keyed = left_join_hot(base, shared, "digest", "n").select(F.struct("doc_id", "copy", "size", "text_crc32", "digest").alias("row_id"), F.when(F.col("linked"), F.col("digest")).alias("link"))
    kept, _ = stored(keyed, "keyed")
    discard(docs.sparkSession, base_at, shared_at)
    out = balanced_shards(kept, shards, rounds)
    return out.select("row_id.doc_id", "row_id.size", "row_id.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
