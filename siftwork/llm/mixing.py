"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Only DataFrame functions. Of the documents, sums per source and per (source, hash bucket) are aggregated before any
shuffle; the windows over one source see one row per bucket, and the windows over documents one bucket each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import WORD, discard, stored

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS, STEPS, SEED = 1.5, 2.0, 3, "mix-1"


def size_of(text: str = "text") -> Column:
    """Number of words of a text, null as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place_of(seed: str = SEED) -> Column:
    """A document's place in the seeded order of its source: its md5 as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with target: share of the total by weight, at most epochs times the source.

    Sources in code point order, null last, take the weights in turn. Clamping and sharing again until no target is
    above its cap ends with the sources of the smallest cap per weight clamped; so one pass in that order, with what is
    left for the others at each place, finds the level. There is one row per source.
    """
    everyone = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    rows = rows.withColumn("goal", F.lit(share) * F.sum("source_size").over(everyone))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    clamped = F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("goal") - clamped) / rest)
    level = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(everyone)
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap")).alias("target"))


def _prefixes(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, last): of rows (source, place, doc_id, size, weight) in seeded order, up to where the running weight passes goals.left.

    Only the bucket of a source in which the running size passes is put in order; the others are summed.
    """
    rows = rows.withColumn("bucket", F.substring("place", 1, 3))
    sums = rows.groupBy("source", "bucket").agg(F.sum("weight").alias("bucket_size"))
    ahead = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("ahead", ahead).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_size", "ahead")
    goals = goals.select("source", "left")
    ends = offsets.join(goals, F.col("source").eqNullSafe(F.col("s"))).where("ahead <= left and left <= ahead + bucket_size").select("s", "b", "ahead", "left")
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    running = F.sum("weight").over(Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("running", running).where("ahead + running <= left")
    lasts = inside.groupBy("source").agg(F.max(F.struct("place", "doc_id", "size")).alias("last")).select("source", "last")
    # Where the first row of a bucket is already too much, all before the bucket stay; beyond the last one, all rows.
    upto = ends.groupBy("s").agg(F.max("b").alias("upto"))
    both = goals.join(lasts.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left").join(upto, F.col("source").eqNullSafe(F.col("s")), "left")
    null = F.lit(None).cast("long")
    other = F.struct(F.coalesce("upto", F.lit("g")).alias("place"), null.alias("doc_id"), null.alias("size"))
    return both.select("source", F.coalesce("last", other).alias("last"))


def _own() -> Column:
    return F.struct("place", F.col("doc_id").cast("long").alias("doc_id"), "size")


def _taken(steps: Column) -> Column:
    """Whether one of steps, in turn, takes the row: one that is small enough for what is left, and not above its last."""
    return F.exists(steps, lambda s: (F.col("weight") <= s["left"]) & (_own() <= s["last"]))


def plan(sized: DataFrame, steps: int = STEPS, **settings) -> DataFrame:
    """A row per source of sized (doc_id, source, size, place, weight: the size of all rows alike): source_size, target, whole, steps.

    Every document is taken whole times. Of what whole repetitions leave of the target, documents fill as much as fits
    in seeded order; smaller ones behind them fill what is left then, and again, so that the sum comes near.
    """
    spark = sized.sparkSession
    state = targets(sized.groupBy("source").agg(F.sum("weight").alias("source_size")), **settings)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    state = state.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("steps", F.array().cast("array<struct<left:double,last:struct<place:string,doc_id:bigint,size:bigint>>>"))
    state, path = stored(state, "plan")
    rows = sized.select("source", "place", "doc_id", "size", "weight")
    for _ in range(steps):
        known = state.select(F.col("source").alias("s0"), F.col("left").alias("room"), F.col("steps").alias("taken"))
        open_ = rows.join(known, F.col("source").eqNullSafe(F.col("s0"))).where((F.col("weight") <= F.col("room")) & ~_taken(F.col("taken"))).select("source", "doc_id", "size", "place", "weight")
        lasts = _prefixes(open_, state).select(F.col("source").alias("s1"), "last")
        marked = open_.join(lasts, F.col("source").eqNullSafe(F.col("s1"))).where(_own() <= F.col("last"))
        got = marked.groupBy("source").agg(F.sum("weight").alias("got")).select(F.col("source").alias("s2"), "got")
        joined = state.join(lasts, F.col("source").eqNullSafe(F.col("s1")), "left").join(got, F.col("source").eqNullSafe(F.col("s2")), "left")
        state, new = stored(joined.select("source", "source_size", "target", "whole", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"), F.concat("steps", F.array(F.struct("left", "last"))).alias("steps")), "plan")
        discard(spark, path)
        path = new
    return state


def repetitions(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target and copies, the number of times the mix takes the row.

    docs: doc_id, text, source and any other columns. Null and empty texts have size 0; null is a source of its own,
    after the others. Rows alike in source, doc_id and size, as repeated ones are and those without doc_id can be, are taken
    together, and only where all of them fit, so that no target is passed. Texts may have any length; no rows give no rows.
    """
    rows = docs.withColumns({"_size": size_of(), "_place": place_of()})
    read, at = stored(rows.select("doc_id", "source", F.col("_size").alias("size"), F.col("_place").alias("place")), "sizes")
    keys = ["source", "doc_id", "size", "place"]
    alike = read.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("weight", F.col("size") * F.col("n"))
    sized, sized_at = stored(alike, "alike")
    per_source = plan(sized, **settings)
    # A row per source, small against the documents: Spark chooses the join by its size.
    known = per_source.select(F.col("source").alias("_source"), F.struct("source_size", "target", "whole", "steps").alias("_plan"))
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_weight", F.col("_size"))
    several, _ = stored(sized.where("n > 1 AND size > 0"), "several")
    if not several.isEmpty():
        more = several.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("weight").alias("_all"))
        same = F.col("source").eqNullSafe(F.col("_k_source")) & F.col("doc_id").eqNullSafe(F.col("_k_doc_id")) & (F.col("_size") == F.col("_k_size")) & (F.col("_place") == F.col("_k_place"))
        joined = joined.join(more, same, "left").withColumn("_weight", F.coalesce("_all", "_size")).drop("_all", *[f"_k_{k}" for k in keys])
    discard(docs.sparkSession, at, sized_at)
    own = F.struct(F.col("_place").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"))
    extra = F.exists("_plan.steps", lambda s: (F.col("_weight") <= s["left"]) & (own <= s["last"])).cast("int")
    return joined.withColumns({"_copies": F.col("_plan.whole") + extra})


def mixed_sizes(docs: DataFrame, **settings) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target of its source, taken words."""
    rows = repetitions(docs.select("doc_id", "text", "source"), **settings)
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    rows = repetitions(docs, **settings).where("_copies > 0")
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


#: The same rows in DuckDB.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS place
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal
  FROM per_source),
levels AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN cap > weight * level THEN level END) OVER ()), cap) AS target
  FROM levels),
parts AS (
  SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS BIGINT) AS whole,
         target - CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END * source_size AS part
  FROM targets),
first AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.part,
         sum(size) OVER (PARTITION BY r.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= part AS took1
  FROM sized r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source),
left1 AS (SELECT *, part - coalesce(sum(CASE WHEN took1 THEN size END) OVER (PARTITION BY source), 0) AS rest1 FROM first),
second AS (
  SELECT *, NOT took1 AND size <= rest1 AND
         sum(CASE WHEN NOT took1 AND size <= rest1 THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest1 AS took2
  FROM left1),
left2 AS (SELECT *, rest1 - coalesce(sum(CASE WHEN took2 THEN size END) OVER (PARTITION BY source), 0) AS rest2 FROM second),
third AS (
  SELECT *, NOT took1 AND NOT took2 AND size <= rest2 AND
         sum(CASE WHEN NOT took1 AND NOT took2 AND size <= rest2 THEN size ELSE 0 END)
           OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest2 AS took3
  FROM left2)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN took1 OR took2 OR took3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM third
"""
