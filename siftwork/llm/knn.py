"""Exact top-k inner products by a Voronoi join.

1. All rows are grouped by the nearest of CELLS pivots, and each cell is summarised: its rows, its radius R and its largest norm.
   Queries are also grouped more coarsely, by the nearest of GROUPS pivots.
2. Each query is solved in its own cell; its k-th score there is a floor that the final one reaches.
3. The score of q and a row of a cell with pivot p is at most min(q.p + |q| R, |q| norm). Cells whose bound is below the
   floor are skipped whole.
4. Of a cell that queries of a group need, a row x is copied to the group only if its own bound, p.x + r|x| for a group of
   pivot p and radius r, reaches the least floor of these queries. Groups are solved in blocks of queries and rows.

Bounds are computed in double precision with some slack, scores exactly; whatever the pivots, no row of a top k is lost. A
row goes to GROUPS groups at most, however many rows there are; vectors without clusters can't be pruned by any such bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import discard, stored

#: Pivots are a bounded sample; a block is so many queries by so many rows.
CELLS, GROUPS, QUERY_BLOCK, ROW_BLOCK = 64, 16, 1024, 4096
EXACT = float(1 << 53)


def scaled(embedding: str | Column, scale: float = 64.0) -> Column:
    """floor(scale * x) per component as doubles; null for null vectors and those with null or non-finite components."""
    v = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    if not queries.size or not rows.size or np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < EXACT:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and its distance."""
    near = ((pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1)
    return near.astype(np.int32), np.sqrt(((x - pivots[near]) ** 2).sum(1))


def _solved(left: DataFrame, right: DataFrame, sizes: list[tuple[int, int, int]], width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of each query of left (key, query_id, q) within each block of right (key, vec_id, v).

    sizes: (key, queries, rows), a row per key; a key is dealt into blocks, so that no task grows with it.
    """
    blocks = left.sparkSession.createDataFrame([(key, max(1, -(-n // QUERY_BLOCK)), max(1, -(-m // ROW_BLOCK))) for key, n, m in sizes], "key int, qs int, xs int")
    blocks = F.broadcast(blocks)  # CELLS x GROUPS rows at most
    left = left.join(blocks, "key").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    right = right.join(blocks, "key").withColumn("xb", F.pmod(F.xxhash64("vec_id"), F.col("xs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    names = ["query_id", "vec_id", "score"]

    def solve(qs: pa.Table, xs: pa.Table) -> pa.Table:
        ids, x = xs["vec_id"].to_numpy(), _matrix(xs["v"].combine_chunks(), width)
        out = [(np.zeros(0, np.int64),) * 3]
        for at in range(0, qs.num_rows, 256):
            part = qs.slice(at, 256)
            for q, scores in zip(part["query_id"].to_numpy(), _scores(_matrix(part["q"].combine_chunks(), width), x)):
                others = np.flatnonzero(ids != q)
                best = others[_best(ids[others], scores[others], k)]
                out.append((np.full(len(best), q), ids[best], scores[best]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names)

    keys = ["key", "qb", "xb"]
    pairs = left.select(*keys, "query_id", "q").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys))
    return pairs.applyInArrow(solve, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, v array<double> of integers) for which
    queries holds, the k rows of another vec_id with the largest inner product, ties to the smaller vec_id.

    Vectors of different lengths, of any length, compare as if padded with zeros. Null v or vec_id take no part; no rows give
    no rows. Scores beyond 2^63 wrap. Rows that repeat a vec_id are rows of their own. Other columns are dropped. report, if
    given, gets how many rows there are and how many copies of them were made beyond their own cell.
    """
    spark = vectors.sparkSession
    rows, rows_at = stored(vectors.where("v is not null and vec_id is not null").select("vec_id", "v", F.coalesce(queries, F.lit(False)).alias("is_query")), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CELLS).select("v").toPandas()  # CELLS rows
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.unique(np.stack([np.pad(np.array(v, float), (0, width - len(v))) for v in sample["v"]]), axis=0)
    centres = pivots[:: -(-len(pivots) // GROUPS)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            cell, away = _nearest(x, pivots)
            group, reach = _nearest(x, centres)
            norm = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, away, norm, group, reach))], [*batch.schema.names, "cell", "away", "norm", "grp", "reach"])

    dealt, dealt_at = stored(rows.mapInArrow(assign, "vec_id long, v array<double>, is_query boolean, cell int, away double, norm double, grp int, reach double"), "cells")
    summary = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()  # a row per pivot
    radius, largest = np.full(len(pivots), -np.inf), np.zeros(len(pivots))
    for r in summary:
        radius[r["cell"]], largest[r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6, r["norm"] * (1 + 1e-9) + 1e-6

    asked = dealt.where("is_query").select("cell", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "norm", "grp", "reach")
    own, own_at = stored(_solved(asked.withColumnRenamed("cell", "key"), dealt.withColumnRenamed("cell", "key"), [(r["cell"], r["asked"], r["n"]) for r in summary if r["asked"]], width, k), "own")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floors = own.withColumn("_place", F.row_number().over(best)).where(F.col("_place") == k).select("query_id", F.col("score").cast("double").alias("floor"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, norm = _matrix(batch.column("q"), width), batch.column("norm").to_numpy()[:, None]
            floor = batch.column("floor").fill_null(-np.inf).to_numpy()
            bound = np.minimum(q @ pivots.T + norm * radius[None, :], norm * largest[None, :])
            bound[np.arange(len(q)), batch.column("cell").to_numpy()] = -np.inf  # solved already
            bound[:, np.isneginf(radius)] = -np.inf
            i, c = np.nonzero((bound >= (floor - 1e-6 * np.abs(np.where(np.isfinite(floor), floor, 0)) - 1e-3)[:, None]) & ~np.isneginf(bound))
            some = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([some.column("query_id"), some.column("q"), some.column("reach"), pa.array(floor[i]), pa.array(some.column("grp").to_numpy() * len(pivots) + c, pa.int32())], ["query_id", "q", "reach", "floor", "key"])

    sought, sought_at = stored(asked.join(floors, "query_id", "left").mapInArrow(needed, "query_id long, q array<double>, reach double, floor double, key int"), "sought")
    pairs = {r["key"]: r for r in sought.groupBy("key").agg(F.count("*").alias("n"), F.min("floor").alias("floor"), F.max("reach").alias("reach")).collect()}  # CELLS x GROUPS rows at most
    least, reach = np.full((len(centres), len(pivots)), np.inf), np.zeros((len(centres), len(pivots)))
    for key, r in pairs.items():
        at = divmod(key, len(pivots))
        least[at] = r["floor"] - 1e-6 * abs(r["floor"]) - 1e-3 if np.isfinite(r["floor"]) else -np.inf
        reach[at] = r["reach"] * (1 + 1e-9) + 1e-6

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = _matrix(batch.column("v"), width), batch.column("cell").to_numpy()
            bound = centres @ x.T + reach[:, cell] * batch.column("norm").to_numpy()[None, :]
            for g, wanted in enumerate(bound >= least[:, cell]):
                part = batch.filter(pa.array(wanted))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(part.column("cell").to_numpy() + g * len(pivots), pa.int32()), part.column("vec_id"), part.column("v")], ["key", "vec_id", "v"])

    copies, copies_at = stored(dealt.select("vec_id", "v", "cell", "norm").mapInArrow(copied, "key int, vec_id long, v array<double>"), "copies")
    sizes = [(r["key"], pairs[r["key"]]["n"], r["m"]) for r in copies.groupBy("key").agg(F.count("*").alias("m")).collect()]  # CELLS x GROUPS rows at most
    if report is not None:
        report |= {"rows": sum(r["n"] for r in summary), "copies": sum(m for _, _, m in sizes)}
    found, _ = stored(own.union(_solved(sought.select("key", "query_id", "q"), copies, sizes, width, k)), "solved")
    discard(spark, rows_at, dealt_at, own_at, sought_at, copies_at)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """top_k of embeddings (vec_id, embedding) in floor(64 x), for queries whose vec_id is divisible by every."""
    vectors = embeddings.select("vec_id", scaled("embedding").alias("v"))
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(every)) == 0, k)


#: The same rows in DuckDB, over all pairs.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0::DOUBLE * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
