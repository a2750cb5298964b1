"""Whitening of embeddings by TSQR: no covariance is formed to find the components.

1. Each entry becomes an integer, so that n and the sums S per dimension are exact, and so is n * x - S.
2. Each task turns its centred rows, block by block, into one triangular factor R; factors are stacked and factored
   again, FAN at a time, until one is left. Its right singular vectors are the components.
3. Rows are centred, projected and scaled. What was projected is measured: products about each batch's own mean are added
   up, with what the means differ by; a row of at most 8 by 8 numbers, twice, per task.

What goes to the driver is a row of sums per dimension, the last R, and these products, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import stored

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Rows factored at a time; factors stacked at a time.
ROWS, FAN = 4096, 16
#: Entries beyond this size don't become exact integers.
LARGEST = float(1 << 52)


def grid(embedding: Column) -> Column:
    """floor(1024 * x) + 100000 per entry as longs; null for null vectors and those with null, non-finite or huge entries."""
    scaled = F.transform(embedding, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * SCALE >= LARGEST))
    return F.when(embedding.isNotNull() & ~bad, F.transform(scaled, lambda x: x.cast("long") + SHIFT))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Exact:
    """n rows with sums of each dimension: n * x - S without rounding."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.width, self.small = n, len(sums), 2 * n * largest < 1 << 62
        self.sums = np.array(sums, np.int64 if self.small else object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x if self.small else x.astype(object)) * self.n - self.sums

    def means_off(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return self.centred(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 per row."""
        c = self.centred(x)
        if self.small and int(np.abs(c).max(initial=0)) ** 2 * max(1, self.width) < 1 << 63:
            return (c * c).sum(1).tolist()
        return [sum(v * v for v in map(int, row)) for row in c.tolist()]


def totals(rows: DataFrame) -> Exact | None:
    """Exact sums of rows (vec_id, x); None without rows. A task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, None, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), len(batch.column("x")[0]))
                # Halves of 32 bits are summed apart, so that no batch overflows.
                own = [int(h) * (1 << 32) + int(l) for h, l in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                n, sums, largest = n + len(x), own if sums is None else [a + b for a, b in zip(sums, own)], max(largest, int(np.abs(x).max(initial=0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([largest])], ["n", "sums", "largest"])

    per_task = rows.select("x").mapInArrow(run, "n long, sums array<string>, largest long")
    dims = per_task.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    n, largest = per_task.agg(F.sum("n"), F.max("largest")).first()
    if n is None:
        return None
    return Exact(n, [int(r["s"]) for r in dims.orderBy("i").collect()], largest)  # one row per dimension


def factor(rows: DataFrame, exact: Exact, fan: int = FAN) -> np.ndarray:
    """The triangular factor R of all centred rows: one per task, then fan at a time in a tree."""
    d = exact.width

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                r = np.linalg.qr(np.vstack([r, exact.means_off(_matrix(batch.column("x").slice(at, ROWS), d))]), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def merged(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        raw = table.column("r").to_pylist()
        r = np.linalg.qr(np.vstack([np.frombuffer(raw[i], np.float64).reshape(-1, d) for i in order]), "r")
        return pa.table({"part": [int(table.column("part")[0].as_py()) // fan], "r": pa.array([r.tobytes()], pa.binary())})

    level, _ = stored(rows.select("x").mapInArrow(first, "part long, r binary"), "factors")
    while level.count() > 1:  # each round divides the largest number by fan
        level, _ = stored(level.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merged, "part long, r binary"), "factors")
    return np.frombuffer(level.first()["r"], np.float64).reshape(-1, d)


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors of the covariance in columns, their eigenvalues falling, and the trace, from R of n rows."""
    d = r.shape[1]
    _, s, v = np.linalg.svd(np.vstack([r, np.zeros((max(0, d - len(r)), d))]))
    values = s * s / n
    # What is left of a direction without variance is rounding.
    values[s <= s[:1].max(initial=0.0) * np.finfo(float).eps * max(n, d)] = 0.0
    return v[:most].T, values[:most], float((s * s).sum() / n)


def whitened_rows(rows: DataFrame, exact: Exact, vectors: np.ndarray, values: np.ndarray) -> DataFrame:
    """rows (vec_id, x) as vec_id, deviation, whitened array<double>; components without variance are null."""
    root = np.sqrt(np.where(values > 0, values, np.nan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), exact.width)
            w = exact.means_off(x) @ vectors / root
            flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([str(v) for v in exact.deviations(x)], pa.string()), lists], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation string, whitened array<double>")


def identity_error(white: DataFrame, width: int) -> float | None:
    """The largest absolute entry of the covariance of whitened, minus the identity, over components with variance.

    Tasks centre their rows on their own means before they multiply; means and products are added up by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + 2 * width * width)
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column("whitened"), width).astype(np.float64)
                n, mean = len(w), w.mean(0)
                total += np.concatenate(([n], n * mean, ((w - mean).T @ (w - mean)).ravel(), n * np.outer(mean, mean).ravel()))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

    sums = white.select("whitened").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    found = {r["i"]: r["s"] for r in sums.collect()}  # 1 + width + 2 * width^2 rows
    if not found:
        return None
    flat = np.array([found[i] for i in range(len(found))])
    n, mean, (within, between) = flat[0], flat[1 : 1 + width] / flat[0], flat[1 + width :].reshape(2, width, width)
    covariance = within / n + (between / n - np.outer(mean, mean))
    own = np.isfinite(np.diag(covariance))
    return float(np.abs(covariance - np.eye(width))[np.ix_(own, own)].max()) if own.any() else None


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding) on their first components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with null, non-finite or huge entries (2^42 and more) take no part, and neither do vectors shorter
    than the longest one, which have no value in its last dimensions, nor empty ones. Rows that repeat, with or without
    vec_id, count each for itself. A component without variance (fewer rows or dimensions than components, equal vectors)
    has whitened null and explained 0, null where nothing varies at all. Equal eigenvalues may come in either order. A
    deviation that doesn't fit into a long is an error. No rows give no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), grid(F.col("embedding")).alias("x")).where("x IS NOT NULL AND size(x) > 0")
    rows, _ = stored(rows, "grid")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    rows = rows.where(F.size("x") == F.lit(width))
    exact = totals(rows) if width else None
    if exact is None:
        return spark.createDataFrame([], _RESULT)
    vectors_, values, trace = components(factor(rows, exact), exact.n, most)
    white, _ = stored(whitened_rows(rows, exact, vectors_, values), "white")
    error = identity_error(white, len(values))
    parts = [float(v / trace) if trace and math.isfinite(trace) else None for v in values]
    explained = F.element_at(F.array(*[F.lit(p).cast("double") for p in parts]), F.col("component"))
    out = white.select("vec_id", F.posexplode("whitened").alias("place", "whitened"), F.col("deviation").cast("long").alias("deviation")).withColumn("component", F.col("place") + 1)
    return out.select("vec_id", "component", F.lit(exact.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
