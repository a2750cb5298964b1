"""Classifier outputs and their measures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.vectors import dot

#: A head of more weights than this is refused: it is sent to every worker.
MOST_WEIGHTS = 1 << 24


def softmax_label(vector: Column, weights: list[list[float]], bias: list[float], labels: tuple[str, ...]) -> Column:
    """struct<label, p> of a linear layer with softmax: the label of largest score, and its probability."""
    scores = [dot(vector, F.array(*map(F.lit, w))) + b for w, b in zip(weights, bias)]
    top = F.greatest(*scores)
    label = F.coalesce(*[F.when(s == top, F.lit(name)) for s, name in zip(scores, labels)])
    return F.struct(label.alias("label"), (1 / sum((F.exp(s - top) for s in scores), F.lit(0.0))).alias("p"))


def _head(weights: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scale and shift of the norm, then weights and biases of each layer, from rows (layer, unit, weights, bias)."""
    size = weights.agg(F.sum(F.size("weights"))).first()[0] or 0
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights are more than {MOST_WEIGHTS}")
    layers: dict[int, list] = {}
    for r in weights.orderBy("layer", "unit").collect():  # a row per unit, MOST_WEIGHTS numbers at most
        layers.setdefault(r["layer"], []).append(r)
    units = [(np.array([r["weights"] for r in rows]), np.array([r["bias"] for r in rows])) for _, rows in sorted(layers.items())]
    return [(units[0][0][0], units[0][0][1]), *units[1:]]


def fused_head(rows: DataFrame, first: str, second: str, weights: DataFrame, labels: tuple[str, ...], eps: float = 1e-5) -> DataFrame:
    """rows with label and scores (array<double> in the order of labels) of two vectors end to end: layer norm, dense layers with
    GELU between them, softmax.

    weights: layer, unit, weights, bias; layer 0 has two rows, scale and shift of the norm, the others a row per unit. Layers
    are whole matrices, sent to each worker once and applied to a batch of rows at a time. A null vector, one with null or
    non-finite entries, or two of the wrong length together have neither label nor scores; zeros are a vector like any
    other. Ties go to the first label. Columns label and scores are replaced.
    """
    rows = rows.drop("label", "scores")
    names, head = rows.columns, rows.sparkSession.sparkContext.broadcast(_head(weights))
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "label string", "scores array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        erf = np.frompyfunc(math.erf, 1, 1)
        (scale, shift), *layers = head.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                both = [(a or []) + (b or []) if a is not None and b is not None else [] for a, b in zip(some.column(first).to_pylist(), some.column(second).to_pylist())]
                good = [len(v) == len(scale) and all(c is not None and math.isfinite(c) for c in v) for v in both]
                x = np.array([v for v, g in zip(both, good) if g], float).reshape(-1, len(scale))
                mean = x.mean(1, keepdims=True)
                x = (x - mean) / np.sqrt(((x - mean) ** 2).mean(1, keepdims=True) + eps) * scale + shift
                for i, (w, b) in enumerate(layers):
                    x = x @ w.T + b
                    if i < len(layers) - 1:
                        x = 0.5 * x * (1 + erf(x / math.sqrt(2)).astype(float))
                e = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
                scores = iter((e / e.sum(1, keepdims=True)).tolist() if len(x) else [])
                out = [next(scores) if g else None for g in good]
                picked = [labels[max(range(len(s)), key=s.__getitem__)] if s else None for s in out]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(picked, pa.string()), pa.array(out, pa.list_(pa.float64()))], [*names, "label", "scores"])

    return rows.mapInArrow(run, kinds)


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def measures(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy, and precision, recall and F1 weighted by the labels' rows; a class never predicted has precision 0."""
    cells = confusion(rows, label, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("x"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    by = sides.groupBy("x.c").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), (F.sum("hit") / 2).alias("hits"))
    p, r = F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    by = by.withColumns({"p": p, "r": r}).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    mean = lambda c: F.sum(F.col("support") * F.col(c)) / F.sum("support")
    return by.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))
