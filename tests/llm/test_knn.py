import numpy as np
import pytest

from siftwork.llm import knn
from siftwork.llm.common import table


def brute(rows, k, every):
    clean = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in clean:
        if q % every == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(v.tolist(), w.tolist()))), i) for i, w in clean if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_embeddings(spark, sf):
    emb = table(spark, sf, "embeddings")
    assert sorted(map(tuple, knn.nearest(emb).collect())) == brute([(r.vec_id, r.embedding) for r in emb.collect()], 20, 20)


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 7)])
def test_ties_clusters_and_bad_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(knn, "QUERY_BLOCK", blocks[0]), monkeypatch.setattr(knn, "ROW_BLOCK", blocks[1]), monkeypatch.setattr(knn, "CELLS", 8), monkeypatch.setattr(knn, "GROUPS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 8 * np.eye(6)[i % 5]).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0] * 6) for i in range(60)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (320, [float("inf")] * 6), (None, [1.0] * 6), (340, []), (360, [2.0, 1.0])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, knn.nearest(emb, k=7, every=20).collect()))
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 7, 20)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, score int"
    assert knn.nearest(spark.createDataFrame([], schema)).count() == 0
    assert knn.nearest(spark.createDataFrame([(20, [1.0], 1)], schema)).count() == 0
    assert knn.nearest(spark.createDataFrame([(20, [1.0], 1), (21, [2.0], 1)], schema)).collect()[0].asDict() == {"query_id": 20, "rank": 1, "vec_id": 21, "score": 64 * 128}
    assert knn.nearest(spark.createDataFrame([(21, [1.0], 1)], schema)).count() == 0


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 32)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=32) * 0.3).tolist()) for i in range(2400)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    report = {}
    vectors = emb.select("vec_id", knn.scaled("embedding").alias("v"))
    got = sorted(map(tuple, knn.top_k(vectors, vectors.vec_id % 80 == 0, 5, report).collect()))
    assert got == brute(rows, 5, 80)
    assert report["rows"] == 2400 and report["copies"] < 2 * 2400  # of 16 groups


def test_repeated_rows(spark):
    rows = [(i // 2, [float(i // 2 % 7), 1.0]) for i in range(120)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.query_id, r.score) for r in knn.nearest(emb, k=6).collect()]
    assert len(got) == 3 * 2 * 6 // 2 and all(s >= 64 * 64 for _, s in got)
