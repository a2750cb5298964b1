import duckdb
import pytest

from siftwork.llm import mixing


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(mixing.SQL).fetchall(), key=str)


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mixed_sizes(docs)
    want = oracle(rows)
    assert sorted(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) == want
    return want


def test_documents(spark, documents):
    out = same(spark, [(r.doc_id, r.text, r.source) for r in documents.collect()])
    assert all(taken <= 2 * size for _, size, _, _, taken in out)


def test_water_filling(spark):
    rows = [(s * 1000 + i, " ".join(["w"] * (1 + (i * 7 + s) % 90)), f"s{s}") for s, n in enumerate((400, 20, 60, 200, 5)) for i in range(n)]
    out = same(spark, rows)
    targets = {(s, t) for _, _, s, t, _ in out}
    total = sum(s for s, _ in targets)
    assert sum(t for _, t in targets) == pytest.approx(1.5 * total) and all(t <= 2 * s for s, t in targets)
    for s, t in targets:
        taken = sum(x for _, _, s2, t2, x in out if (s2, t2) == (s, t))
        assert abs(taken - t) <= 90


def test_edges(spark, edges, none):
    same(spark, [(1, None, None), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (4, "z", None), (None, "q q", "a")])
    same(spark, [(1, None, None), (2, " ", "a")])
    assert mixing.mixed_sizes(none).count() == 0
    out = mixing.mixture(edges)
    assert out.columns == edges.columns
    counts = {(r.doc_id): r["count"] for r in out.groupBy("doc_id").count().collect()}
    words = {r.doc_id: (r.taken, r["size"]) for r in mixing.mixed_sizes(edges).collect()}
    assert all(counts.get(d, 0) * (size or 1) >= taken for d, (taken, size) in words.items())


def test_native(documents):
    plan = mixing.mixed_sizes(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
