"""State changes are idempotent; streams give what tables give."""

import datetime as dt

from pyspark.sql import functions as F

from siftwork.operators import state
from siftwork.sources import tables
from siftwork.streaming import windows, workers


def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")


def jobs(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, "a", "QUEUED", 0, t(9), None), (2, "a", "RUNNING", 1, t(8), t(11)), (3, "a", "RUNNING", 1, t(7), t(11, 59)), (4, "b", "DONE", 1, t(6), None), (5, "b", "RUNNING", 3, t(5), t(10)), (6, "a", "QUEUED", 0, t(10), None)]
    return spark.createDataFrame(rows, "id int, lane string, status string, attempts int, created_at timestamp_ntz, locked_at timestamp_ntz")


def test_claims_and_failures(spark):
    got = state.claim_next(jobs(spark), now(), "lane", 2).orderBy("id").collect()
    assert [(r.id, r.status, r.attempts) for r in got] == [(1, "RUNNING", 1), (2, "RUNNING", 2), (5, "RUNNING", 4)]
    failed = {r.id: r.status for r in state.release_or_fail(jobs(spark), F.col("status") == "RUNNING").collect()}
    assert failed == {1: "QUEUED", 2: "QUEUED", 3: "QUEUED", 4: "DONE", 5: "FAILED", 6: "QUEUED"}


def test_compare_and_set_once(spark):
    rows = spark.createDataFrame([(1, "OPEN"), (2, "DONE"), (3, None)], "id int, status string")
    once = state.set_where(rows, F.col("status") == "OPEN", status=F.lit("ESCALATED"))
    twice = state.set_where(once, F.col("status") == "OPEN", status=F.lit("ESCALATED"))
    assert {r.id: r.status for r in once.collect()} == {r.id: r.status for r in twice.collect()} == {1: "ESCALATED", 2: "DONE", 3: None}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "id int, name string, n int")
    once = state.upsert(old, new, ["id"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", 1), (2, "b", 5), (3, "c", 3)} == {tuple(r) for r in state.upsert(once, new, ["id"]).collect()}
    assert {tuple(r) for r in state.upsert(old, new, ["id"], keep_old_nulls=False).collect()} == {(1, "a", 1), (2, None, 5), (3, "c", 3)}


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "x")], "id int, name string")
    assert [r.row for r in tables.snapshot(rows, "id").collect()] == ['{"id":1,"name":"x"}', '{"id":2,"name":null}']
    path = f"file://{tmp_path}/t"
    rows.write.parquet(path)
    tables.append_new(spark.createDataFrame([(2, "y"), (3, "z"), (3, "z")], "id int, name string"), spark.read.parquet(path), ["id"], path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p1.png").write_bytes(b"\x89PNG\r\n\x1a\n1234")
    (tmp_path / "rows.csv").write_text("image_id,label\np1,1\np2,0\n,1\n")
    got = tables.labelled_images(spark, f"file://{tmp_path}/rows.csv", f"file://{tmp_path}/img", "image_id string, label double").collect()
    assert [(r.image_id, r.label) for r in got] == [("p1", 1)]
    assert spark.read.format("binaryFile").load(f"file://{tmp_path}/img").select(tables.image_type(F.col("content"))).first()[0] == "image/png"


def test_windows_on_a_stream(spark, sf):
    folder = f"{sf}/events.parquet"
    table = spark.read.parquet(folder)
    stream = spark.readStream.schema(table.schema).parquet(sf, pathGlobFilter="events.parquet")
    query = windows.windowed(stream, "6 hours").writeStream.outputMode("append").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.sql("SELECT * FROM tumbling").collect()}
    want = {(r.start, r.event_type): r.n for r in windows.windowed(table, "6 hours").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    # Windows that the last watermark leaves open aren't emitted.
    last = max(k[0] for k in want)
    assert {k for k in want if k not in got} <= {k for k in want if last - k[0] <= dt.timedelta(hours=12)}


def test_first_of_a_key_on_a_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(sf, pathGlobFilter="events.parquet")
    query = windows.once(stream, ["event_id"]).writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT count(*), count(DISTINCT event_id) FROM once").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_deliveries_once(spark, tmp_path):
    source, markers = f"file://{tmp_path}/claims", f"file://{tmp_path}/markers"
    sent = []
    run = lambda n: workers.deliver(spark.readStream.schema("id int, stage string").parquet(source), markers, ["id", "stage"], f"file://{tmp_path}/cp{n}", lambda df: sent.extend(tuple(r)[:2] for r in df.collect())).awaitTermination()
    spark.createDataFrame([(1, "final"), (1, "final"), (2, "first")], "id int, stage string").write.parquet(source)
    run(1)
    spark.createDataFrame([(2, "first"), (2, "final")], "id int, stage string").write.mode("append").parquet(source)
    run(1)
    run(1)
    assert sorted(sent) == [(1, "final"), (2, "final"), (2, "first")]


def test_consensus_of_a_stream(spark, tmp_path):
    source, kept = f"file://{tmp_path}/votes", f"file://{tmp_path}/state"
    schema = "claim int, voter int, verdict string, weight double"
    run = lambda: workers.decide(spark.readStream.schema(schema).parquet(source), kept, f"file://{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([(1, 1, "FAKE", 3.0), (1, 2, "FAKE", 2.0)], schema).write.parquet(source)
    run()
    spark.createDataFrame([(1, 3, "FAKE", 1.0)], schema).write.mode("append").parquet(source)
    run()
    got = {r.batch: r.passes for r in spark.read.parquet(f"{kept}/decisions").collect()}
    assert got == {0: False, 1: True}
