"""Polled workers as micro-batches: outbox delivery and escalation, which change nothing when a batch runs again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork.operators.state import insert_absent
from siftwork.operators.votes import Consensus, consensus


def deliver(claims: DataFrame, markers: str, keys: list[str], checkpoint: str, send: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """For each new claim of a stream, one delivery marker per key under markers, and send() of the new ones.

    A batch that runs again finds its markers and writes none. Markers are written before sending would be repeated: a
    send that fails before its markers are written is tried again (at least once).
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = spark.read.schema(rows.select(*keys).schema).option("recursiveFileLookup", "true").parquet(f"{markers}/*") if _exists(spark, markers) else rows.limit(0)
        new = insert_absent(done.select(*keys), rows, keys).select(*keys, F.lit(number).alias("batch"))
        if send:
            send(new)
        new.write.mode("overwrite").parquet(f"{markers}/batch={number}")

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def decide(votes: DataFrame, state: str, checkpoint: str, rule: Consensus = Consensus()) -> StreamingQuery:
    """Keep the consensus of all votes so far under state, once per batch of a stream (claim, voter, verdict, weight)."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{state}/votes/batch={number}")
        everything = spark.read.parquet(f"{state}/votes")
        touched = everything.join(rows.select("claim").distinct(), "claim", "left_semi")
        consensus(touched, "claim", "voter", "verdict", "weight", rule).write.mode("overwrite").parquet(f"{state}/decisions/batch={number}")

    return votes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
