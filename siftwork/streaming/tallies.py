"""Consensus kept as votes come in, and what follows from a decision.

A claim's state is its tally per verdict, in millionths of a weight so that sums don't depend on their order, and each
voter's last vote. A batch reads the state of the claims that it touches and no earlier vote; a claim that a third of all
votes go to reads one voter's entry per vote, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftwork.operators.votes import Consensus
from siftwork.streaming.watching import stateful

MILLION = 1_000_000


@dataclass(frozen=True)
class Limits:
    """After so many votes or hours since it was opened a claim without consensus is escalated; None is no limit."""

    votes: int | None = None
    hours: float | None = None


def _decision(tally: dict[str, int], voters: int, rule: Consensus) -> tuple[int, int, str | None, bool]:
    """(top, next, leader, passes) in millionths, as votes.consensus has them."""
    top, second = (sorted(tally.values(), reverse=True) + [0, 0])[:2]
    leader = next((v for v, w in tally.items() if w == top), None) if top > second else None
    passes = leader is not None and top >= round(rule.least_weight * MILLION) and voters >= rule.least_voters and top - second >= round(rule.lead * MILLION)
    return top, second, leader, passes


OUT = "claim string, what string, at timestamp, voter string, voters long, top_weight double, next_weight double, leader string, passes boolean, correct boolean"


class Tally(StatefulProcessor):
    """Rows out: tally (once per touched claim and batch), finalized or escalated (once), review (a voter of a finalized claim)."""

    def __init__(self, rule: Consensus, limits: Limits, closes: bool):
        self.rule, self.limits, self.closes = rule, limits, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "status string, voters long, deadline long, verdicts array<string>, weights array<long>")
        self.voters = handle.getMapState("voters", "voter string", "verdict string, weight long")

    def _row(self, key, what: str, at: int, tally: dict, voters: int, voter: str | None = None, correct: bool | None = None) -> Row:
        import datetime as dt

        top, second, leader, passes = _decision(tally, voters, self.rule)
        return Row(claim=key[0], what=what, at=dt.datetime.fromtimestamp(at / 1000), voter=voter, voters=voters, top_weight=top / MILLION, next_weight=second / MILLION, leader=leader, passes=passes, correct=correct)

    def _load(self) -> tuple[str, int, int | None, dict[str, int]]:
        found = self.claim.get()
        return ("OPEN", 0, None, {}) if found is None else (*found[:3], dict(zip(found[3], found[4])))

    def _save(self, status: str, voters: int, deadline: int | None, tally: dict[str, int]) -> None:
        self.claim.update((status, voters, deadline, list(tally), list(tally.values())))

    def _judge(self, key, status: str, voters: int, tally: dict, at: int, over: bool) -> tuple[str, list[Row]]:
        """A claim's next status: finalized if there is a consensus, else escalated if it is over a limit."""
        if _decision(tally, voters, self.rule)[3]:
            leader = _decision(tally, voters, self.rule)[2]
            rows = [self._row(key, "finalized", at, tally, voters)]
            rows += [self._row(key, "review", at, tally, voters, voter[0], vote[0] == leader) for voter, vote in self.voters.iterator()]
            return "FINALIZED", rows
        if over:
            return "ESCALATED", [self._row(key, "escalated", at, tally, voters)]
        return status, []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, voters, deadline, tally = self._load()
        at = None
        for r in sorted(rows, key=lambda r: (r["millis"], r["voter"] or "")):
            at = r["millis"]
            if status == "OPEN" and deadline is not None and deadline < at:  # it ran out before, whichever batch that was
                status, out = self._judge(key, status, voters, tally, deadline, True)
                yield from out
            if self.closes and status != "OPEN":
                continue
            if r["voter"] is None:  # the claim is opened
                if self.closes and self.limits.hours is not None:
                    deadline = at + round(self.limits.hours * 3_600_000)
                    self.handle.registerTimer(deadline)
                continue
            old = self.voters.getValue((r["voter"],)) if self.voters.containsKey((r["voter"],)) else None
            if old is None:
                voters += 1
            elif old[0] is not None:
                tally[old[0]] -= old[1]
            weight = round((r["weight"] or 0.0) * MILLION)
            self.voters.updateValue((r["voter"],), (r["verdict"], weight))
            if r["verdict"] is not None:
                tally[r["verdict"]] = tally.get(r["verdict"], 0) + weight
            if self.closes:
                status, out = self._judge(key, status, voters, tally, at, self.limits.votes is not None and voters >= self.limits.votes)
                yield from out
        self._save(status, voters, deadline, tally)
        yield self._row(key, "tally", at, tally, voters)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, voters, deadline, tally = self._load()
        if status == "OPEN":
            status, out = self._judge(key, status, voters, tally, expiredTimerInfo.getExpiryTimeInMs(), True)
            self._save(status, voters, deadline, tally)
            yield from out


def tallied(votes: DataFrame, rule: Consensus = Consensus(), limits: Limits = Limits(), closes: bool = True, late: str = "0 seconds") -> DataFrame:
    """A stream of votes (claim, voter, verdict, weight, at) as rows of OUT; a row without voter opens its claim.

    A voter's later vote takes the place of the earlier one, and a null verdict counts the voter alone. Where closes is set, a claim
    takes no votes once it is finalized or escalated. Votes behind the watermark are lost.
    """
    stateful(votes.sparkSession)
    rows = votes.select(F.col("claim").cast("string").alias("claim"), F.col("voter").cast("string").alias("voter"), F.col("verdict").cast("string").alias("verdict"), F.col("weight").cast("double").alias("weight"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.where("claim IS NOT NULL AND at IS NOT NULL").withColumn("millis", F.unix_millis("at")).withWatermark("at", late)
    return rows.groupBy("claim").transformWithState(statefulProcessor=Tally(rule, limits, closes), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def _version(spark: SparkSession, folder: str, before: int) -> str | None:
    """The newest version of a table of versions that is older than a batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    older = [n for n in numbers if n < before]
    return f"{folder}/batch={max(older)}" if older else None


def cascade(votes: DataFrame, folder: str, checkpoint: str, rule: Consensus = Consensus(), limits: Limits = Limits(), least_decided: int = 10) -> StreamingQuery:
    """Follow tallied() into tables under folder, a batch at a time; a batch that runs again writes the same.

    claims: finalized and escalated claims; reviews: their voters with correct; reviewers: per voter decided, correct and
    score (null below least_decided), each version made from the one before and the batch's reviews.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            decided = rows.where("what IN ('finalized', 'escalated')").select("claim", F.upper("what").alias("status"), "leader", "voters", "top_weight", "next_weight", "at")
            decided.write.mode("overwrite").parquet(f"{folder}/claims/batch={number}")
            reviews = rows.where("what = 'review'").select("claim", "voter", "correct")
            reviews.write.mode("overwrite").parquet(f"{folder}/reviews/batch={number}")
            new = reviews.groupBy("voter").agg(F.count("*").alias("decided"), F.count_if("correct").alias("correct"))
            if old := _version(spark, f"{folder}/reviewers", number):
                new = new.unionByName(spark.read.parquet(old).select("voter", "decided", "correct")).groupBy("voter").agg(F.sum("decided").alias("decided"), F.sum("correct").alias("correct"))
            score = F.when(F.col("decided") >= least_decided, F.round(F.col("correct") / F.col("decided"), 6))
            new.withColumn("score", score).write.mode("overwrite").parquet(f"{folder}/reviewers/batch={number}")
        finally:
            rows.unpersist()

    return tallied(votes, rule, limits).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
