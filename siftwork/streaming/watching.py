"""Items that are checked again and again until they are settled, as keyed state with event-time timers.

An item's state is one value: when it began, its status, what was notified last, failures in a row, and its next check.
Timers only wake an item up; what falls due before an event is worked out before it, so that the rows don't depend on
how the events are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Statuses after which nothing more happens, and those with a result to read.
TERMINAL, READY = ("FINALIZED", "FAILED", "CANCELLED"), ("EXPERT_REVIEW", "ESCALATED")


@dataclass(frozen=True)
class Schedule:
    """When items are checked: seconds after a status, after the n-th failure in a row, and until an unsettled item expires."""

    delays: dict[str, int | None] = field(default_factory=dict)
    otherwise: int | None = 30
    backoff: int = 30
    most: int = 300
    doublings: int = 4
    expiry: int | None = 600
    settled: tuple[str, ...] = TERMINAL + READY
    forget: int = 86_400

    def delay(self, status: str | None) -> int | None:
        return self.delays.get(status, self.otherwise)

    def retry(self, failures: int) -> int:
        return min(self.most, self.backoff * 2 ** min(failures, self.doublings))


#: A client that polls its submissions, and the queue of result mails.
POLLING = Schedule({**dict.fromkeys(TERMINAL, 600), **dict.fromkeys(READY, 300)})
MAILS = Schedule({"sent": None, "skipped": None}, otherwise=0, most=3600, doublings=7, expiry=None, settled=("sent", "skipped"))

_STATE = "began long, seen long, status string, notified string, failures int, next long, done boolean"
OUT = "id string, at timestamp, what string, status string, stage string"


class Watch(StatefulProcessor):
    """Rows out: check (due now), notify (a stage, once), expired (not settled in time), settled, forgotten."""

    def __init__(self, schedule: Schedule):
        self.schedule = schedule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("item", _STATE)

    def _due(self, s: dict, until: int, out: list) -> bool:
        """Work out what falls due before until, in milliseconds; whether the item is still known."""
        plan = self.schedule
        while True:
            expires = s["began"] + plan.expiry * 1000 if plan.expiry is not None and not s["done"] else None
            gone = s["seen"] + plan.forget * 1000
            times = [t for t in (s["next"], expires, gone) if t is not None]
            at = min(times)
            if at >= until:
                return True
            if at == gone:
                out.append((at, "forgotten", s["status"], s["notified"]))
                return False
            if at == expires:
                s.update(done=True, status="FAILED", next=None)
                out.append((at, "expired", "FAILED", s["notified"]))
            else:
                s["next"] = None
                out.append((at, "check", s["status"], s["notified"]))

    def _event(self, s: dict | None, e: Row, at: int, out: list) -> dict | None:
        if e["kind"] == "deleted":
            if s:
                out.append((at, "forgotten", s["status"], s["notified"]))
            return None
        s = s or {"began": at, "seen": at, "status": None, "notified": None, "failures": 0, "next": None, "done": False}
        s["seen"] = at
        if e["kind"] == "failure":
            s["failures"] += 1
            s["next"] = None if s["done"] and self.schedule.delay(s["status"]) is None else at + self.schedule.retry(s["failures"]) * 1000
            return s
        wait = self.schedule.delay(e["status"])
        s.update(status=e["status"], failures=0, next=None if wait is None else at + wait * 1000)
        if e["status"] in self.schedule.settled and not s["done"]:
            s["done"] = True
            out.append((at, "settled", s["status"], e["stage"]))
        if e["stage"] is not None and e["stage"] != s["notified"]:
            s["notified"] = e["stage"]
            out.append((at, "notify", s["status"], e["stage"]))
        return s

    def _known(self) -> dict | None:
        found = self.state.get()
        return None if found is None else dict(zip([c.split()[0] for c in _STATE.split(", ")], found))

    def _keep(self, s: dict | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s is None:
            self.state.clear()
            return
        self.state.update(tuple(s.values()))
        plan = self.schedule
        times = [s["next"], s["began"] + plan.expiry * 1000 if plan.expiry is not None and not s["done"] else None, s["seen"] + plan.forget * 1000]
        self.handle.registerTimer(min(t for t in times if t is not None))

    def _rows(self, key, out: list) -> Iterator[Row]:
        import datetime as dt

        for at, what, status, stage in out:
            yield Row(id=key[0], at=dt.datetime.fromtimestamp(at / 1000), what=what, status=status, stage=stage)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, out = self._known(), []
        for e in sorted(rows, key=lambda e: (e["millis"], e["kind"], e["status"] or "", e["stage"] or "")):
            if s and not self._due(s, e["millis"], out):
                s = None
            s = self._event(s, e, e["millis"], out)
        self._keep(s)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, out = self._known(), []
        if s and not self._due(s, expiredTimerInfo.getExpiryTimeInMs() + 1, out):
            s = None
        self._keep(s)
        yield from self._rows(key, out)


def stateful(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def watched(events: DataFrame, schedule: Schedule = POLLING, late: str = "0 seconds") -> DataFrame:
    """A stream of events (id, at, kind, status, stage) as rows (id, at, what, status, stage).

    kind: submitted or answer (with a status and maybe a stage), failure, deleted. Events of one item are taken in order of
    time within a batch; those behind the watermark are lost, as timers have gone off by then. A row comes when the
    watermark has passed its time, or with the item's next event.
    """
    stateful(events.sparkSession)
    rows = events.select(F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), "kind", "status", "stage")
    rows = rows.where("id IS NOT NULL AND at IS NOT NULL").withColumn("millis", F.unix_millis("at")).withWatermark("at", late)
    return rows.groupBy("id").transformWithState(statefulProcessor=Watch(schedule), outputStructType=OUT, outputMode="append", timeMode="eventTime")


class CoolDown(StatefulProcessor):
    """Requests to a host, skipped while a bot wall it showed before makes it wait."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        import datetime as dt

        known = self.state.get()
        before = until = known[0] if known else None
        for r in sorted(rows, key=lambda r: (r["millis"], r["id"])):
            skipped = until is not None and r["millis"] < until
            if r["walled"] and not skipped:
                until = r["millis"] + self.millis
            yield Row(host=key[0], id=r["id"], at=dt.datetime.fromtimestamp(r["millis"] / 1000), skipped=skipped)
        if until != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()


def cooled(requests: DataFrame, seconds: int = 600, late: str = "0 seconds") -> DataFrame:
    """A stream of requests (host, id, at, walled) as (host, id, at, skipped): after a wall, none is made to its host for so many seconds.

    A skipped request's wall was never seen, so it doesn't lengthen the wait.
    """
    stateful(requests.sparkSession)
    rows = requests.select(F.lower("host").alias("host"), F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), F.coalesce("walled", F.lit(False)).alias("walled"))
    rows = rows.where("host IS NOT NULL AND at IS NOT NULL").withColumn("millis", F.unix_millis("at")).withWatermark("at", late)
    return rows.groupBy("host").transformWithState(statefulProcessor=CoolDown(seconds), outputStructType="host string, id string, at timestamp, skipped boolean", outputMode="append", timeMode="eventTime")
