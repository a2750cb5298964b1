"""Keyed state with timers against plain replays, over batches with restarts in between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import votes as batch_votes
from siftwork.operators.votes import Consensus
from siftwork.streaming import tallies, watching

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema, transform):
    """Rows of a query that is started anew for each batch, on one checkpoint."""
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = transform(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).collect()


EVENTS = "id string, at timestamp, kind string, status string, stage string"


def watch_events(seed):
    r = random.Random(seed)
    rows = []
    for i in range(12):
        t = r.randint(0, 300)
        rows.append((f"i{i}", t, "submitted", "QUEUED", None))
        for _ in range(r.randint(0, 8)):
            t += r.choice([5, 20, 31, 100, 400, 1000])
            kind = r.choice(["answer"] * 4 + ["failure"] * 2 + ["deleted"] * (r.random() < 0.1))
            status = r.choice(["QUEUED", "RUNNING", "EXPERT_REVIEW", "FINALIZED", "FAILED"]) if kind == "answer" else None
            rows.append((f"i{i}", t, kind, status, {"EXPERT_REVIEW": "preliminary", "FINALIZED": "final", "FAILED": "failed"}.get(status)))
    return sorted(rows, key=lambda x: x[1])


def replay(events, plan, end):
    """Second by second, from the rules alone."""
    items, out = {}, []
    by_time = {}
    for e in events:
        by_time.setdefault(e[1], []).append(e)
    for now in range(end):
        for i, _, kind, status, stage in sorted(by_time.get(now, []), key=lambda e: (e[2], e[3] or "", e[4] or "")):
            if kind == "deleted":
                if i in items:
                    out.append((i, now, "forgotten", items[i]["status"]))
                    del items[i]
                continue
            s = items.setdefault(i, {"began": now, "status": None, "told": None, "fails": 0, "next": None, "done": False})
            s["seen"] = now
            if kind == "failure":
                s["fails"] += 1
                s["next"] = now + min(plan.most, plan.backoff * 2 ** min(s["fails"], plan.doublings))
                continue
            s["fails"], s["status"] = 0, status
            s["next"] = now + {"FINALIZED": 600, "FAILED": 600, "EXPERT_REVIEW": 300}.get(status, 30)
            if status in plan.settled and not s["done"]:
                s["done"] = True
                out.append((i, now, "settled", status))
            if stage and s["told"] != stage:
                s["told"] = stage
                out.append((i, now, "notify", status))
        for i, s in list(items.items()):
            if now == s["seen"] + plan.forget:
                out.append((i, now, "forgotten", s["status"]))
                del items[i]
                continue
            if not s["done"] and now == s["began"] + plan.expiry:
                s.update(done=True, status="FAILED", next=None)
                out.append((i, now, "expired", "FAILED"))
            elif s["next"] is not None and now == s["next"]:
                s["next"] = None
                out.append((i, now, "check", s["status"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_watch_equals_replay(spark, tmp_path, seed):
    plan = watching.Schedule(watching.POLLING.delays, forget=3000)
    events = watch_events(seed)
    late = [("end", 20_000, "submitted", "QUEUED", None)], [("end", 20_001, "submitted", "QUEUED", None)]
    third = len(events) // 3
    batches = [events[:third], events[third : 2 * third], events[2 * third :], *late]
    rows = streamed(spark, tmp_path, [[(i, at(t), k, s, g) for i, t, k, s, g in b] for b in batches], EVENTS, lambda df: watching.watched(df, plan))
    found = sorted(((r["id"], int((r["at"] - T0).total_seconds()), r["what"], r["status"]) for r in rows if r["id"] != "end"), key=repr)
    # An event and a timer of the same second: the event comes first in both.
    assert found == replay(events, plan, 20_000)


def test_mail_queue(spark, tmp_path):
    """Tries at once, then after a minute, two, four; nothing after it was sent."""
    events = [("m", 0, "submitted", "pending", None), ("m", 5, "failure", None, None), ("m", 70, "failure", None, None), ("m", 400, "answer", "sent", None), ("end", 90_000_000, "submitted", "sent", None)]
    rows = streamed(spark, tmp_path, [[(i, at(t), k, s, g)] for i, t, k, s, g in [*events, ("end", 90_000_001, "submitted", "sent", None)]], EVENTS, lambda df: watching.watched(df, watching.MAILS))
    found = sorted((int((r["at"] - T0).total_seconds()), r["what"]) for r in rows if r["id"] == "m")
    assert found == [(0, "check"), (65, "check"), (190, "check"), (400, "settled"), (400 + 86_400, "forgotten")]


def test_cool_down(spark, tmp_path):
    requests = [("a", 1, 0, False), ("A", 2, 10, True), ("a", 3, 500, True), ("b", 4, 500, False), ("a", 5, 609, False), ("a", 6, 610, True), ("a", 7, 1209, False), ("a", 8, 1300, False)]
    batches = [[(h, str(i), at(t), w) for h, i, t, w in requests[a:b]] for a, b in ((0, 2), (2, 5), (5, 8))]
    rows = streamed(spark, tmp_path, batches, "host string, id string, at timestamp, walled boolean", watching.cooled)
    assert {r["id"]: r["skipped"] for r in rows} == {"1": False, "2": False, "3": True, "4": False, "5": True, "6": False, "7": True, "8": False}


VOTES = "claim string, voter string, verdict string, weight double, at timestamp"


def some_votes(seed, n=160):
    r = random.Random(seed)
    rows = [(f"c{i}", None, None, None, i) for i in range(6)]
    for k in range(n):
        claim = "c0" if r.random() < 0.4 else f"c{r.randint(1, 5)}"  # one claim has many of the votes
        rows.append((claim, f"v{r.randint(0, 9)}", r.choice(["REAL", "FAKE", "FAKE", "ALTERED", None]), r.choice([0.1, 0.2, 0.7, 1.0]), 10 + 7 * k))
    return rows


def test_tallies_equal_batch_form(spark, tmp_path):
    rule, rows = Consensus(1.0, 2, 0.3), some_votes(3)
    cuts = [rows[:50], rows[50:110], rows[110:]]
    found = streamed(spark, tmp_path, [[(*x[:4], at(x[4])) for x in b] for b in cuts], VOTES, lambda df: tallies.tallied(df, rule, closes=False))
    latest = {}
    for r in sorted((r for r in found if r["what"] == "tally"), key=lambda r: r["at"]):
        latest[r["claim"]] = (r["voters"], r["top_weight"], r["next_weight"], r["leader"], r["passes"])
    last = {(c, v): (c, v, verdict, w) for c, v, verdict, w, _ in rows if v}
    want = batch_votes.consensus(spark.createDataFrame(list(last.values()), "claim string, voter string, verdict string, weight double"), "claim", "voter", "verdict", "weight", rule)
    assert latest == {r["claim"]: tuple(r)[1:] for r in want.collect()}


def replayed(rows, rule, limits, end):
    claims, out = {}, []
    for claim, voter, verdict, weight, t in [*rows, *[(c, "", None, None, end) for c in {x[0] for x in rows}]]:
        s = claims.setdefault(claim, {"open": True, "votes": {}, "limit": None})
        if s["open"] and s["limit"] is not None and s["limit"] < t:  # it ran out before
            s["open"] = False
            out.append((claim, "ESCALATED", s["limit"]))
        if not s["open"] or voter == "":
            continue
        if voter is None:
            s["limit"] = t + limits.hours * 3600
            continue
        s["votes"][voter] = (verdict, weight)
        sums = {}
        for v, w in s["votes"].values():
            if v:
                sums[v] = round(sums.get(v, 0) + w, 6)
        ranked = sorted(sums.items(), key=lambda x: -x[1]) + [(None, 0), (None, 0)]
        if ranked[0][1] >= rule.least_weight and len(s["votes"]) >= rule.least_voters and round(ranked[0][1] - ranked[1][1], 6) >= rule.lead and ranked[0][1] > ranked[1][1]:
            s["open"] = False
            out.append((claim, "FINALIZED", t))
            s["winner"] = ranked[0][0]
        elif len(s["votes"]) >= limits.votes:
            s["open"] = False
            out.append((claim, "ESCALATED", t))
    reviews = [(c, v, x[0] == s["winner"]) for c, s in claims.items() if "winner" in s for v, x in s["votes"].items()]
    return sorted(out), sorted(reviews)


@pytest.mark.parametrize("rule, limits", [(Consensus(3.0, 3, 0.5), tallies.Limits(9, 0.2)), (Consensus(2.0, 2, 2.0), tallies.Limits(8, 0.3)), (Consensus(1.0, 1, 0.1), tallies.Limits(20, 9.0))])
def test_cascade(spark, tmp_path, rule, limits):
    rows = some_votes(5)
    end = [("end", None, None, None, 100_000)], [("end", None, None, None, 100_001)]
    folder, source = f"file://{tmp_path}/state", f"file://{tmp_path}/in"
    for b in [rows[:40], rows[40:90], rows[90:], *end]:
        spark.createDataFrame([(*x[:4], at(x[4])) for x in b], VOTES).coalesce(1).write.mode("append").parquet(source)
        tallies.cascade(spark.readStream.schema(VOTES).parquet(source), folder, f"file://{tmp_path}/cp", rule, limits, least_decided=2).awaitTermination()
    claims, reviews = replayed(rows, rule, limits, 100_000)
    found = spark.read.parquet(f"{folder}/claims").where("claim <> 'end'").collect()
    assert sorted((r["claim"], r["status"], round((r["at"] - T0).total_seconds())) for r in found) == [(c, s, round(t)) for c, s, t in claims]
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/reviews").select("claim", "voter", "correct").collect())) == reviews
    versions = spark.read.parquet(f"{folder}/reviewers")
    newest = {r["voter"]: (r["decided"], r["correct"], r["score"]) for r in versions.where(F.col("batch") == versions.agg(F.max("batch")).first()[0]).collect()}
    want = {}
    for _, v, correct in reviews:
        n, c, _ = want.get(v, (0, 0, None))
        want[v] = (n + 1, c + correct, None)
    assert newest == {v: (n, c, round(c / n, 6) if n >= 2 else None) for v, (n, c, _) in want.items()}
