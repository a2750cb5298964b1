"""Weighted votes: tallies, consensus, reviewers' accuracy and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Consensus:
    """What a leading verdict needs: weight, voters, and a lead over the next one."""

    least_weight: float = 5.0
    least_voters: int = 3
    lead: float = 1.0


def tally(votes: DataFrame, claim: str, verdict: str, weight: str) -> DataFrame:
    """(claim, verdict, weight): weights summed per verdict, null verdicts left out.

    Sums are rounded to 6 places, so that equal sums are ties in whatever order they were added.
    """
    return votes.where(F.col(verdict).isNotNull()).groupBy(claim, verdict).agg(F.round(F.sum(F.col(weight).cast("double")), 6).alias("weight"))


def consensus(votes: DataFrame, claim: str, voter: str, verdict: str, weight: str, rule: Consensus = Consensus()) -> DataFrame:
    """Per claim: voters, top_weight, next_weight, leader (null on a tie), passes.

    A claim's verdicts are few, so leader and runner-up come from an aggregate of tallies, without a sort of the votes.
    """
    sums = tally(votes, claim, verdict, weight)
    voters = votes.groupBy(claim).agg(F.count_distinct(voter).alias("voters"))
    best = F.sort_array(F.collect_list(F.struct("weight", F.col(verdict).alias("verdict"))), asc=False)
    tops = sums.groupBy(claim).agg(best.alias("best"))
    out = voters.join(tops, claim, "left")
    top, runner = F.col("best")[0]["weight"], F.try_element_at("best", F.lit(2))["weight"]
    out = out.withColumns({"top_weight": F.coalesce(top, F.lit(0.0)), "next_weight": F.coalesce(runner, F.lit(0.0))})
    out = out.withColumn("leader", F.when((F.col("top_weight") > F.col("next_weight")), F.col("best")[0]["verdict"]))
    ahead = F.round(F.col("top_weight") - F.col("next_weight"), 6) >= rule.lead
    passes = F.col("leader").isNotNull() & (F.col("top_weight") >= rule.least_weight) & (F.col("voters") >= rule.least_voters) & ahead
    return out.select(claim, "voters", "top_weight", "next_weight", "leader", passes.alias("passes"))


def accuracy(votes: DataFrame, voter: str, vote: Column, final: Column) -> DataFrame:
    """Per voter: votes on decided claims, correct ones, and their share; a null vote is not correct."""
    return votes.groupBy(voter).agg(F.count(final).alias("decided"), F.count_if(vote == final).alias("correct")).withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.nullif(F.col("decided"), F.lit(0))))


def first_range(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """rows with the columns of the first of ranges, by low, that holds value, both ends included; null if none.

    ranges are aggregated into one array of at most a few tiers, and each row looks its own up: no join per row.
    """
    tiers = ranges.agg(F.sort_array(F.collect_list(F.struct(low, high, *[c for c in ranges.columns if c not in (low, high)]))).alias("_tiers"))
    found = F.get(F.filter("_tiers", lambda t: (F.col(value) >= t[low]) & (F.col(value) <= t[high])), F.lit(0))
    out = rows.crossJoin(F.broadcast(tiers)).withColumn("_tier", found)  # one row
    return out.select(*rows.columns, *[F.col("_tier")[c].alias(c) for c in ranges.columns])


def range_faults(ranges: DataFrame, low: str, high: str, first: float = 0.0, last: float = 100.0) -> DataFrame:
    """Places where ranges don't tile first to last: border, fault (gap, overlap, start, end)."""
    order = Window.orderBy(low, high)
    rows = ranges.withColumn("_next", F.lead(low).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    kinds = F.array_compact(F.array(
        F.when(F.col("_first") & (F.col(low) != first), F.lit("start")),
        F.when(F.col("_next").isNull() & (F.col(high) != last), F.lit("end")),
        F.when(F.col("_next") > F.col(high), F.lit("gap")),
        F.when(F.col("_next") < F.col(high), F.lit("overlap")),
    ))
    return rows.select(F.col(high).alias("border"), F.explode(kinds).alias("fault"))


def changed_ranges(ranges: DataFrame, key: str, upserts: DataFrame, deleted: list, low: str, high: str, first: float = 0.0, last: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """(ranges after the change, its faults): upserts by key and deletions count together, and only if the whole set then tiles
    first to last; else the ranges stay as they are. Keys that are not there may be deleted; no change changes nothing."""
    gone = ~F.col(key).isin(deleted) if deleted else F.lit(True)
    new = ranges.join(upserts.select(key), key, "left_anti").where(gone).select(*ranges.columns).union(upserts.select(*ranges.columns))
    faults = range_faults(new, low, high, first, last)
    sound = faults.agg((F.count("*") == 0).alias("_sound"))  # one row
    both = ranges.withColumn("_new", F.lit(False)).union(new.withColumn("_new", F.lit(True)))
    return both.crossJoin(F.broadcast(sound)).where("_new = _sound").drop("_new", "_sound"), faults


def vote_weight(decided: Column, tier_weight: Column, least_votes: int = 10, neutral: float = 1.0) -> Column:
    """A reviewer's weight: neutral until there are enough decided votes, then that of the tier."""
    return F.when(decided < least_votes, F.lit(neutral)).otherwise(F.coalesce(tier_weight, F.lit(neutral)))


def overdue(votes: Column, age_hours: Column, most_votes: int | None, most_hours: int | None) -> Column:
    """Whether a review ran into a limit; no limit is never reached."""
    by_votes = votes >= most_votes if most_votes is not None else F.lit(False)
    by_age = age_hours >= most_hours if most_hours is not None else F.lit(False)
    return F.coalesce(by_votes, F.lit(False)) | F.coalesce(by_age, F.lit(False))
