"""Filters, keyword search by relevance, and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import spellings, split_query


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def holds(text: Column, term: str) -> Column:
    """Whether a text holds a term in any of its spellings, whatever the case; % and _ stand for themselves."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(t.lower())) for t in spellings(term)])


class KeywordSearch:
    """Rows that hold any keyword of a query in any column, those with most different keywords first."""

    def __init__(self, query: str | None, columns: list[str], headline: str | None = None):
        self.phrase, self.keywords = " ".join((query or "").split()), split_query(query)
        self.columns, self.headline = [F.col(c) for c in columns], F.col(headline) if headline else None

    def _anywhere(self, term: str) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(holds(c, term), F.lit(False)) for c in self.columns])

    def condition(self) -> Column | None:
        return reduce(lambda a, b: a | b, map(self._anywhere, self.keywords)) if self.keywords else None

    def hits(self) -> Column:
        return sum((self._anywhere(k).cast("int") for k in self.keywords), F.lit(0))

    def phrase_hit(self) -> Column:
        return self._anywhere(self.phrase).cast("int") if self.phrase else F.lit(0)

    def headline_hits(self) -> Column:
        return sum((F.coalesce(holds(self.headline, k), F.lit(False)).cast("int") for k in self.keywords), F.lit(0)) if self.headline is not None else F.lit(0)

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Matching rows with hits, phrase_hit and headline_hits."""
        condition = self.condition()
        found = rows if condition is None else rows.where(condition)
        return found.withColumns({"hits": self.hits(), "phrase_hit": self.phrase_hit(), "headline_hits": self.headline_hits()})

    def every_word(self) -> Column:
        """Whether all keywords are there."""
        return all_of(*map(self._anywhere, self.keywords))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows in a total order, from page 1."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def first_error(checks: dict[str, Column]) -> Column:
    """The name of the first check that fails, null if all hold; an unknown check fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
