"""All queries of the library by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwork.plans import claims, details, pages, pipelines, relational, texts

MODULES = (relational, texts, pipelines, details, claims, pages)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
#: Weighted consensus: joins, a distinct count, sums per verdict, and the decision.
FLAGSHIP = relational.ag_consensus_summary
