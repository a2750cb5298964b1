"""Steps that must not gather rows: left joins on keys that may be null."""

import re

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.operators import differences, records
from siftwork.plans import claims, details

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def plain(spark):
    """No adaptive execution and no broadcasts, as with tables that are too large for them."""
    before = {k: spark.conf.get(k) for k in PLAIN}
    for k, v in PLAIN.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(rows):
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def test_rows_without_a_key_are_dealt_out(plain, sf):
    """Three quarters of the claims are no copies, two thirds of the results not reused."""
    assert largest_share(claims.pf_user_state(plain, sf)) < 0.4
    assert largest_share(details.jn_four_way(plain, sf)) < 0.4


def test_left_join_known_is_a_left_join(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i - 4) for i in range(40)] + [(7, None), (7, 3)], "id long, key long")
    other = spark.createDataFrame([(-4, "a"), (2, "b"), (2, "c"), (5, "d"), (None, "e")], "key long, v string")
    got = records.left_join_known(rows, other, "key", "id")
    assert got.columns == ["key", "id", "v"] and sorted(got.collect(), key=repr) == sorted(rows.join(other, "key", "left").collect(), key=repr)


def test_terms_are_counted_without_rows_of_terms(spark):
    """Terms are no key of a shuffle; rows of one key count together; equal counts in order of their first place."""
    rows = [(1, ["b", "a", "b", "c"]), (1, ["a", "d", "a"]), (2, ["x"]), (3, []), (4, None), (None, ["n", "m"])]
    out = text.top_terms(spark.createDataFrame(rows, "doc_id long, words array<string>"), "doc_id", "words", 3)
    got = sorted((r.doc_id or 0, r.place, r.term) for r in out.collect())
    assert got == [(0, 1, "n"), (0, 2, "m"), (1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "x")]
    assert not re.search(r"hashpartitioning\([^)]*term", out._jdf.queryExecution().executedPlan().toString())


def test_sides_of_pairs_are_not_broadcast(spark, tmp_path):
    """Small files may hold many words: their rows go to no driver."""
    texts = ("5 dead in bus crash; mayor did not resign today", "7 dead in bus crash; mayor did resign today")
    spark.createDataFrame([(i, j, *texts) for i in range(3) for j in range(3)], "item_id long, doc_id long, claim string, source string").write.parquet(f"{tmp_path}/pairs")
    out = differences.material(spark.read.parquet(f"{tmp_path}/pairs"), ["item_id", "doc_id"], names=True)
    got = {(r.item_id, r.doc_id, r.kind, r.detail) for r in out.collect()}
    assert got == {(i, j, *x) for i in range(3) for j in range(3) for x in (("numbers", "5.0"), ("negation", "claim negates"))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
