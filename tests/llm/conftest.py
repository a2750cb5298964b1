import pytest

from siftwork.llm.common import table

#: Nulls in every column, empty, blank and long texts, ties, repeated rows.
EDGES = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "en", None),
    (6, "word", None, "a"),
    (7, "word", "en", "c"),
    (8, "é " * 3000 + "mail x.y@example.com " * 3, "fr", "c"),
    (8, "é " * 3000 + "mail x.y@example.com " * 3, "fr", "c"),
    (None, "no id here", "en", "a"),
    (9, "same line\nsame line\nsame line", "en", "a"),
]


@pytest.fixture(scope="session")
def documents(spark, sf):
    return table(spark, sf, "documents").cache()


@pytest.fixture(scope="session")
def edges(spark):
    rows = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    # Other columns, some with names that the operators use themselves.
    return rows.selectExpr("*", "1 AS n_shingles", "2 AS size", "'x' AS component", "3 AS n", "4 AS score", "5 AS bucket").repartition(3)


@pytest.fixture(scope="session")
def none(edges):
    return edges.limit(0)


def pairs(rows):
    return [r.asDict() for r in rows.collect()]
