"""Dates on cards, and near duplicates by several vectors, by value."""

import random

from pyspark.sql import functions as F

from siftwork.functions import dates
from siftwork.operators import duplicates


def test_card_dates(spark):
    cases = {
        "প্রকাশ: ৫ই জানুয়ারি, ২০২৪": "2024-01-05",
        "২১শে ফেব্রুয়ারী ২০২৩ | ঢাকা": "2023-02-21",
        "1st March 2024": "2024-03-01",
        "on Sept. 9, 2022, at noon": "2022-09-09",
        "MAY 31st 2021": "2021-05-31",
        "2024/2/29": "2024-02-29",
        "২০২৪-০২-০৩ and 3 Feb 2024": "2024-02-03",
        "03.02.2024": "2024-02-03",
        "31-12-1999.": "1999-12-31",
        "30 February 2024": None,
        "2023-02-29": None,
        "1 March 2024 and 2 March 2024": None,
        "12024-01-01": None,
        "5 Smarch 2024": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    for r in rows.withColumn("got", dates.card_date(F.col("raw")).cast("string")).collect():
        assert r["got"] == r["want"], r


def test_near_by_all(spark):
    r = random.Random(2)
    vec = lambda: [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]
    rows = [(i, r.choice("ab"), vec() if r.random() > 0.1 else None, vec()) for i in range(80)]
    least = {"text": 0.9, "image": 0.7}

    def cosine(x, y):
        if x is None or y is None or not any(x) or not any(y):
            return -1
        return sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5

    found = duplicates.near_by_all(spark.createDataFrame(rows, "id long, grp string, text array<double>, image array<double>").repartition(3), "grp", [F.col("id")], "id", least, n=20)
    got = {x["id"]: (x["match"], x["text_cosine"], x["image_cosine"]) for x in found.collect()}
    for i, g, t, m in rows:
        before = [x for x in rows if x[1] == g and x[0] < i][-20:]
        match = next((x for x in reversed(before) if cosine(x[2], t) >= 0.9 - 1e-12 and cosine(x[3], m) >= 0.7 - 1e-12), None)
        assert got[i][0] == (match[0] if match else None)
        if match:
            assert abs(got[i][1] - cosine(match[2], t)) < 1e-9 and abs(got[i][2] - cosine(match[3], m)) < 1e-9
