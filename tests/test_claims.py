"""Values of what the SQL comparison can't see: spellings, names, payloads, caches, write-backs, meaning."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftwork.functions import payloads, text
from siftwork.operators import entities, evidence, labels, records, search, similarity, state
from siftwork.sources import html


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("one")])
    return row.select(column.alias("x")).first()["x"]


def test_spellings(spark):
    split, joined = "বাড়ি", "বাড়ি"
    assert text.spellings(split) == [split, joined] == text.spellings(joined) and text.spellings("abc") == ["abc"]
    assert value(spark, search.holds(F.lit(f"একটি {joined} আছে"), split)) and value(spark, search.holds(F.lit(f"একটি {split} আছে"), joined))


def test_entity_matches(spark):
    def status(claim, source):
        return {m["mention"]: m["status"] for m in value(spark, entities.matches(F.lit(claim), F.lit(source)))}

    assert status("Dhaka and Sheikh Rahim", "near Dhaka, Sheikh Rahim spoke") == {"Dhaka": "exact", "Sheikh Rahim": "exact"}
    assert status("Dhaka burns", "ঢাকা পুড়ছে") == {"Dhaka": "alias"}
    assert status("for Rahim", "so Sheikh Rahim spoke") == {"Rahim": "ambiguous"}
    assert status("by Sheikh Rahim Uddin", "then Sheikh Rahim spoke") == {"Sheikh Rahim Uddin": "span"}
    assert status("by Rahim", "then rahim spoke") == {"Rahim": "text"} and status("by Rahim", "then Karim spoke") == {"Rahim": "unmatched"}


def test_entity_aliases_come_before_longer_names(spark):
    found = lambda claim, source: [m["status"] for m in value(spark, entities.matches(F.lit(claim), F.lit(source)))]
    assert found("fire in Dhaka", "so dhaka burns") == ["alias"]  # a form of the thing in the text, the claimed one too
    assert found("see Un", "UN DE LA") == ["alias"] and found("see Une", "UNE DE LA") == ["ambiguous"]


def test_units_of_one_stem(spark):
    words = F.array(*map(F.lit, ("ঢাকা", "ঢাকার", "5", "not")))
    rows = spark.range(1).select(words.alias("w")).withColumn("s", text.stem_list(F.col("w")))
    units = rows.select(similarity.units(F.col("w"), F.col("s")).alias("u")).first().u
    assert [(u.token, u.weight) for u in units] == [("ঢাকা", 1.0), ("5", 1.5), ("not", 1.5)]
    keys = spark.range(1).select(F.array(F.lit("ঢাকার")).alias("w")).select(similarity.evidence_keys(F.col("w")).alias("k")).first().k
    assert set(keys) == {"ঢাকার", "ঢাকা"}


def test_indel_ratio(spark):
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], row[j] + (x == y)) for j, y in enumerate(b)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("abé"), n)), "".join(rng.choice(list("abé"), m))) for n, m in rng.integers(0, 40, (50, 2)).tolist()]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - brute(r.a, r.b)) < 1e-12 for r in rows)


def test_semantic_cosine(spark):
    """Against plain Python on one chunk a side, and the best chunk of a longer source."""

    def vector(words):
        out = np.zeros(64)
        for w in words.lower().split():
            out[xxhash.xxh64_intdigest(w.encode(), seed=42) % 64] += 1
        return out / np.linalg.norm(out)

    a, b = "alpha beta gamma", "beta gamma delta epsilon"
    long = ("filler words only here " * 30).strip() + ". " + a + "."
    rows = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, long), (4, a, None)], "id int, claim string, source string")
    got = {r.id: r.semantic_cosine for r in evidence.semantic_cosine(rows, ["id"], "claim", "source").collect()}
    assert abs(got[1] - vector(a) @ vector(b)) < 1e-9 and abs(got[2] - 1) < 1e-9 and set(got) == {1, 2, 3}
    assert got[3] > 0


def test_payloads(spark):
    assert tuple(value(spark, payloads.quota(F.lit("no json")))) == (False, 60.0)
    assert tuple(value(spark, payloads.quota(F.lit('{"error": {"details": [{"violations": [{"quotaId": "xPerDay"}]}, {"retryDelay": "12s"}]}}')))) == (True, 12.0)
    assert value(spark, payloads.answer_text(F.lit('{"candidates": []}'))) == ""
    assert value(spark, labels.readable(F.lit("The LaBSE model failed. Embedding is off. It is MATCHED."))) == labels.LIMITS + " It is matched."


def test_joins_only_if_needed(spark):
    claims, results = spark.range(5).toDF("id"), spark.range(5).select("id", F.lit("REAL").alias("verdict"))
    plan = records.claims_with_results(claims, results, "id", verdict=None)._jdf.queryExecution().toString()
    assert "Join" not in plan and records.claims_with_results(claims, results, "id", verdict="FAKE").count() == 0


def test_persisted_twice_is_the_same(spark):
    article = [("https://a.b/c ", "t" * 600, "body"), ("HTTPS://A.B/C", "t", ""), ("https://a.b/d", None, None)]
    rows = spark.createDataFrame([(1, "h", "REAL", "x", article, ["q1", "q2"])], "id int, headline string, verdict string, content_hash string, articles array<struct<url:string,title:string,body:string>>, queries array<string>")
    first, second = ({k: sorted(map(str, t.collect())) for k, t in records.persisted(rows).items()} for _ in range(2))
    assert first == second and len(first["articles"]) == 2 and len(first["queries"]) == 2
    again = state.insert_absent(records.persisted(rows)["articles"], records.persisted(rows)["articles"], ["id", "url_hash"])
    assert again.count() == 0


def test_collation_and_kickers(spark):
    names = spark.createDataFrame([("খবর",), ("আলো",), ("কাগজ",)], "source string").orderBy(F.collate("source", "bn")).collect()
    assert [r.source for r in names] == ["আলো", "কাগজ", "খবর"]
    page = "<h3>A line before the title</h3> <h1>Title here</h1>\n<h2><a href='/x'>linked line after it</a></h2>"
    assert value(spark, html.kickers(F.lit(page), F.lit("Title here"))) == ["A line before the title", "A line before the title Title here"]
    assert [x for x in value(spark, html.kickers(F.lit("<h1>T</h1>"), F.lit("T"))) if x] == []


def test_clean_extracted(spark):
    raw = "Fire in the old town\nTags: a\n12:30 |\n\n\n\n" + "Many people left their homes early. " * 4 + "All rights reserved"
    got = value(spark, text.clean_extracted(F.lit(raw)))
    assert "rights" not in got and "12:30" not in got and "\n\n\n" not in got and got.startswith("Fire in the old town")
    assert value(spark, text.clean_extracted(F.lit("short"))) is None
