from collections import Counter

import numpy as np

from siftwork.llm import rules
from siftwork.llm.common import table


def brute(text):
    text = text or ""
    words = [w for w in text.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_statistics(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    texts += [(10_000 + i, t) for i, t in enumerate(["a a a a", "a b c a b c", "a b c d a b c x b c d", None, "", "\n\n", "x\nx\n x\n", "é# é#\x1c y", "a b a b a", "p q r s p q r s p q r s"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in rules.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text


def test_a_planted_rule_is_found(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(c), int(a > 0.7 and b <= 0.4)) for i, (a, b, c) in enumerate(rng.random((3000, 3)))]
    data = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, bad int")
    found = rules.learn(data, features=("a", "b", "c"))
    assert found.rules
    out = data.withColumn("keep", found.keeps()).collect()
    assert sum(r["keep"] == (r["bad"] == 0) for r in out) / len(out) > 0.97
    assert {c.feature for r in found.rules for c in r.conditions} <= {"a", "b"}
    assert "else keep" in str(found)


def test_verdicts_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.97
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) > 0


def test_edges(spark, edges, none, sf):
    labels = table(spark, sf, "labels")
    out = rules.quality(edges, labels.limit(0)).collect()
    assert len(out) == edges.count() and all(not r.kept for r in out if r.n_words < 50)
    nulls = spark.createDataFrame([(1, None, None), (None, 1, None), (1, 0, 1), (1, 1, 1)], "doc_id long, quality int, n_words int")
    assert rules.quality(edges, nulls).count() == edges.count()
    assert rules.quality(none, labels).count() == 0


def test_native(documents, spark, sf):
    plan = rules.quality(documents, table(spark, sf, "labels"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
