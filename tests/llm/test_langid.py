import random

from siftwork.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 200 and sum(r.lang_pred == r.lang for r in tested) / len(tested) > 0.96
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_lang_is_no_input(documents):
    changed = documents.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    assert sorted(map(tuple, langid.languages(changed).collect())) == sorted(map(tuple, langid.languages(documents).collect()))


def test_edges(edges, none, documents):
    model = langid.learn(documents)
    out = {r.doc_id: r for r in langid.predicted(edges, model).select("doc_id", "_language.*").collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[5].lang_pred == "und" and out[3].score == 0 and out[3].rejected
    assert out[6].lang_pred in model and out[8].lang_pred in model
    odd = edges.selectExpr("doc_id", "'12 34 !! ½ ² Ⅷ_' AS text")
    assert {r.lang_pred for r in langid.predicted(odd, model).select("_language.*").collect()} == {"und"}
    assert langid.languages(none).count() == 0
    assert langid.languages(edges).count() == edges.count()


def test_length_rejects_no_clean_text(documents):
    """A text of several MB has about the margin of its parts, and its later parts count."""
    model = langid.model(tuple(langid.learn(documents).items()))
    words = {}
    for r in documents.where("text is not null").select("lang", "text").collect():
        words.setdefault(r.lang, []).extend(r.text.split())
    first, second = sorted(model.languages)[:2]
    draw = lambda lang, n: " ".join(random.Random(7).choices(words[lang], k=n))
    for lang in model.languages:
        (short, part), (long, whole) = model.predict(draw(lang, 5_000)), model.predict(draw(lang, 600_000))
        assert short == long == lang and whole >= langid.MARGIN and whole > 0.5 * part
    assert model.predict(draw(first, 60_000) + " " + draw(second, 240_000))[0] == second
