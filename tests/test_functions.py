"""Truth tables of the column functions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftwork.functions import dates, identity, text, urls, vectors
from siftwork.operators import decisions, differences, evidence, similarity, votes
from siftwork.sources import html


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("one")])
    return row.select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    assert value(spark, text.normalize(F.lit("a​b  “x”… ।"))) == 'ab "x"... .'
    assert value(spark, text.normalize_digits(F.lit("১২৩ ৪"))) == "123 4"
    assert value(spark, text.match_form(F.lit("  É́ ১▁B "))) == "é́ 1 b"
    assert value(spark, text.match_form(F.lit(None).cast("string"))) == ""
    assert value(spark, text.tokens(F.lit("Dhaka: 1,200.5 টাকা, no!"))) == ["dhaka", "1,200.5", "টাকা", "no"]
    assert value(spark, text.content_tokens(F.lit("the man of 5 is not a x"))) == ["man", "5", "not"]
    assert value(spark, text.exact_key(F.lit(" Same  line। "))) == "Same line"
    assert value(spark, text.preview(F.lit("a b c d e f"))) == "a b c d e..." and value(spark, text.preview(F.lit("a b"))) == "a b"
    assert value(spark, text.sentences(F.lit("One sentence. Another one!\nshort\nA third line"))) == ["One sentence.", "Another one!", "A third line"]
    assert value(spark, text.cut_at_sentence(F.lit("Aaaaaaa. Bbbbbbb"), 12)) == "Aaaaaaa." and value(spark, text.cut_at_sentence(F.lit("A. Bbbbbbbbbbbbb"), 12)) == "A. Bbbbbbbbb"
    assert value(spark, text.clean_title(F.lit("<b>A story</b> - The Daily"))) == "A story"
    assert value(spark, text.shortened(F.lit("abcdef"), 4)) == "abcd…"


def test_stems():
    assert text.stem("মানুষের") == "মানুষ"
    assert text.stem("abc") == "abc" and text.stem("ঢাকার") == "ঢাকা"


def test_negation(spark):
    words = lambda *w: F.array(*map(F.lit, w))
    assert value(spark, text.negated(words("he", "did", "not")))
    assert not value(spark, text.negated(words("not", "never")))
    assert not value(spark, text.negated(words("কি", "না")))
    assert not value(spark, text.negated(F.array().cast("array<string>")))


@pytest.mark.parametrize(("query", "want"), [("the fire in Dhaka, fire!", ["fire", "Dhaka"]), ("the of", ["the of"]), ("a b 7", ["7"]), (None, []), ("  ", [])])
def test_query_words(query, want):
    assert text.split_query(query) == want


def test_hashes(spark):
    payload = {"v": "1", "scope": "HEADLINE_WITH_BODY", "headline": 'a "b"', "body": "x", "source": "s", "date": None}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    got = identity.claim_hash(F.lit('A  "b"'), F.lit(" S "), F.lit("HEADLINE_WITH_BODY"), F.lit("X"), F.lit(None), "1")
    assert value(spark, got) == want
    other = identity.claim_hash(F.lit('A "b"'), F.lit("s"), F.lit("HEADLINE_ONLY"), F.lit("ignored"), F.lit(None), "1")
    assert value(spark, other) == value(spark, identity.claim_hash(F.lit('a "B"'), F.lit("S"), F.lit("HEADLINE_ONLY"), F.lit("y"), F.lit(None), "1")) != want
    assert value(spark, identity.without_tracking(F.lit("https://a.b/c?x=1&utm_source=z&y=2#t"))) == "https://a.b/c?x=1&y=2#t"
    assert value(spark, identity.without_tracking(F.lit("https://a.b/c?ref=z"))) == "https://a.b/c"
    query = {"p": "rss", "q": "fire", "d": "2024-01-02"}
    assert value(spark, identity.query_hash(F.lit("RSS"), F.lit(" Fire "), F.lit("2024-01-02"))) == hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()


def test_urls(spark):
    assert value(spark, urls.canonical(F.lit("http://A.com/x/amp/?b=2&a=1&ref=q&__cf_x=1&e=#f"))) == "https://a.com/x?a=1&b=2"
    assert value(spark, urls.canonical(F.lit("http://a.com"))) == "https://a.com/"
    assert value(spark, urls.host(F.lit("https://www.News.example.com:80/a"))) == "news.example.com" and value(spark, urls.host(F.lit("nothing"))) is None
    assert value(spark, urls.unwrapped(F.lit("https://www.google.com/url?q=1&url=https%3A%2F%2Fa.b%2Fc"))) == "https://a.b/c"
    for url, ok in {"http://a.b/2024/01/02/x": True, "http://a.b/news/12345": True, "http://a.b/tag/12345": False, "http://a.b/about": False, "http://a.b/story-1234": True}.items():
        assert value(spark, urls.probable_article(F.lit(url))) is ok, url
    assert value(spark, urls.on_domain(F.lit("m.a.com"), F.array(F.lit("a.com")))) and not value(spark, urls.on_domain(F.lit("xa.com"), F.array(F.lit("a.com"))))


@pytest.mark.parametrize(("raw", "day", "assumed"), [
    ("2026-03-15T21:30:00Z", "2026-03-16", False), ("2026-03-15 23:30", "2026-03-15", True), ("2026-03-15", "2026-03-15", False), ("2026-03-15T10:00+0600", "2026-03-15", False),
    ("১৫ মার্চ ২০২৬", "2026-03-15", False), ("May 5, 2024", "2024-05-05", False), ("05/06/2024", "2024-06-05", False), ("not a date", None, None), ("2026-13-45", None, None), (None, None, None),
])
def test_publication(spark, raw, day, assumed):
    got = value(spark, dates.publication(F.lit(raw).cast("string")))
    assert (None if got is None else str(got.local_date)) == day and (None if got is None else got.tz_assumed) == assumed


def test_dates(spark):
    assert value(spark, dates.retry_delay(F.lit(0))) == 30 and value(spark, dates.retry_delay(F.lit(50))) == 3600
    assert str(value(spark, dates.only_date(F.lit("on ২০২৪-০১-০২ and 2024-01-02")))) == "2024-01-02" and value(spark, dates.only_date(F.lit("2024-01-02 2024-01-03"))) is None


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, vectors.cosine(arr(1.0, 2.0), arr(1.0, 2.0))) == pytest.approx(1) and value(spark, vectors.cosine(arr(1.0, 0.0), arr(-1.0, 0.0))) == 0
    assert value(spark, vectors.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0
    assert value(spark, vectors.norm(vectors.joined_unit(arr(3.0), arr(4.0)))) == pytest.approx(1)


LEVELS = [(0.9, None, None, "STRONG"), (0.74, 0.57, None, "STRONG"), (0.6, None, 0.7, "PLAUSIBLE"), (0.78, 0.2, 0.3, "NONE"), (None, 0.8, None, "PLAUSIBLE"), (None, 0.4, None, "NONE"), (None, None, None, "UNKNOWN")]


@pytest.mark.parametrize(("s", "t", "p", "level"), LEVELS)
def test_correspondence(spark, s, t, p, level):
    assert value(spark, decisions.correspondence(*[F.lit(x).cast("double") for x in (s, t, p)])) == level


def test_decisions(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    for args, want in {(False, True, False, None, False): "NOT_FOUND", (False, False, False, None, False): "INCOMPLETE", (False, True, True, None, False): "INCOMPLETE", (True, True, False, "STRONG", False): "CONFIRMED", (True, True, False, "STRONG", True): "INCOMPLETE", (True, True, False, "NONE", False): "NOT_FOUND", (True, False, False, "NONE", False): "INCOMPLETE", (True, True, False, "UNKNOWN", False): "INCOMPLETE"}.items():
        assert value(spark, decisions.source_status(*lit(*args))) == want, args
    assert [value(spark, decisions.adequate(*lit(a, c))) for a, c in ((4, 2), (4, 1), (10, 4), (0, 0))] == [True, False, False, False]
    day = lambda x: F.lit(x).cast("date")
    assert value(spark, decisions.date_status(day("2024-01-01"), day("2024-01-01"), F.lit(True))) == "MATCHED"
    assert value(spark, decisions.date_status(day("2024-01-01"), day(None), F.lit(True))) == "INCOMPLETE" and value(spark, decisions.date_status(day("2024-01-01"), day("2024-01-02"), F.lit(False))) is None
    assert value(spark, decisions.headline_verdict(*lit(False, 0, False, 0.9, 0.1, 0.8, 0))) == "EQUIVALENT" and value(spark, decisions.headline_verdict(F.lit(False), F.lit(0), F.lit(False), F.lit(None), F.lit(None), F.lit(0.8), F.lit(0))) == "UNAVAILABLE"
    assert value(spark, similarity.mean_of_known(F.lit(0.5), F.lit(None), F.lit(1.0))) == 0.75 and value(spark, similarity.mean_of_known(F.lit(None).cast("double"))) == 0


def test_similarity(spark):
    tok = lambda s: text.tokens(F.lit(s), compose=False)
    assert value(spark, similarity.jaccard(tok("a b c"), tok("b c d"))) == 0.5 and value(spark, similarity.jaccard(tok(""), tok("a"))) is None
    assert value(spark, similarity.tfidf_cosine(tok("fire dhaka"), tok("fire dhaka"))) == pytest.approx(1)
    assert value(spark, similarity.edit_similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3) and value(spark, similarity.edit_similarity(F.lit("é"), F.lit("e"))) == 0
    units = similarity.units(text.content_tokens(F.lit("fire not dhaka"), compose=False))
    assert value(spark, similarity.coverage(units, similarity.evidence_keys(tok("fire dha ka")))) == pytest.approx(2 / 3.5)
    assert value(spark, similarity.coverage_state(units, F.lit(" "))) == "UNAVAILABLE" and value(spark, similarity.coverage_state(similarity.units(tok("")), F.lit("x"))) == "EMPTY"


VOTES = [([("F", 4.0), ("M", 1.0)], None, False), ([("F", 6.0)], "F", False), ([("F", 5.0), ("R", 4.0)], "F", False), ([("F", 5.5), ("M", 1.0), ("F", 1.0), ("F", 1.0)], "F", True), ([("F", 2.0), ("R", 2.0)], None, False), ([(None, 9.0), ("F", 1.0)], "F", False)]


@pytest.mark.parametrize(("cast", "leader", "passes"), VOTES)
def test_consensus(spark, cast, leader, passes):
    rows = spark.createDataFrame([(1, i, v, w) for i, (v, w) in enumerate(cast)], "claim int, voter int, verdict string, weight double")
    (got,) = votes.consensus(rows, "claim", "voter", "verdict", "weight").collect()
    assert got.passes is passes and (leader is None or got.leader == leader)


def test_first_range(spark):
    tiers = spark.createDataFrame([(0.0, 40.0, "a"), (40.0, 70.0, "b")], "low double, high double, label string")
    rows = spark.createDataFrame([(40.0,), (41.0,), (99.0,), (None,)], "v double")
    assert [r.label for r in votes.first_range(rows, "v", tiers, "low", "high").collect()] == ["a", "b", None, None]


def test_passages_and_chunks(spark):
    body = "Nothing of note here at all. A fire broke out in Dhaka today. It was put out soon after. Weather was fine elsewhere. People went home late."
    got = value(spark, evidence.passages(F.lit("fire in Dhaka"), F.lit(body)))
    assert len(got) == 1 and (got[0]["first"], got[0]["last"]) == (0, 2) and got[0]["score"] == 1.0
    parts = value(spark, evidence.chunks(F.lit("One two. Three four. " + "word " * 50 + ". End here."), 40))
    assert all(len(p) <= 40 for p in parts) and parts[0] == "One two. Three four." and " ".join(parts).count("word") == 50


def test_material_differences(spark):
    cases = []

    def kinds(a, b):
        cases.append((len(cases), a, b))
        rows = spark.createDataFrame(cases[-1:], "id int, claim string, source string")
        return {r.kind for r in differences.material(rows, ["id"]).collect()}

    assert kinds("5 people died", "5 people died") == set()
    assert kinds("7 people died", "5 people died") == {"numbers"}
    assert kinds("court did not approve the plan", "court did approve the plan") == {"negation"}
    assert kinds("fire in march", "fire in april") == {"date"}
    assert "denial" in kinds("সেতু ভেঙে গেছে", "সেতু ভেঙে গেছে, খবরটি গুজব")
    rows = spark.createDataFrame([(1, "৫ লাখ টাকা এবং 1,200"), (2, "আগুনে পাঁচ জন নিহত ও ১২ জন আহত, ক্ষতি 3.5 কোটি টাকা"), (3, "25% growth")], "id int, claim string")
    got = [(r.id, r.value, r.unit, r.role) for r in differences.quantities(rows, ["id"], "claim").orderBy("id", "at").collect()]
    assert got == [(1, 500000.0, "টাকা", ""), (1, 1200.0, "", ""), (2, 5.0, "জন", "নিহত"), (2, 12.0, "জন", "আহত"), (2, 35000000.0, "টাকা", "আহত"), (3, 25.0, "শতাংশ", "")]


def test_differences_of_clauses_and_names(spark):
    rows = spark.createDataFrame([
        (1, "12 dead in bus crash; mayor did not resign today", "12 dead in bus crash; mayor did resign today"),
        # Two counterparts that contradict each other leave it open.
        (2, "mayor did not resign today", "mayor did resign today; mayor did not resign today"),
        (3, "Rahim met Karim", "Rahim met Salma in Dhaka"),
        (4, "সরকার বাজেট পাস করেছে", "সরকার বাজেট পাস করবে"),
        (5, "সব স্কুল বন্ধ ঘোষণা", "কিছু স্কুল বন্ধ ঘোষণা"),
        (6, "পুলিশকে ছাত্ররা মেরেছে", "ছাত্রদের পুলিশ মেরেছে"),
    ], "id int, claim string, source string")
    got = {(r.id, r.kind) for r in differences.material(rows, ["id"], names=True).collect()}
    assert {(1, "negation"), (3, "entity"), (4, "modality"), (5, "scope"), (6, "subject_object")} <= got
    assert not any(i == 2 for i, _ in got) and (1, "numbers") not in got


PAGE = """<html><head><title>T - Out</title><meta property="og:title" content="OG"><meta content="2024-05-01" name="date">
<script type="application/ld+json">{"@graph":[{"datePublished": "2024-05-02T10:00:00Z","articleBody":"%s"}]}</script></head>
<body><nav><p>menu menu menu menu menu menu menu menu menu menu</p></nav><h1>A &amp; B</h1><article><p>%s</p></article>
<a href="/a">x</a><a href="/a">longer</a><a href="/b">y</a></body></html>"""


def test_html(spark):
    rows = spark.createDataFrame([(1, PAGE % ("J\\\"q" * 50, "p " * 60)), (2, PAGE % ("short", "word " * 60)), (3, "<p>tiny</p>"), (4, None)], "page_id int, html string")
    got = {r.page_id: r for r in html.articles(rows).collect()}
    assert got[1].extraction_method == "json_ld" and got[1].body.startswith('J"q') and got[1].title == "A & B" and got[1].date_method == "json_ld"
    assert got[2].extraction_method == "article" and got[3].body is None and got[4].body is None
    assert [(r.href, r.anchor) for r in html.links(rows.where("page_id = 1")).orderBy("position").collect()] == [("/a", "longer"), ("/b", "y")]
    assert value(spark, html.visible(F.lit("<script>x</script><p>a&nbsp;b</p>"))) == "a b"
