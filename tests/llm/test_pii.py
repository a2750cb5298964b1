import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siftwork.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    found = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if valid(k, m[0])]
    return sorted(found)


CASES = [
    "a@b.c_d@e.f g@h.i.j-k x..y@z.com@w.com %+-@a-b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3 10.0.0.255",
    "4111111111111111 4111-1111 1111-1111 4111 1111 1111 1112 12345678901234567890 41111111  11111111",
    "4316522678525456 4316522678525456",
    "+1 (743) 555-3824 +12 +1234567890123456 ++1 234 567 890 + 1 234 +1...23456789 end",
    "é日本 x@y.zz 𝒳𝒴 1.1.1.1",
    "+49 4111111111111111",
    None,
    "",
]


def test_base_spans(spark, documents):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100 + r.doc_id, r.text) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.base_spans(docs).collect()}
    for i, t in rows:
        assert [tuple(s) for s in got[i]] == brute(t), t
    out = {r.doc_id: r for r in pii.found_spans(docs).collect()}
    for i, t in rows:
        spans = brute(t)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(pii.KINDS[s[1]] == k for s in spans) for k in pii.KINDS[:4]]
        assert set(joined.split(",")) - {""} <= set(out[i].spans.split(","))


@pytest.fixture
def corpus(spark):
    """A nickname that only ever stands near one address, in different contexts, among common words."""
    rows = [(i, f"common words about topic {i % 7} and weather number {i}") for i in range(60)]
    rows += [(100 + i, f"common {w} zorblax wrote from zed@mail.example.com about topic and weather {w}s again") for i, w in enumerate(("red", "green", "blue"))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_disclose(corpus):
    out = {r.doc_id: r for r in pii.found_spans(corpus).collect()}
    text = {r.doc_id: r.text for r in corpus.collect()}
    for i in (100, 101, 102):
        terms = {text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in out[i].spans.split(",")) if k == "term"}
        assert "zorblax" in terms and not terms & {"common", "about", "topic", "weather", "and"}
    assert all(out[i].spans == "" for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(corpus).collect()}
    assert "<TERM>" in clean[100] and "<EMAIL>" in clean[100] and "zorblax" not in clean[100] and clean[5] == text[5]


def test_copies_are_one_context(spark):
    rows = [(i, f"plain text number {i}") for i in range(50)] + [(100 + i, "rareword near a@b.com here") for i in range(10)]
    out = pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.agg(F.sum("n_term")).first()[0] == 0


def test_edges(edges, none):
    out = {r.doc_id: r for r in pii.found_spans(edges).collect()}
    assert out[3].spans == "" and out[4].spans == "" and out[8].n_email == 3
    assert pii.found_spans(none).count() == 0
    clean = {r.doc_id: r.text for r in pii.sanitised(edges).collect()}
    assert clean[3] is None and clean[4] == "" and clean[8].count("<EMAIL>") == 3
    assert pii.sanitised(edges).columns == edges.columns


def test_terms_far_from_the_entity(spark):
    """A name in the first paragraph and the address in the signature: every place of the name goes, common words stay."""
    filler = "plain words fill the space between both of them. " * 10
    rows = [(i, f"plain words fill the space between both of them, number {i}") for i in range(60)]
    rows += [(100 + i, f"{w} notes: Zorblax came. {filler}{w} ends, zorblax left, plain. {filler}zed@mail.example.com") for i, w in enumerate(("red", "green", "blue"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    for i in (100, 101, 102):
        assert "zorblax" not in clean[i].lower() and clean[i].count("<TERM>") >= 2 and "<EMAIL>" in clean[i] and "plain words fill" in clean[i]
    assert clean[5] == rows[5][1] and "plain" in clean[100]


def test_many_matches_in_one_text(spark):
    """Places in a long text with hundreds of matches, over several runs of lengths, touching and overlapping ones included."""
    text = " ".join(f"é{i} ann{i}@mail.example.com +1 (743) 555-{1000 + i} 10.0.{i % 256}.1 plan" for i in range(700))
    docs = spark.createDataFrame([(1, text), (2, "+49 4111111111111111x")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.base_spans(docs).withColumn("marks", pii._marks(F.col("base"), F.length("text"))).collect()}
    for r in rows.values():
        spans = brute(r.text)
        assert [tuple(s) for s in r.base] == spans
        covered = {i for a, _, z in spans for i in range(a, z)}
        assert r.marks == "".join("01"[i in covered] for i in range(len(r.text)))


def test_native(documents):
    spanned = pii.base_spans(documents.select("doc_id", "text"))
    for rows in (pii.contexts(spanned), pii.sanitised(documents), pii.found_spans(documents)):
        plan = rows._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
