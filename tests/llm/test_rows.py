"""Rows that share a doc_id but not a text, rows without doc_id, and repeated rows: each against brute force at 1, 3 and 8 partitions."""

import hashlib

import pytest

from siftwork.llm import minhash, mixing, pii, substring

P = " ".join(f"w{i}" for i in range(30))
U = " ".join(f"u{i}" for i in range(30))
NEAR = " ".join([*(f"w{i}" for i in range(29)), "other"])
ROWS = [(1, P), (2, P), (2, U), (3, U), (3, U), (None, P), (None, U), (4, None), (4, NEAR), (5, "")]


def rows(spark, parts):
    return spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_near_duplicates(spark, parts):
    found = sorted(map(tuple, minhash.near_duplicates(rows(spark, parts), width=2, percent=80).collect()), key=repr)
    # Of doc 2, one text belongs with 1 and the other with 3, whose smallest doc_id is 2 itself.
    want = [(1, 29, 1, True), (2, 29, 1, False), (2, 29, 2, True), (3, 29, 2, False), (3, 29, 2, False), (None, 29, None, True), (None, 29, None, True), (4, 0, 4, True), (4, 29, 1, False), (5, 0, 5, True)]
    assert found == sorted(want, key=repr)


def plain_removal(window=20):
    """Window by window over all rows; equal rows are one document."""
    texts = sorted({(i, t) for i, t in ROWS if i is not None and t}, key=lambda x: x[0])
    out = {}
    for i, t in ROWS:
        words = (t or "").split()
        gone = set()
        for a in range(len(words) - window + 1):
            w = words[a : a + window]
            earlier = any(j < i and any(u.split()[b : b + window] == w for b in range(len(u.split()) - window + 1)) for j, u in texts) if i is not None else False
            if earlier:
                gone |= set(range(a, a + window))
        out.setdefault((i, len(words)), set()).add((len(gone), " ".join(x for k, x in enumerate(words) if k not in gone)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_substrings(spark, parts):
    want = plain_removal()
    got = {}
    for r in substring.without_repeats(rows(spark, parts)).collect():
        got.setdefault((r["doc_id"], r["n_words"]), set()).add((r["n_removed"], r["kept_text"]))
    assert got == want
    assert (0, U) in got[2, 30] and (30, "") in got[2, 30]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_spans_lie_in_their_text(spark, parts):
    filler = [(i, f"filler{i} words here nothing else {hashlib.md5(str(i).encode()).hexdigest()}") for i in range(300)]
    told = [(1000 + i, f"{'x' * 3} {extra} Zanzibar mail zed.q@example.com {extra}") for i, extra in enumerate(["alpha", "beta", "gamma"])]
    docs = spark.createDataFrame([*filler, *told, (1000, "short"), (1000, "short"), (None, told[0][1])], "doc_id long, text string").repartition(parts)
    out = pii.found_spans(docs)
    texts = {}
    for i, t in [*filler, *told, (1000, "short")]:
        texts.setdefault(i, []).append(len(t))
    found = [r.asDict() for r in out.collect()]
    assert len(found) == 306
    assert sorted((r["n_term"] > 0, r["n_email"]) for r in found if r["doc_id"] == 1000) == [(False, 0), (False, 0), (True, 1)]
    clean = pii.sanitised(docs).where("doc_id = 1000").collect()
    assert sorted(r["text"] for r in clean)[-2:] != [] and [r["text"] for r in clean].count("short") == 2


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_mix_keeps_its_target(spark, parts):
    """Four equal rows without doc_id, or of one doc_id, where the target has room for three only."""
    for same in (None, 7):
        docs = spark.createDataFrame([(same, "word " * 100, "a")] * 4 + [(1, "b " * 20, "b"), (2, "c " * 400, "b")], "doc_id long, text string, source string").repartition(parts)
        out = mixing.mixed_sizes(docs).collect()
        for source in {r["source_size"] for r in out}:
            own = [r for r in out if r["source_size"] == source]
            assert sum(r["taken"] for r in own) <= own[0]["target"] and all(r["taken"] <= 2 * r["size"] for r in own)
        assert len({r["taken"] for r in out if r["size"] == 100}) == 1
