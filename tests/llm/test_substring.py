import numpy as np

from siftwork.llm import substring


def brute(rows, window=20):
    """Windows by their words, in order of doc_id."""
    seen, out = set(), {}
    for doc, text in sorted(((d, t) for d, t in rows if d is not None), key=lambda x: x[0]):
        words = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.without_repeats(documents).collect()}
    assert got == brute(rows)


def test_passages_and_periods(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 50)) + f" {passage} " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 9))) for i in range(40)]
    rows += [(100, "a " * 200), (101, "a b " * 100), (102, "a " * 19), (103, "a " * 20), (104, " ".join(map(str, range(20)))), (105, " ".join(map(str, range(20)))), (106, " ".join(map(str, range(19))))]
    rows += [(200 + i, "  ".join(f"p{j}" for j in range(i, i + 30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.without_repeats(docs).collect()}
    assert got == brute(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "MOST_BITS", 17)
    rows = [(i, " ".join(str(j % 3000) for j in range(i * 500, i * 500 + 3000))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.without_repeats(docs).collect()}
    assert got == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 64), monkeypatch.setattr(substring, "TOGETHER", 200), monkeypatch.setattr(substring, "HELD", 100)
    rng = np.random.default_rng(6)
    shared = [f"s{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 10**6, 37 * i)] + shared[i * 10 : 200 + i * 7] + ["x"] * (i * 9))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.without_repeats(docs).collect()}
    assert got == brute(rows)


def test_pieces_of_a_sketch():
    for top in (300, 1 << 20):
        cells = np.sort(np.random.default_rng(8).integers(0, top, 5000)).astype(np.uint32)
        assert (substring.unpacked(substring.packed(cells)) == cells).all()
    for cells in ([0, 0, 254, 509, 764], [255], [510], []):
        assert substring.unpacked(substring.packed(np.array(cells, np.uint32))).tolist() == cells


def test_anchors_move_with_their_window():
    rng = np.random.default_rng(3)
    runs = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    got = substring.anchors(runs, 20, 8)
    assert len(got) == 400 - 12
    assert all(got[i] == i + int(runs[i : i + 13].argmin()) for i in range(len(got)))


def test_hashes_of_runs():
    words = np.random.default_rng(4).integers(0, 3, 300).astype(np.uint64)
    for width, got in zip((1, 8, 20, 5), substring.spans(words, 1, 8, 20, 5)):
        keys = [tuple(words[i : i + width]) for i in range(300 - width + 1)]
        assert len(got) == len(keys) and len(set(got.tolist())) == len(set(keys)) == len(set(zip(keys, got.tolist())))
    assert [len(x) for x in substring.spans(words[:6], 8, 20)] == [0, 0]


def test_edges(edges, none):
    out = {r.doc_id: r for r in substring.removal_digest(edges).collect()}
    assert out[3].n_words == out[4].n_words == 0 and out[None].n_removed == 0 and out[6].n_words == 1
    assert substring.removal_digest(none).count() == 0
