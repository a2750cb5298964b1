import itertools

import numpy as np
import pytest

from siftwork.llm import minhash
from siftwork.llm.common import WordHashes, connected_components


def brute(rows, width, percent):
    """Components over all pairs of exact shingle sets."""
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(documents, width):
    want = brute(documents.select("doc_id", "text").collect(), width, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents, width, 80).collect()}
    assert got == want


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for doc in range(400):
        words = list(base)
        for i in rng.choice(120, rng.integers(0, 12), replace=False):
            words[i] = f"x{rng.integers(10**6)}"
        rows.append((doc, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_edges(edges, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(edges, 2).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[1].kept and not got[2].kept
    assert got[3].n_shingles == got[4].n_shingles == got[5].n_shingles == 0
    assert [got[i].component_id for i in (3, 4, 5)] == [3, 4, 5]
    assert got[6].n_shingles == 1 and got[7].component_id == 6
    assert got[8].component_id == 8 and got[8].kept
    assert got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(none).count() == 0


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(1)
    est, chance = [], []
    for _ in range(400):
        a, b = (np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) * np.uint64(2) for _ in "ab")
        est.append(minhash.estimate(minhash.sketch(a), minhash.sketch(b), np.array(400.0), np.array(400.0)))
        chance.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(est)) < 2e-4
    assert abs(np.mean(chance) - minhash.collision_rate(np.array(400.0), np.array(400.0))) < 1e-4
    shared = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) * np.uint64(2)
    assert abs(minhash.estimate(minhash.sketch(shared[:850]), minhash.sketch(shared[50:]), np.array(850.0), np.array(850.0)) - 800 / 900) < 0.15


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (50, 50)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_word_hashes_are_bounded():
    h = WordHashes(10)
    assert len(h.of([b"%d" % i for i in range(100)])) == 100 and len(h) <= 10
