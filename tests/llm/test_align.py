"""Token alignment against a plain version that works on whole texts, without segments or labels."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftwork.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def ranges(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(libraries, texts):
    """Rows as the operator gives them, from whole texts and all pairs of tokens side by side."""
    a, b = libraries
    letters = align.byte_letters()
    found, count = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append(None)
            continue
        at_a, at_b = ranges(bytes_a), ranges(bytes_b)
        links = [(ids_a[i], ids_b[j]) for i, (x, y) in enumerate(at_a) for j, (u, v) in enumerate(at_b) if max(x, u) < min(y, v)]
        cuts = sorted({y for _, y in at_a} & {v for _, v in at_b})
        groups = [(",".join(str(t) for t, (x, y) in zip(ids_a, at_a) if lo < y <= hi), ",".join(str(t) for t, (x, y) in zip(ids_b, at_b) if lo < y <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        found.append((len(ids_a), len(ids_b), links, groups))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for row in found:
        if row is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = row
        digest = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest()
        rows.append((n_a, n_b, len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), digest))
    return rows


def short_texts():
    r = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "the", "a", "b", "é", "日本", "<|endoftext|>", "▁", "'s", "12", "!!", "\xa0", "　", "\x1c", "\x85", "​", "😀", "<s>", ")", "x́"]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 10))) for _ in range(800)]


def test_equals_plain_version(spark, libraries):
    texts = [*short_texts(), None, "", "one two", "one two", "x" * 3000, "no space " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in align.link_digests(docs, A, B).collect()}
    assert [rows[i] for i in range(len(texts))] == plain(libraries, texts)


def test_blocks_of_any_size(spark, documents, monkeypatch, libraries):
    docs = documents.where("length(text) < 2000")
    whole = sorted(map(tuple, align.link_digests(docs, A, B).collect()), key=repr)
    monkeypatch.setattr(align, "BLOCK_LINKS", 500)
    assert sorted(map(tuple, align.link_digests(docs.repartition(7), A, B).collect()), key=repr) == whole
    some = docs.orderBy("doc_id").collect()
    want = plain(libraries, [r["text"] for r in some])
    assert {r[0]: r[1:] for r in whole} == {r["doc_id"]: w for r, w in zip(some, want)}


def test_groups_of_a_text(spark, libraries):
    text = "Überraschung\tund  naïveté, 日本"
    row = align.aligned(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "▁", "z")], "doc_id long, text string, groups string"), A, B).orderBy("doc_id").collect()
    assert [len(r["groups"]) > 0 for r in row] == [True, False, False]
    groups, raw = row[0]["groups"], (" " + text).encode()
    assert [g["start"] for g in groups] == [0, *[g["stop"] for g in groups[:-1]]] and groups[-1]["stop"] == len(raw)
    assert [i for g in groups for i in g["a"]] == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert [i for g in groups for i in g["b"]] == libraries[1].encode(text)


def test_labels():
    assert align.labels([2, 5], [3, 5], 5) == b"nabnc"
    assert list(align.groups([2, 3], [3, 2])) == [(2, 2, [(0, 0), (1, 0), (1, 1)])]
    assert list(align.groups([1, 1, 2], [2, 2])) == [(2, 1, [(0, 0), (1, 0)]), (1, 1, [(0, 0)])]


def test_edges_and_long_text(spark, edges, none):
    rows = align.link_digests(edges, A, B).collect()
    assert len(rows) == edges.count() and {tuple(r[c] for c in NAMES) for r in rows if r["doc_id"] in (3, 4)} == {(0, 0, 0, 0, 0, 0, "")}
    same = [tuple(r) for r in rows if r["doc_id"] == 8]
    assert len(same) == 2 and same[0] == same[1]
    assert align.link_digests(none, A, B).count() == 0
    long = spark.createDataFrame([(1, "alpha beta, gamma\n" * 60_000)], "doc_id long, text string")
    one = spark.createDataFrame([(1, "alpha beta, gamma\n")], "doc_id long, text string")
    (big,), (small,) = align.link_digests(long, A, B).collect(), align.link_digests(one, A, B).collect()
    assert big["n_groups"] > 59_000 * small["n_groups"] and big["count_sum"] == big["n_links"]
