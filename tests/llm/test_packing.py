"""Packing against a plain list of all ids, cut in one place."""

import struct
import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siftwork.llm import packing

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(docs, library, length):
    """Pieces tile every document and every sequence, and hold the library's ids."""
    rows = packing.packed(docs, PATH, length)
    pieces = packing.pieces(rows, length).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, library.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect())
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(len(ids) for _, ids in want)
    for number, own in by_sequence.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) == min(length, total - number * length)
    full = {r["sequence_id"]: r for r in packing.sequences(rows, length).collect()}
    assert sorted(full) == sorted(by_sequence)
    stream = []
    for number in sorted(full):
        r = full[number]
        assert len(r["ids"]) == packing.padded_length(r["n_tokens"], length) and not any(r["ids"][r["n_tokens"] :])
        stream += r["ids"][: r["n_tokens"]]
    assert len(stream) == total
    found = []  # documents as the stream has them
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        at = p["sequence_id"] * length + p["offset"]
        ids = stream[at : at + p["length"]]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == p["ids_crc32"]
        if p["start"] == 0:
            found.append((p["doc_id"] if p["doc_id"] is not None else -1, []))
        assert len(found[-1][1]) == p["start"]
        found[-1][1].extend(ids)
        assert p["doc_tokens"] >= p["start"] + p["length"]
    assert sorted(found) == want


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_equals_the_library(documents, library, parts):
    check(documents.select("doc_id", "text").repartition(parts), library, 1024)


@pytest.mark.parametrize("length", [1, 7, 64])
def test_small_windows_span_parts(spark, library, length):
    texts = ["a", "", None, "word " * 50, "x <|endoftext|>\n\n<|endoftext|> y\n\n<|endoftext|>", "<|endoftext|>", "  ", "\n\n\n", "a" * 300, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    check(docs, library, length)


def test_edges(edges, none, library):
    check(edges, library, 16)
    assert packing.piece_digests(none, PATH).count() == 0
    assert packing.sequences(packing.packed(none, PATH)).count() == 0


def test_long_text(spark, library):
    check(spark.createDataFrame([(1, "lorem ipsum " * 80_000), (2, "b")], "doc_id long, text string"), library, 1024)


def test_powers_of_two_are_not_padded():
    assert [packing.padded_length(n, 1024) for n in (1, 2, 3, 512, 1023, 1024)] == [1, 2, 1024, 512, 1024, 1024]
