import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.encoder(PATH, PATTERN).ranks.rank, special_tokens={})


def test_documents(documents, public):
    want = {r.doc_id: public.encode_ordinary(r.text) for r in documents.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in bpe.digests(documents, PATH, PATTERN).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_any_text(text):
    own = bpe.encoder(PATH, PATTERN)
    public = tiktoken.Encoding("test2", pat_str=PATTERN, mergeable_ranks=own.ranks.rank, special_tokens={})
    (ids,) = own.encode([text])
    assert ids == public.encode_ordinary(text) and own.ranks.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", [b"a" * 3000, b"abcdefgh" * 40, "é".encode() * 500, b"zq", b"ab" * 64, b"x" * 129])
def test_long_and_short_pieces_agree(piece, public):
    ranks = bpe.encoder(PATH, PATTERN).ranks
    want = public._encode_single_piece(piece)
    assert bpe.encode_long(piece, ranks) == want
    assert bpe.encode_together([piece, piece[:7], b"hi"], ranks, 1 << (len(piece) - 1).bit_length())[0] == want


def test_edges(edges, none):
    out = {r.doc_id: r for r in bpe.digests(edges, PATH, PATTERN).collect()}
    assert out[3].n_tokens == out[4].n_tokens == 0 and out[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(none, PATH, PATTERN).count() == 0
    assert bpe.encoded(edges, PATH, PATTERN).columns == [*edges.columns, "ids"]
