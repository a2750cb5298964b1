import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwork.llm import rans
from siftwork.llm.common import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


def table_of(ids):
    values, counts = np.unique(ids, return_counts=True)
    return rans.Table(rans.scaled(dict(zip(values.tolist(), counts.tolist()))))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, 300_000])
def test_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 49_000).astype("<u4")
    table = table_of(ids)
    states, marks, words = rans.encode(ids, table)
    assert (rans.decode(states, marks, words, n, table) == ids).all()
    for first in range(1, n // (rans.EVERY * rans.LANES) + (n % (rans.EVERY * rans.LANES) > 0)):
        assert (rans.decode(states, marks, words, n, table, first=first) == ids[first * rans.EVERY * rans.LANES :]).all()


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(1).zipf(1.4, 400_000) % 49_000).astype("<u4")
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(rans.encode(ids, table_of(ids))[2]) * 8 / len(ids) < -(p * np.log2(p)).sum() * 1.01


def test_frequencies_fill_the_scale():
    for counts in ({1: 1}, {1: 10**9, 2: 1, 3: 1}, {i: 1 for i in range(1000)}, {i: i + 1 for i in range(49_000)}):
        out = rans.scaled(counts)
        assert sum(out.values()) == 1 << rans.SCALE and min(out.values()) >= 1
    assert rans.scaled({}) == {}


def want(rows):
    own, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    rows += [(10_000, "A<|endoftext|>b  it's 12 x\x1cy z Ü̈ İ 日本 é"), (10_001, None), (10_002, ""), (10_003, "x" * 50_000), (10_004, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, rans.token_index(docs, PATH).collect()))
    assert got == want(rows)


def test_a_damaged_block_is_found(spark, documents):
    folder = f"{shared_folder(spark)}/damaged-{uuid.uuid4().hex}"
    rans.write_tokens(documents, folder, PATH)
    bad = spark.read.parquet(f"{folder}/blocks").selectExpr("* EXCEPT (crc32)", "crc32 + 1 AS crc32")
    bad.write.parquet(f"{folder}-2/blocks")
    for t in ("frequencies", "parts"):
        spark.read.parquet(f"{folder}/{t}").write.parquet(f"{folder}-2/{t}")
    with pytest.raises(Exception, match="checksum"):
        rans.read_tokens(spark, f"{folder}-2").count()


def test_edges(edges, none):
    out = rans.token_index(edges, PATH).collect()
    assert len(out) == edges.count() and sum(r.n_tokens for r in out if r.doc_id in (3, 4, 5)) == 3
    assert rans.token_index(none, PATH).count() == 0
