"""The five stages on small tables, each on its own input, against what the operators' plain forms give."""

import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from siftwork.llm import bpe, langid
from tests.llm.test_minhash import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "pii", "mixing", "byte_bpe"]
    stage = dict(corpus_pipeline.STAGES)

    first = stage["language_id"](spark, docs, sf)
    assert first.columns == docs.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert len(kept) >= 0.97 * len(before) and all(kept[i].text == before[i].text for i in kept)

    second = stage["near_dedup"](spark, first, sf)
    components = brute([(i, r.text) for i, r in kept.items()], 5, 80)
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, (_, c) in components.items() if i == c)

    third = stage["pii"](spark, second, sf)
    clean = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns and not any("@mail" in r.text for r in clean.values())
    assert sum("<EMAIL>" in r.text for r in clean.values()) == sum("@mail" in r.text for r in second.collect())

    fourth = stage["mixing"](spark, third, sf)
    counts = Counter(r.doc_id for r in fourth.collect())
    assert fourth.columns == docs.columns and max(counts.values()) <= 2

    fifth = stage["byte_bpe"](spark, fourth, sf).collect()
    public = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks.rank, special_tokens={})
    assert len(fifth) == sum(counts.values())
    for r in random.Random(1).sample(fifth, 40):
        assert r.ids == public.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_run_on_edges(spark, edges, tmp_path):
    edges.select("doc_id", "text", "lang", "source").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {r.doc_id for r in out.collect()} <= {1, 2, 3, 4, 5, 6, 7, 8, 9, None}


def test_rejected_documents_go(spark, documents):
    odd = spark.createDataFrame([(10_000, "12345 !!"), (10_001, None)], "doc_id long, text string")
    both = documents.select("doc_id", "text").union(odd).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    ids = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, "").collect()}
    assert not ids & {10_000, 10_001} and len(ids) > 150
    assert langid.UNKNOWN == "und"


def test_each_stage_on_edges(spark, edges, none):
    """Nulls in any column, repeated rows, columns of clashing names, and no rows at all."""
    docs = edges.selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns + (["ids", "n_tokens"] if name == "byte_bpe" else [])
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
        assert stage(spark, docs.limit(0), "").count() == 0
