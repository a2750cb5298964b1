"""Five stages from raw documents to documents that are ready for training."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import bpe, langid, minhash, mixing, pii
from siftwork.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with what was recognised as lang; the model is made from the stage's input.

    Documents without text or letters go, as do those whose two best languages tie. Texts of any length are judged whole, and
    rows that repeat each for itself; no doc_id is no hindrance. Where no row has lang there is no model, and none is kept.
    """
    dictionaries = langid.learn(docs.where(~langid.held_out()))
    kept = langid.predicted(docs, dictionaries).where("not _language.rejected")
    return kept.withColumn("lang", F.col("_language.lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles: the one of smallest doc_id.

    Null and empty texts and rows without doc_id stay; rows that repeat a doc_id count as one document and stay or go together.
    Texts may have any length. No rows give no rows; other columns are carried, whatever their names.
    """
    gone = minhash.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it replaced by tags; n_chars follows the new text.

    Null texts stay null, with n_chars null, and empty ones empty; whole texts of any length are searched. Where spans overlap the
    first one's tag stands. Rows that repeat are all cleaned; no rows give no rows.
    """
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them.

    Null and empty texts have size 0; a null source is one of its own. Rows that repeat a doc_id with an equal text are taken alike.
    """
    return mixing.mixture(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, their tokens, and n_tokens; columns of these names are replaced.

    Null and empty texts have no ids; texts of any length are encoded whole, rows that repeat each for itself. No rows give no rows.
    """
    out = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Two stages, compression and sketches, are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
