"""Language identification by compression: the language whose dictionary makes a text smallest.

A raw-content zstandard dictionary is cut from a bounded sample of labelled rows per language; a text is compressed with
each of them, in blocks of BLOCK bytes that know only the dictionary, and the sum of sizes beyond empty frames is compared:
all parts of a text count alike, and the margin does not depend on its length. The model is a few hundred KB, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample that a model is made from: languages, documents and characters of each, bytes per dictionary.
LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 240, 1_200, 112 << 10
#: Texts up to this many bytes are also compressed behind short pieces of each language: CONTEXTS of CONTEXT_BYTES.
SHORT, CONTEXTS, CONTEXT_BYTES = 400, 6, 3000
#: Bytes of a text that are compressed at a time.
BLOCK = 32 << 10
#: A text is rejected if the second-best language comes closer than this part of its size.
MARGIN = 0.003
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def plain(text: str) -> bytes:
    """The text's letters in lower case, runs of anything else as one space."""
    return (" ".join(_LETTERS.findall(text.lower()))).encode()


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary per language from labelled (doc_id, text, lang); rows without text or lang don't count.

    Of the LANGUAGES languages with most rows, SAMPLE_DOCS rows each in hash order, SAMPLE_CHARS characters of each.
    """
    rows = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    # A share of each language that holds the sample with near certainty goes into the window, not all its rows.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * SAMPLE_DOCS + 40) / n))])
    place = F.xxhash64("doc_id", F.lit(23))
    some = rows.select("lang", "doc_id", F.expr(f"substring(text, 1, {SAMPLE_CHARS})").alias("piece"), place.alias("place"))
    some = some.where(F.pmod("place", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "piece")
    sample = some.withColumn("row", F.row_number().over(order)).where(F.col("row") <= SAMPLE_DOCS)
    pieces: dict[str, list[bytes]] = {}
    for r in sample.select("lang", "row", "piece").orderBy("lang", "row").collect():  # LANGUAGES * SAMPLE_DOCS rows at most
        pieces.setdefault(r["lang"], []).append(plain(r["piece"]))
    return {lang: b" ".join(dict.fromkeys(p))[:DICTIONARY_BYTES] for lang, p in sorted(pieces.items()) if b"".join(p)}


class Model:
    """Compressors of each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        settings = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "search_log": 4, "window_log": 18, "chain_log": 17, "hash_log": 17, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compressors, self.contexts = [], []
        self.bare = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTULTRA, min_match=3, search_log=7, target_length=64, window_log=17, chain_log=16, hash_log=16))
        for raw in dictionaries.values():
            made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(**settings))
            self.compressors.append((made, len(made.compress(b""))))
            step = max(1, len(raw) // CONTEXTS)
            pieces = [raw[i * step : i * step + CONTEXT_BYTES] + b" " for i in range(CONTEXTS)]
            self.contexts.append([(p, len(self.bare.compress(p))) for p in pieces])

    def predict(self, text: str) -> tuple[str, float]:
        """(language, margin): how much larger the second-best size is, as part of it; 1 if there is one language.

        A short text, or one of equal words, may be too small to gain from a far match; then its distinct words are
        compressed behind near pieces of each dictionary, whose letter statistics count as well.
        """
        # Fractions and the like are word characters, too, but no letters.
        raw = plain(text) if any(map(str.isalpha, text)) else b""
        if not raw or not self.languages:
            return UNKNOWN, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) - empty for b in blocks) for c, empty in self.compressors]
        if len(raw) <= SHORT or sorted(sizes)[:2] == [min(sizes)] * 2:
            words = b" ".join(dict.fromkeys(raw.split()))
            sizes = [sum(len(self.bare.compress(p + words)) - n for p, n in own) for own in self.contexts]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.languages[best], (second - sizes[best]) / max(1, second)


@lru_cache(2)
def model(items: tuple[tuple[str, bytes], ...]) -> Model:
    return Model(dict(items))


def predicted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with _language, struct<lang_pred, score (0 to 1), rejected>, from whole texts alone.

    lang_pred is `und` for null texts and texts without letters, whose score is 0; those and texts with a margin below
    MARGIN are rejected.
    """
    items = tuple(dictionaries.items())
    names = docs.columns
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(items)
        for batch in batches:
            got = [(UNKNOWN, 0.0) if t is None else own.predict(t) for t in batch.column("text").to_pylist()]
            found = [{"lang_pred": lang, "score": min(1.0, max(0.0, score)), "rejected": lang == UNKNOWN or score < MARGIN} for lang, score in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "_language"])

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + ["_language struct<lang_pred:string,score:double,rejected:boolean>"])
    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.

    The model is made from rows with lang whose crc32(doc_id) mod 4 is not 2; lang is no input of a prediction. Rows
    without doc_id are not held out and not learned from.
    """
    docs = docs.select("doc_id", "text", "lang")
    dictionaries = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return predicted(rows, dictionaries).select("doc_id", "held_out", "_language.*")
