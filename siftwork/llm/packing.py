"""Packing by concatenating and cutting: all token streams end to end, cut into windows of one length.

1. Documents are encoded once and written, each with the part (task) that it came from and the ids of the part before it.
2. Prefix sums over the parts' totals, a row per part, turn places within parts into places in the whole stream.
3. Each part cuts its own stretch of the stream: windows that lie within it are finished sequences; what belongs to a
   window that begins or ends in another part is a boundary record, two per part and one per whole part inside a long
   window. Boundary records alone are shuffled, and joined to sequences by their offsets.

Only the last sequence can be short, so that less than one window is padding. A task that is lost cuts its part again.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import stored
from siftwork.llm.segments import ByteLevel, Remembered, byte_level, spaced

LENGTH, END = 1024, 0


class Ids:
    """Token ids of texts as little-endian 32-bit integers, as the tokenizers library gives them, special tokens in texts included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.apart = byte_level(self.tokenizer)
        self.ids = ByteLevel(self.tokenizer, self.special).ids
        self.first, self.known = Remembered(self._encoded, 50_000), Remembered(lambda some: self._encoded([" " + s for s in some]))

    def _encoded(self, some: list[str]) -> Iterator[bytes]:
        return (array("I", ids).tobytes() for ids in self.ids(some))

    def _cut(self, text: str) -> tuple[str, list[str]]:
        # Beside a special token white space is read as at the end of a text, so such a text is encoded as it is.
        return spaced(text) if self.apart and not any(s in text for s in self.special) else (text, [])

    def of(self, texts: list[str | None], end: bytes) -> list[bytes]:
        cut = [self._cut(t or "") for t in texts]
        first, rest = self.first.of([[f] for f, _ in cut]), self.known.of([r for _, r in cut])
        return [b"".join(f) + b"".join(r) + end for f, r in zip(first, rest)]


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """docs (doc_id, text) as part, place (ids of the part before), n (its own), doc_id, ids with the end id; to be stored before use."""
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place = ids_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = own.of(some.column("text").to_pylist(), mark)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = place + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(ends - n), pa.array(n), some.column("doc_id"), pa.array(ids, pa.binary())], ["part", "place", "n", "doc_id", "ids"])
                place = int(ends[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, place long, n long, doc_id long, ids binary")


def placed(tokens: DataFrame) -> DataFrame:
    """tokens (part, place, n, doc_id, ids) with at, the document's place in the stream of all parts in order."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, _ = stored(totals.select("part", before.alias("first")), "parts")  # a row per part: as files, so that Spark knows its size
    return tokens.join(starts, "part").select("part", (F.col("first") + F.col("place")).alias("at"), "doc_id", "ids")


def pieces(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """placed rows cut where windows end: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = batch.column("ids").to_pylist(), batch.column("at").to_numpy()
            n = np.array([len(x) // 4 for x in raw], np.int64)
            count = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(raw)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)  # of the piece within its document
            first = np.maximum((at[row] // length + number) * length, at[row])
            start = first - at[row]
            long = np.minimum((first // length + 1) * length, at[row] + n[row]) - first
            crc = [zlib.crc32(memoryview(raw[r])[4 * s : 4 * (s + k)]) for r, s, k in zip(row.tolist(), start.tolist(), long.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, long)), pa.array(crc, pa.int64()), *map(pa.array, (n[row], first // length, first % length))], names)

    return rows.select("at", "doc_id", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def padded_length(n: int, length: int = LENGTH) -> int:
    """The length to which n ids are padded: a power of two stays as it is."""
    return n if n & (n - 1) == 0 else length


def sequences(rows: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """placed rows as sequences: sequence_id, n_tokens (without padding), ids array<int>, padded as padded_length says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin = bytearray(), None  # what isn't finished of the window at begin

        def rows_of(found: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["sequence_id", "offset", "whole", "ids"])

        for batch in batches:
            found = []
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
                if begin is not None and at != begin + len(held) // 4:  # the file was dealt in pieces, or another part begins
                    found.append((begin // length, begin % length, False, bytes(held)))
                    held, begin = bytearray(), None
                begin = at if begin is None else begin
                held += ids
                done = 0
                while (room := length - begin % length) <= len(held) // 4 - done:
                    found.append((begin // length, begin % length, room == length, bytes(held[4 * done : 4 * (done + room)])))
                    begin, done = begin + room, done + room
                del held[: 4 * done]
                if not held:
                    begin = None
            if found:
                yield rows_of(found)
        if held:
            yield rows_of([(begin // length, begin % length, False, bytes(held))])

    stretches, _ = stored(rows.select("part", "at", "doc_id", "ids").mapInArrow(run, "sequence_id long, offset long, whole boolean, ids binary"), "windows")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            n = [len(x) for x in ids]
            full = [np.pad(x, (0, padded_length(len(x), length) - len(x)), constant_values=pad) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "ids"])

    # At most two boundary records a task, and a window's worth of them in one group: length at most.
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = stretches.where("not whole").groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))
    return stretches.where("whole").select("sequence_id", "ids").unionByName(joined).mapInArrow(finished, "sequence_id long, n_tokens long, ids array<int>")


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs (doc_id, text) encoded, written and placed in the stream, for pieces() and sequences().

    Null and empty texts are their end id alone. Rows that repeat, with or without doc_id, follow each other as they are
    read; texts of any length are encoded whole and span as many windows as they need. No rows give no pieces and no
    sequences. Other columns are left out.
    """
    tokens, _ = stored(encoded(docs, path, end), "stream")
    return placed(tokens)


def piece_digests(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Per piece of docs in their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pieces(packed(docs, path, length, end), length)
