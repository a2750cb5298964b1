"""Token groups of two tokenizers over the same bytes, and how often their tokens meet.

Each byte of a text gets a letter: n where no token ends, a or b where one of that tokenizer ends, c where both do. A
regular expression takes spans up to each c; the letters of a span say how many tokens of each side it holds, and which
overlap. As every segment ends in c, spans are found segment by segment and remembered.

1. Documents are gathered into blocks of a bounded number of links, written once: per document its counts and digest,
   per block its distinct id pairs, in how many of its documents each occurs, and each document's places in that list.
2. Pairs are counted over blocks, and the highest count of each A id is found.
3. Each block asks for its own pairs by a join; what comes back meets the block's documents in one group per block.

No text is shuffled; a pair that all documents hold is in as many rows as there are blocks.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import stored
from siftwork.llm.segments import ByteLevel, Remembered, byte_letters, byte_level, spaced

#: A block ends at so many links; a longer document is a block of its own.
BLOCK_LINKS = 1 << 20
#: Spans up to this many bytes are remembered.
SHORT = 64
_SPAN = re.compile(rb"[nab]*c")
_END = re.compile(rb"[abc]")


def labels(a_ends: Iterable[int], b_ends: Iterable[int], n: int) -> bytes:
    """One letter for each of n bytes: n, a, b or c (both), from the places behind which tokens end."""
    row = bytearray(b"n") * n
    for end in a_ends:
        row[end - 1] = 97
    for end in b_ends:
        row[end - 1] = 99 if row[end - 1] == 97 else 98
    return bytes(row)


def _shape(span: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    """How many tokens of each side a span up to c holds, and which overlap, by their places in it."""
    a = b = 0
    links = []
    for end in _END.findall(span):
        links.append((a, b))
        a, b = a + (end != b"b"), b + (end != b"a")
    return a, b, links


_known_shape = lru_cache(1 << 16)(_shape)


def groups(a_lengths: list[int], b_lengths: list[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Of two token sequences over the same bytes: the number of A and of B tokens of each group, and its overlapping pairs."""
    row = labels(accumulate(a_lengths), accumulate(b_lengths), sum(a_lengths))
    return [_known_shape(span) if len(span) <= SHORT else _shape(span) for span in _SPAN.findall(row)]


class Aligner:
    """Both tokenizers, and the aligned segments of texts, remembered within a bound."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a_ids = ByteLevel(self.a).ids
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters.get(c, 0) for c in token) for token, i in self.a.get_vocab().items()}
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.names = list(map(str, range(max(*self.a_bytes, len(pieces)) + 1)))
        self.apart = byte_level(self.a) and not any(re.search("[^▁]▁", p) for p in pieces)
        self.known = Remembered(self._worked)

    def cut(self, text: str) -> list[str]:
        """The segments of a space and the text, each without its first space; the whole text for tokenizers of another kind."""
        if not self.apart:
            return [text]
        first, rest = spaced(" " + text)
        return [first[1:], *rest] if first else rest

    def _b_ids(self, some: list[str]) -> list[list[int]]:
        """B's ids of segments: it adds a space to what it is given, but not to nothing."""
        nothing = self.b.encode("\n ")[len(self.b.encode("\n")) :]
        return [ids if s else nothing for s, ids in zip(some, self.b.encode(some, num_threads=1))]

    def _worked(self, some: list[str]) -> Iterator[tuple[bytes, bytes, int] | None]:
        """Of segments: (groups in decimal, pairs of linked ids as 64-bit integers, A tokens + 2^32 B tokens); None if bytes differ."""
        a_bytes, b_bytes, names = self.a_bytes, self.b_bytes, self.names
        own = [" " + s for s in some]
        for text, a, b in zip(own, self.a_ids(own), self._b_ids(some)):
            raw = text.encode()
            a_parts, b_parts = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
            if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
                yield None
                continue
            out, pairs, i, j = [], [], 0, 0
            for n_a, n_b, links in groups(list(map(len, a_parts)), list(map(len, b_parts))):
                if n_a == n_b == 1:
                    out.append(f"{names[a[i]]}|{names[b[j]]}")
                    pairs.append(a[i] << 32 | b[j])
                else:
                    out.append(f"{','.join([names[x] for x in a[i : i + n_a]])}|{','.join([names[x] for x in b[j : j + n_b]])}")
                    pairs += [a[i + p] << 32 | b[j + q] for p, q in links]
                i, j = i + n_a, j + n_b
            yield ";".join(out).encode(), array("Q", pairs).tobytes(), len(a) | len(b) << 32

    def of(self, texts: list[str | None]) -> list[tuple[bytes, bytes, int, int] | None]:
        """Per text, of a space and the text: groups in decimal, linked pairs, A tokens, B tokens; None without tokens."""
        found = []
        for own in self.known.of([self.cut(t) if t else [] for t in texts]):
            if not own or None in own:
                found.append(None)
                continue
            text, pairs, counts = zip(*own)
            n = sum(counts)
            found.append((b";".join(text), b"".join(pairs), n & 0xFFFFFFFF, n >> 32))
        return found


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (doc_id, text, ...) with groups: array of (start, stop, a, b), the byte range in space+text and the ids of both sides.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no groups. A column groups is replaced.
    """
    docs = docs.drop("groups")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for found in own.of(some.column("text").to_pylist()):
                    row, stop = [], 0
                    for group in found[0].decode().split(";") if found else []:
                        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                        start, stop = stop, stop + sum(len(own.a_bytes[i]) for i in a)
                        row.append({"start": start, "stop": stop, "a": a, "b": b})
                    out.append(row)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, kind)], [*names, "groups"])

    kinds = [f"`{c}` {t}" for c, t in docs.dtypes] + ["groups array<struct<start:bigint,stop:bigint,a:array<int>,b:array<int>>>"]
    return docs.mapInArrow(run, ", ".join(kinds))


_DOCUMENTS = [("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("digests", pa.list_(pa.string()))]
_BLOCK = pa.schema([("block", pa.int64()), *_DOCUMENTS, ("pairs", pa.binary()), ("held_by", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("ends", pa.binary())])
_BLOCK_SQL = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, pairs binary, held_by binary, places binary, times binary, ends binary"


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """rows (doc_id, n_a, n_b, n_groups, digest, linked pairs) as one row: distinct pairs, and by document its places in them."""
    links = [np.frombuffer(r[5], "<u8") for r in rows]
    pairs, place = np.unique(np.concatenate(links), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in links])
    keys, times = np.unique(owner * max(1, len(pairs)) + place, return_counts=True)
    places = keys % max(1, len(pairs))
    ends = np.searchsorted(keys, np.arange(1, len(rows) + 1) * max(1, len(pairs)))
    held_by = np.bincount(places, minlength=len(pairs))
    columns = [[list(c)] for c in list(zip(*rows))[:5]]
    binary = [pairs.astype("<u8"), held_by.astype("<u4"), places.astype("<u4"), times.astype("<u4"), ends.astype("<u4")]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[number], *columns, *[[x.tobytes()] for x in binary]], _BLOCK)], schema=_BLOCK)


def linked_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (doc_id, text) as blocks of documents, numbered by task; to be stored before use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        held, links = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, found in zip(some.column("doc_id").to_pylist(), own.of(some.column("text").to_pylist())):
                    if found is None:
                        row = (doc_id, 0, 0, 0, "", b"")
                    else:
                        text, pairs, n_a, n_b = found
                        row = (doc_id, n_a, n_b, text.count(b"|"), hashlib.sha256(text).hexdigest(), pairs)
                    if held and links + len(row[5]) // 8 > BLOCK_LINKS:
                        yield _block(number, held)
                        held, links, number = [], 0, number + 1
                    held.append(row)
                    links += len(row[5]) // 8
        if held:
            yield _block(number, held)

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK_SQL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): each linked id pair (A id << 32 | B id), the documents that hold it, and the highest n of its A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.to_pydict()
            pairs, back = np.unique(np.frombuffer(b"".join(raw["pairs"]), "<i8"), return_inverse=True)
            n = np.bincount(back, np.frombuffer(b"".join(raw["held_by"]), "<u4"), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counts = blocks.select("pairs", "held_by").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # A row for each B id at most in one A id's group.
    return counts.withColumn("best", F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))


def link_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows whose text links it, so rows that repeat count each for itself, with or without
    doc_id. Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros and an empty digest.
    Texts are aligned whole, whatever their length; ties for the highest count are all best. No rows give no rows; other
    columns are left out.
    """
    blocks, _ = stored(linked_blocks(docs, a_path, b_path), "aligned")
    counts, _ = stored(pair_counts(blocks), "pairs")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
                pairs = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs)], ["block", "pair"])

    answers = blocks.select("block", "pairs").mapInArrow(asked, "block long, pair long").join(counts, "pair").select("block", "pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def solved(block: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: v[0] for c, v in block.to_pydict().items()}
        order = np.argsort(found.column("pair").to_numpy())  # the block's pairs are in this order, too
        n, best = found.column("n").to_numpy()[order], found.column("is_best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        places, times = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["times"], "<u4").astype(np.int64)
        ends = np.concatenate(([0], np.frombuffer(row["ends"], "<u4").astype(np.int64)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (times, times * best[places], times * n[places])]
        return pa.table([pa.array(row["doc_ids"], pa.int64()), *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")), *map(pa.array, sums), pa.array(row["digests"], pa.string())], names)

    own = blocks.drop("pairs", "held_by").groupBy("block")
    return own.cogroup(answers.groupBy("block")).applyInArrow(solved, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
