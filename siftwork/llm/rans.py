"""Token ids as compressed binary blocks: a static range asymmetric numeral system (rANS).

A dataset of three tables in one folder:
  frequencies  id, frequency     one table for all blocks, scaled to 2^22; ids that never occur are absent
  blocks       part, block, start, n_tokens, doc_ids, lengths, states, marks, words, crc32
  parts        part, start       ids in all parts before
Parts are ranges of doc_id in ascending order, blocks are runs of whole documents within a part. In a block, 1,024 coders
work side by side: coder i has the ids i, i + 1024, ...; their 32-bit words are interleaved in one stream. Every 128
steps, marks hold the coders' states and the place in the stream, so that a block can be decoded from there, too;
crc32 is that of the decoded ids as little-endian 32-bit integers.

Blocks don't depend on each other: they are written and decoded by any task, and lost tasks are run again.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import discard, shared_folder, stored, text_bytes

LANES, EVERY, SCALE = 1024, 128, 22
BLOCK_TOKENS = 1 << 19
END = 2
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
REMEMBERED = 500_000


def scaled(counts: dict[int, int], bits: int = SCALE) -> dict[int, int]:
    """Frequencies that sum to 2^bits, at least 1 for each id that occurs; the commonest ids take what rounding leaves."""
    if not counts:
        return {}
    total, size = sum(counts.values()), 1 << bits
    if len(counts) > size:
        raise ValueError(f"{len(counts)} ids don't fit into a scale of {size}")
    out = {i: max(1, n * size // total) for i, n in counts.items()}
    left = size - sum(out.values())
    for i in sorted(counts, key=lambda i: (-counts[i], i)):
        if not left:
            break
        change = left if left > 0 else -min(-left, out[i] - 1)
        out[i], left = out[i] + change, left - change
    return out


class Table:
    """Frequencies and their running sums, by symbol number and id."""

    def __init__(self, frequency: dict[int, int], bits: int = SCALE):
        self.bits = bits
        self.ids = np.array(sorted(frequency), np.int64)
        self.frequency = np.array([frequency[i] for i in self.ids.tolist()], np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.frequency)[:-1])).astype(np.uint64) if len(self.ids) else np.zeros(0, np.uint64)
        self.number = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 0, np.int32)
        self.number[self.ids] = np.arange(len(self.ids))
        self._symbols: np.ndarray | None = None

    def symbols(self) -> np.ndarray:
        """The symbol number of each slot."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.ids)), self.frequency.astype(np.int64)).astype(np.int32)
        return self._symbols


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> tuple[bytes, bytes, bytes]:
    """(states, marks, words) of a block: 64-bit states before the first id, marks every `every` steps, 32-bit words."""
    symbol = table.number[ids]
    steps = -(-len(ids) // lanes)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    f, c = table.frequency[symbol], table.start[symbol]
    full = f << top
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    count = 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min((t + 1) * lanes, len(ids))
        x, fr = state[: b - a], f[a:b]
        high = np.flatnonzero(x >= full[a:b])
        if len(high):
            words.append((x[high] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            x[high] >>= _WORD
            count += len(high)
        q = x // fr
        state[: b - a] = (q << bits) + (x - q * fr) + c[a:b]
        if t and t % every == 0:
            marks.append((count, state.copy()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    marked = b"".join(np.uint64(count - n).tobytes() + s.tobytes() for n, s in reversed(marks))
    return state.tobytes(), marked, stream.tobytes()


def decode(states: bytes, marks: bytes, words: bytes, n: int, table: Table, lanes: int = LANES, every: int = EVERY, first: int = 0) -> np.ndarray:
    """Ids of a block from step first * every on, as unsigned 32-bit integers."""
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    at = 0
    state = np.frombuffer(states, np.uint64).copy()
    if first:
        record = marks[(first - 1) * 8 * (lanes + 1) : first * 8 * (lanes + 1)]
        at, state = int(np.frombuffer(record[:8], np.uint64)[0]), np.frombuffer(record[8:], np.uint64).copy()
    bits, mask, slots = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), table.symbols()
    begin = first * every * lanes
    out = np.empty(n - begin, np.int32)
    for t in range(begin, n, lanes):
        m = min(lanes, n - t)
        x = state[:m]
        slot = x & mask
        symbol = slots[slot.astype(np.int64)]
        out[t - begin : t - begin + m] = symbol
        x = table.frequency[symbol] * (x >> bits) + slot - table.start[symbol]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = x[low] << _WORD | stream[at : at + len(low)]
            at += len(low)
        state[:m] = x
    return table.ids[out].astype("<u4")


#: Latin letters, lower case last, and ASCII signs (none of special tokens or contractions) that may follow a word.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF), *range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_SIGNS = "!#$%&()*+,-./:;=?@_~"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([{re.escape(_SIGNS)}]*)")


class Tokens(dict):
    """Ids of words (as bytes) as little-endian 32-bit integers, remembered within a bound.

    The words of the last generation go over to the next one when they are asked for again, so common words stay. Right
    for tokenizers whose pre-tokenizer never joins what ASCII white space separates, and drops that white space.

    Where the tokenizer takes Latin letters as one piece and signs behind them as another, a word of these goes to its
    model directly, piece by piece; any other word takes the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.tokenize, self.before = tokenizer.encode, tokenizer.model.tokenize, {}
        self.lower = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.written = self._letters(tokenizer)

    @staticmethod
    def _letters(tokenizer) -> dict[int, str] | None:
        """How the pre-tokenizer writes each lower-case letter; None if it doesn't split words as _PLAIN does."""
        split = tokenizer.pre_tokenizer and tokenizer.pre_tokenizer.pre_tokenize_str
        low = _LETTERS.lower()
        if not split or tokenizer.normalizer is None or tokenizer.normalizer.normalize_str(_LETTERS + _SIGNS) != low + _SIGNS:
            return None
        written = {ord(c): split(c)[0][0] for c in low}
        return written if [x for x, _ in split(low + _SIGNS)] == [low.translate(written), _SIGNS] else None

    def _encoded(self, word: str) -> bytes:
        match = _PLAIN.fullmatch(word) if self.written else None
        if match is None:
            ids = self.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        letters, signs = match.groups()
        if signs:
            return self[letters.lower().encode()] + self[signs.encode()]
        ids = [t.id for t in self.tokenize(letters.lower().translate(self.written))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self._encoded(word.decode())
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found

    def of(self, texts: list[bytes], end: bytes) -> list[bytes]:
        out = []
        for text in texts:
            # The tokenizer lower-cases; in ASCII that can come first, unless a special token might be spelt by it.
            if b"<" not in text:
                if self.lower and text.isascii():
                    text = text.lower()
                elif self.written and max(text) < 0xC4:  # Latin-1 as UTF-8: each letter has one lower-case form, whatever is beside it
                    text = text.decode().lower().encode()
            out.append(b"".join(map(self.__getitem__, text.split())) + end)
        return out


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """docs (doc_id, text) in ascending order of doc_id, nulls first: part, place (ids of the part before), doc_id, ids."""
    # A row that repeats a doc_id follows in order of its text, so that a task run again gives the same part.
    rows = docs.select("doc_id", text_bytes().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place = tokens(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                # bytes.split() knows just the six ASCII characters.
                ids = own.of(some.column("text").to_pylist(), mark)
                places = np.cumsum([0, *(len(x) // 4 for x in ids)])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(place + places[:-1], pa.int64()), some.column("doc_id"), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "ids"])
                place += int(places[-1])

    return rows.mapInArrow(run, "part int, place long, doc_id long, ids binary")


def id_counts(tokens_: DataFrame) -> DataFrame:
    """How often each id occurs: at most a row per id and task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return tokens_.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_BLOCK = "part int, block long, start long, n_tokens long, doc_ids array<long>, lengths array<long>, states binary, marks binary, words binary, crc32 long"


def encoded_blocks(tokens_: DataFrame, frequency: dict[int, int]) -> DataFrame:
    """Blocks of whole documents of about 2^19 ids; a longer document is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = Table(frequency), [], 0

        def block() -> pa.RecordBatch:
            raw = b"".join(x[3] for x in held)
            states, marks, words = encode(np.frombuffer(raw, "<u4"), table)
            row = {"part": held[0][0], "block": held[0][1], "start": held[0][1], "n_tokens": len(raw) // 4, "doc_ids": [x[2] for x in held], "lengths": [len(x[3]) // 4 for x in held], "states": states, "marks": marks, "words": words, "crc32": zlib.crc32(raw)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("states", pa.binary()), ("marks", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "ids"))):
                # A part that was read in pieces, or another part, begins another block.
                if held and (row[0] != held[-1][0] or row[1] != held[-1][1] + len(held[-1][3]) // 4 or size + len(row[3]) // 4 > BLOCK_TOKENS):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // 4
        if held:
            yield block()

    return tokens_.select("part", "place", "doc_id", "ids").mapInArrow(run, _BLOCK)


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Write docs (doc_id, text) as token ids into folder; null and empty texts have the end id alone."""
    rows, at = stored(tokenized(docs, path, end), "ids")
    spark = docs.sparkSession
    counts = {r["id"]: r["n"] for r in id_counts(rows).collect()}  # a number per id of the vocabulary
    frequency = scaled(counts)
    spark.createDataFrame(list(frequency.items()), "id long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    encoded_blocks(rows, frequency).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(spark, at)
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("part", before.alias("start")).write.parquet(f"{folder}/parts")  # a row per part


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit integers).

    A block whose checksum doesn't hold raises an error that names it.
    """
    frequency = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{folder}/frequencies").collect()}
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequency)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                raw = decode(row["states"], row["marks"], row["words"], row["n_tokens"], table).tobytes()
                if zlib.crc32(raw) != row["crc32"]:
                    raise ValueError(f"part {row['part']}, block {row['block']}: the checksum doesn't hold")
                ends = np.cumsum([0, *row["lengths"]])
                ids = [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(ids), pa.int32()), pa.array(row["start"] + ends[:-1], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "n_tokens", "ids"])

    rows = blocks.mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids binary")
    parts = spark.read.parquet(f"{folder}/parts")
    return rows.join(parts, "part").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids")


def token_index(docs: DataFrame, path: str, end: int = END, folder: str | None = None) -> DataFrame:
    """docs written to folder and read again: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/siftwork/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, end)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
