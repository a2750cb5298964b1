"""Removal of repeated passages: windows of words that start earlier elsewhere, found behind a count-min sketch.

1. Of the eight-word runs inside a window, the one of smallest hash (leftmost of equals) is its anchor. Windows of equal words
   have equal anchors at equal offsets. A window's count is overestimated by one row of counters for windows, and by two
   rows for anchors (each place once): the least of three counts. Each task sketches its partition, and the sketches are
   merged by segment. Counters stop at two, so what is kept is a bit per counter: whether it reached two.
2. A second pass lets through only windows that are estimated repeated. Those behind each other that share an anchor travel
   as one stretch, with the hashes of its windows. Of equal stretches of a batch, only the first one needs a look; the
   others are repeated for certain.
3. Stretches are dealt by anchor and grouped exactly, by all their words and then, where an anchor has several different
   stretches (where a passage ends), window by window. The first occurrence stays, later ones are repeated.

The sketch has a fixed bound (2^29 counters, 64 MB). Beyond what it can tell apart it lets more windows through to the exact
grouping, in stretches of up to 13, but never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import WordHashes, mixed, stored, text_bytes, told_apart

WINDOW, RUN = 20, 8
#: Twice 2^bits counters: a half for windows, a quarter for each row of anchors. They are merged in segments.
LEAST_BITS, MOST_BITS, SEGMENT_BITS = 17, 28, 20
HELD = 1 << 22  # windows whose counters a task holds before it sends pieces
#: Words that are hashed together, and the most of one text: longer ones are taken in pieces that overlap by a window.
TOGETHER, PIECE = 1 << 17, 1 << 20


def word_lists(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for text in batch.column("text"):
        yield text.as_py().split()


_PLACE = np.uint64((1 << 24) - 1)


def together(batch: pa.RecordBatch, hashes: WordHashes, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows of the batch, place of the first word in its text, words' hashes behind each other, where each part ends) of
    texts of a window or more; a part is a text or a piece of a long one."""
    rows, froms, words, ends = [], [], [], []
    for row, some in enumerate(word_lists(batch)):
        for at in range(0, len(some) - window + 1, PIECE):
            rows.append(row)
            froms.append(at)
            words += some if len(some) <= PIECE else some[at : at + PIECE + window - 1]
            ends.append(len(words))
            if len(words) > TOGETHER:
                yield np.array(rows), np.array(froms), hashes.of(words), np.array(ends)
                rows, froms, words, ends = [], [], [], []
    if rows:
        yield np.array(rows), np.array(froms), hashes.of(words), np.array(ends)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def spans(words: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, a hash of every run of so many words: of halves, and those of their halves."""
    with np.errstate(over="ignore"):
        powers, out = [words], []
        while 2 << (len(powers) - 1) <= max(widths):
            step = 1 << (len(powers) - 1)
            powers.append(_joined(powers[-1][:-step], powers[-1][step:]) if len(powers[-1]) > step else powers[-1][:0])
        for width in widths:
            whole, at = None, 0
            for bit in reversed(range(width.bit_length())):
                if width >> bit & 1:
                    part = powers[bit][at:]
                    n = max(0, len(words) - width + 1)
                    whole, at = part[:n] if whole is None else _joined(whole[:n], part[:n]), at + (1 << bit)
            out.append(whole)
        return out


def anchors(runs: np.ndarray, window: int, run: int) -> np.ndarray:
    """For each window, the place of the smallest of its runs by their leading 40 bits, the leftmost of equals."""
    span = window - run + 1
    if len(runs) < span:
        return np.zeros(0, np.int64)
    low, size = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64), 1
    # Doubling: low[i] is the smallest of runs[i : i + size], with its place in the low bits.
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: size - span], low[span - size :])
    return (low & _PLACE).astype(np.int64)


def inside(ends: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, part) of each of n windows that lies inside one part."""
    part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    start = np.flatnonzero(np.arange(n) + window <= ends[part])
    return start, part[start]


def _window_cells(content: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(content) >> np.uint64(64 - bits)).astype(np.uint32)


def _anchor_cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counters of anchors, in two rows behind those of windows."""
    x = mixed(hashes)
    return [(np.uint32(2 + i) << np.uint32(bits - 1)) + ((x << np.uint64(31 * i)) >> np.uint64(65 - bits)).astype(np.uint32) for i in range(2)]


def packed(cells: np.ndarray) -> np.ndarray:
    """Sorted numbers as bytes: the gaps between them, 255 as far as a gap exceeds 254."""
    gaps = np.diff(cells, prepend=cells[:0].dtype.type(0))
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out


def unpacked(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.int64)[data != 255]


def sketch(texts: DataFrame, bits: int, window: int, run: int) -> np.ndarray:
    """Of all windows of texts (as bytes), a bit per counter: whether it reached two. Tasks send the counters that they touched."""
    segment = min(bits, SEGMENT_BITS)

    def pieces_of(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        cells = cells[np.concatenate((np.ones(min(2, len(cells)), bool), cells[2:] != cells[:-2]))]
        own = cells >> np.uint32(segment)
        begins = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint32(1)))
        data = [packed(part & np.uint32((1 << segment) - 1)).tobytes() for part in np.split(cells, begins[1:])]
        return pa.RecordBatch.from_arrays([pa.array(own[begins].astype(np.int32)), pa.array(data, pa.binary())], ["piece", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        for batch in batches:
            for _, _, words, ends in together(batch, hashes, window):
                runs, content = spans(words, run, window)
                start, _ = inside(ends, len(content), window)
                at = anchors(runs, window, run)[start]
                held += [_window_cells(content[start], bits), *_anchor_cells(runs[at[np.flatnonzero(np.diff(at, prepend=-1))]], bits)]
                size += len(start)
                if size > HELD:
                    yield pieces_of(held)
                    held, size = [], 0
        if size:
            yield pieces_of(held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << segment, bool), np.zeros(1 << segment, bool)
        for batch in batches:
            for data in batch.column("cells"):
                cells = unpacked(np.frombuffer(data.as_buffer(), np.uint8))
                twice[cells[once[cells]]] = True
                twice[cells[1:][cells[1:] == cells[:-1]]] = True
                once[cells] = True
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["piece", "bits"])

    merged = texts.select("text").mapInArrow(count, "piece int, cells binary").groupBy("piece").applyInArrow(merge, "piece int, bits binary")
    out = np.zeros((1 << bits + 1 - segment, (1 << segment) // 8), np.uint8)
    for r in merged.collect():  # a bounded sketch: 2^(MOST_BITS + 1) bits at most
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _reached(cells: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (seen[cells >> np.uint32(3)] >> (7 - (cells & np.uint32(7))).astype(np.uint8) & 1).astype(bool)


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) by columns, the last two of which are doc_id and start: whether a row is the first of equal other columns."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns[:-2]], axis=0)
    return order, new


def _lists(values: np.ndarray, sizes: np.ndarray, given: np.ndarray) -> pa.Array:
    """Lists of so many values each; null and without values where not given."""
    offsets = np.concatenate(([0], np.cumsum(sizes * given))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(given, bitorder="little"))
    return pa.ListArray.from_buffers(pa.list_(pa.int64()), len(sizes), [valid, pa.py_buffer(offsets)], children=[pa.array(values[np.repeat(given, sizes)].view(np.int64))])


#: Windows of stretches that a task holds at a time.
FOUND = 1 << 20


def stretches(docs: DataFrame, seen, bits: int, window: int, run: int) -> DataFrame:
    """(key, content, doc_id, start, n, windows) of the windows that seen marks, in stretches.

    A stretch is n windows of a document behind each other that share an anchor, the key; content is a hash of them all,
    and windows one of each. A stretch that isn't the first of its content among FOUND windows has no windows; its key is of no
    use but to spread such rows.
    """

    def rows_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, c, d, s, n, w = (np.concatenate(x) for x in zip(*found))
        order, new = _first_of(a, c, d, s)
        given = np.zeros(len(a), bool)
        given[order[new]] = True
        key = np.where(given, a, mixed(d.astype(np.uint64) + c))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), _lists(w, n, given)], ["key", "content", "doc_id", "start", "n", "windows"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found, size, ids = [], 0, batch.column("doc_id").to_numpy()
            for rows, froms, words, ends in together(batch, hashes, window):
                runs, content = spans(words, run, window)
                start, part = inside(ends, len(content), window)
                at = anchors(runs, window, run)[start]
                places = np.flatnonzero(np.diff(at, prepend=-1))
                first, second = _anchor_cells(runs[at[places]], bits)
                marked = _reached(first, seen.value) & _reached(second, seen.value)
                some = np.flatnonzero(np.repeat(marked, np.diff(np.append(places, len(at)))))
                some = some[_reached(_window_cells(content[start[some]], bits), seen.value)]
                if not len(some):
                    continue
                start, part, at = start[some], part[some], at[some]
                content = content[start]
                begins = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
                sizes = np.diff(np.append(begins, len(at)))
                with np.errstate(over="ignore"):
                    order = (np.arange(len(at)) - np.repeat(begins, sizes)).astype(np.uint64)
                    whole = mixed(np.add.reduceat(mixed(content + order), begins) + sizes.astype(np.uint64))
                owner = part[begins]
                place = start[begins] - np.concatenate(([0], ends))[owner] + froms[owner]
                found.append((runs[at[begins]], whole, ids[rows[owner]], place, sizes, content))
                size += len(content)
                if size > FOUND:
                    yield rows_of(found)
                    found, size = [], 0
            if found:
                yield rows_of(found)

    return docs.mapInArrow(find, "key long, content long, doc_id long, start int, n int, windows array<long>")


def _later(key: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc_id, start, n) of the windows of whole groups of one anchor that aren't the first of their words."""
    order, new = _first_of(key, content, doc, start)
    again, kept = order[~new], order[new]
    # An anchor with several contents: windows may be equal though their stretches aren't.
    own = key[kept]
    same = own[1:] == own[:-1]
    kept = kept[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(kept) else kept
    ends = np.cumsum(n)
    sizes = n[kept]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    each = np.repeat(kept, sizes)
    w, d, s = windows[(ends - n)[each] + inner], doc[each], start[each] + inner
    order, new = _first_of(key[each], w, d, s)
    single = order[~new]
    return np.concatenate((doc[again], d[single])), np.concatenate((start[again], s[single])), np.concatenate((n[again], np.ones(len(single), n.dtype)))


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, start, n): stretches of n windows of docs (doc_id, text as bytes) that also start earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document. Hashes, not texts, are shuffled.
    """
    spark = docs.sparkSession
    # Near seven bytes a word, and a window begins at each.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, size / 6.6 * 1.5))))))
    seen = spark.sparkContext.broadcast(sketch(docs, bits, window, run))
    dealt = stretches(docs.where("doc_id is not null"), seen, bits, window, run).repartition("key").sortWithinPartitions("key")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["doc_id", "start", "n"]
        held: list[pa.RecordBatch] = []  # rows of the last key, which may go on in the next batch

        def done(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            known = rows.filter(rows.column("windows").is_null())
            rows = rows.filter(rows.column("windows").is_valid())
            k, c, d, s, n = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("key", "content", "doc_id", "start", "n"))
            got = _later(k, c, d, s, n, rows.column("windows").flatten().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((known.column(x).to_numpy(zero_copy_only=False), y)), t) for x, y, t in zip(schema, got, (pa.int64(), pa.int32(), pa.int32()))], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last or held and held[-1].column("key")[0].as_py() != keys[0]:
                yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(pa.Table.from_batches(held))

    out, _ = stored(dealt.mapInArrow(solve, "doc_id long, start int, n int"), "repeats")
    seen.destroy()
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text.

    Removes each word that a window of 20 consecutive words covers whose words also start earlier; windows are judged
    on the input. Words lie between ASCII white space; kept ones are joined by one space. Null and empty texts have no
    words; texts of fewer words than a window, and rows without doc_id, lose nothing. Texts may have any length. Of
    equal windows (ties) the one of smallest doc_id and start stays. Rows that repeat a doc_id and its text count as one: none is
    earlier than the other, and both lose the same places. Different texts of one doc_id are documents of their own, in the
    order of their hashes. No rows give no rows; other columns are dropped.
    """
    docs, _ = told_apart(docs.select("doc_id", "text"))
    rows = docs.select("doc_id", "_row", text_bytes().alias("text"))
    starts = repeated_windows(rows.select(F.col("_row").alias("doc_id"), "text"), window)
    starts = starts.groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list(F.struct("start", "n")).alias("starts"))  # bounded by the document
    joined = rows.join(starts, "_row", "left").drop("_row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for words, starts in zip(word_lists(batch), batch.column("starts")):
                n.append(len(words))
                if starts.is_valid:
                    at, size = (starts.values.field(x).to_numpy() for x in ("start", "n"))
                    steps, end = np.zeros(len(words) + 1, np.int64), at + size - 1 + window
                    fits = end <= len(words)
                    np.add.at(steps, at[fits], 1)
                    np.add.at(steps, end[fits], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """without_repeats with kept_text as SHA-256."""
    out = without_repeats(docs, window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The rows of removal_digest in DuckDB, with windows compared by all their words.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS i,
         unnest(list_transform(range(1, len(words) - 18), lambda k: array_to_string(words[k:k + 19], ' '))) AS content
  FROM w WHERE len(words) >= 20),
again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1 AS repeated FROM windows),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
covered AS (
  SELECT p.doc_id, p.i, p.word, coalesce(bool_or(a.repeated) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM places p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.i = p.i),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM covered GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
