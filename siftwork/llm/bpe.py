"""Byte-level BPE encoding and decoding by merge ranks.

Each match of the split pattern is encoded on its own. A piece that is not itself a token starts as single bytes; a
segment tree over its byte positions holds, at each live position, the rank of the pair that starts there, and at each
node the leftmost smallest rank below. The root gives the next merge; a merge updates the leaves of the merged
position, of the neighbour that ends, and of the neighbour before, each in a logarithmic number of nodes.

Short pieces (nearly all) are encoded many at a time: the trees of equal size are rows of one array, and a step merges
one pair in each of them. Long pieces have a tree of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = np.int64(1 << 62)
#: Up to this many bytes, pieces are encoded together.
TOGETHER = 128
#: Pieces remembered by a Python worker.
REMEMBERED = 500_000


class Ranks:
    """The tokens of a rank file, and the rank of each pair of token ids whose bytes make another token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.bytes_of) + 1
        keys, values = [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    values.append(rank)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.pairs = dict(zip(keys, values))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, _NONE where there is none."""
        key = left * self.base + right
        at = np.searchsorted(self.pair_keys, key).clip(max=len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece with a segment tree of its own."""
    n = len(piece)
    width = 1 << (n - 1).bit_length() if n > 1 else 1
    shift = width.bit_length()
    none, low = int(_NONE), (1 << shift) - 1
    ids = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = ranks.pairs
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        j = after[i]
        rank = pairs.get(ids[i] * ranks.base + ids[j]) if j < n else None
        return none if rank is None else rank << shift | i

    for i in range(n):
        tree[width + i] = leaf(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            lowest = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == lowest:
                break
            tree[node] = lowest

    while tree[1] < none:
        i = tree[1] & low
        j = after[i]
        ids[i], k = tree[1] >> shift, after[j]
        after[i] = k
        if k < n:
            before[k] = i
        update(j, none)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def encode_together(pieces: list[bytes], ranks: Ranks, width: int) -> list[list[int]]:
    """Pieces of 2 to width bytes (a power of two), one tree in each row."""
    m, shift = len(pieces), width.bit_length()
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    ids = ranks.single[raw]
    places = np.arange(width)
    after = np.tile(np.arange(1, width + 1), (m, 1))
    before = np.tile(np.arange(-1, width), (m, 1))
    tree = np.full((m, 2 * width), _NONE)
    first = ranks.pair(ids[:, :-1], ids[:, 1:])
    first[places[1:][None, :] >= lengths[:, None]] = _NONE
    tree[:, width : 2 * width - 1] = np.where(first < _NONE, first << shift | places[:-1], _NONE)
    step = width
    while step > 1:
        half = step // 2
        tree[:, half:step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
        step = half

    def update(rows: np.ndarray, at: np.ndarray, values: np.ndarray | np.int64) -> None:
        node = width + at
        tree[rows, node] = values
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def leaves(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        right = after[rows, at]
        inside = right < lengths[rows]
        rank = ranks.pair(ids[rows, at], ids[rows, np.where(inside, right, 0)])
        return np.where(inside & (rank < _NONE), rank << shift | at, _NONE)

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    dead = np.zeros((m, width), bool)
    while len(rows):
        root = tree[rows, 1]
        i = root & ((1 << shift) - 1)
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = root >> shift
        after[rows, i] = k
        before[rows, k] = i
        dead[rows, j] = True
        update(rows, j, _NONE)
        update(rows, i, leaves(rows, i))
        earlier = before[rows, i]
        has = earlier >= 0
        if has.any():
            update(rows[has], earlier[has], leaves(rows[has], earlier[has]))
        rows = rows[tree[rows, 1] < _NONE]
    live = ~dead & (places[None, :] < lengths[:, None])
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts, remembering pieces within a bound."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pieces, self.known = Ranks(path), regex.compile(pattern).findall, {}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.known))
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            if (rank := self.ranks.rank.get(raw)) is not None:
                self.known[piece] = (rank,)
            elif len(raw) > TOGETHER:
                self.known[piece] = tuple(encode_long(raw, self.ranks))
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in by_width.items():
            for at in range(0, len(group), step := max(1, (1 << 18) // width)):
                part = group[at : at + step]
                for (piece, _), ids in zip(part, encode_together([raw for _, raw in part], self.ranks, width)):
                    self.known[piece] = tuple(ids)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 256):
            split = [self.pieces(t) for t in texts[at : at + 256]]
            self.learn(split)
            for pieces in split:
                yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for a Python worker, whichever tasks it runs."""
    return Encoder(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text, ...) with ids array<int>: the tokens of the whole text, null texts as empty.

    A column ids of docs is replaced.
    """
    docs = docs.drop("ids")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = pa.array(own.encode([t or "" for t in some.column("text").to_pylist()]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, ids], [*names, "ids"])

    return docs.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + ["ids array<int>"]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, and SHA-256 of the ids in decimal and of the bytes decoded from them.

    Null and empty texts have no tokens. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        names = {i: str(i) for i in own.ranks.bytes_of}
        for batch in batches:
            n, ids_hash, decoded = [], [], []
            for ids in own.encode(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.ranks.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
