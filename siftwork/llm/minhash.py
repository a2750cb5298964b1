"""Near-duplicate detection with HyperMinHash sketches.

1. A document's shingle hashes fall into 128 registers by their leading bits; a register keeps its smallest hash as a
   leading-zero count and ten mantissa bits (16 bits). Empty registers borrow from a full one in an order fixed per
   register, so that small sets can be banded too.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Bands of four registers (32 bands) are bucket keys. Two sets of similarity 0.8 share no bucket with probability
   (1 - 0.8^4)^32 = 5e-8. In a bucket, members are compared with leaders, not with each other.
4. The Jaccard estimate, corrected for chance collisions of registers, discards pairs more than five standard
   deviations below the threshold; the rest is confirmed on the full sets.
5. Buckets in which several components remain are compared in blocks, exhaustively, between components only, and inside
   tasks: members outside the bucket's largest component meet all blocks, those inside it only blocks of the others. So no link
   between components is lost, copies are never expanded into all pairs, and rows grow with the bucket, not with its square,
   unless it holds no large component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import WordHashes, connected_components, discard, shingles, stored, text_bytes, told_apart

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
LEADERS = 4
BLOCK, BLOCK_HASHES = 512, 1_000_000
SIGMAS = 5.0
#: Below this set size, few registers are filled by hashes of their own: such pairs go straight to the full sets.
ESTIMATE_FROM = 64

_ORDER = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)
_SHIFT = REGISTERS.bit_length() - 1


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of lower-cased words."""
    return np.unique(shingles(hashes.of(words), width))


def sketch(values: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits of a sorted set of hashes, not empty."""
    with np.errstate(over="ignore"):
        home = (values >> np.uint64(64 - _SHIFT)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
        part, power = np.frexp((values[first] << np.uint64(_SHIFT)).astype(np.float64))
    zeros = np.minimum(64 - power, 62)
    code = (zeros << MANTISSA) + ((part - 0.5) * 2 * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.int64) + 1
    out = np.zeros(REGISTERS, np.uint16)
    out[home[first]] = code
    if len(first) < REGISTERS:
        full = out != 0
        donors = _ORDER[np.arange(REGISTERS), full[_ORDER].argmax(1)]
        out = np.where(full, out, out[donors])
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two unrelated sets of n and m hashes agree.

    The smallest of n uniform hashes is near exponential with rate n, and a register's cell at height x is x * 2^-10
    wide, times 1 / (2 ln 2) on average over the octave: the integral over x is 0.7213 * 2^-10 * nm / (n + m)^2.
    """
    n, m = np.maximum(n, 1.0), np.maximum(m, 1.0)
    return n * m / (n + m) ** 2 / (2 * math.log(2)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard of rows of sketches a and b of sets of n and m hashes."""
    chance = collision_rate(n, m)
    return ((a == b).mean(-1) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(values.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, a 128-bit fingerprint of the set, its registers as 32 longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, fp, regs = [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text.lower().split(), width, hashes)
                n.append(len(values))
                fp.append(_fingerprint(values))
                regs.append(sketch(values).view("<i8").tolist() if len(values) else None)
            high, low = zip(*fp) if fp else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(regs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp_high", "fp_low", "sketch"],
            )

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, fp_high long, fp_low long, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row of docs: the whole sorted set as bytes of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.lower().split(), width, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "members"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, members binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)).view("<u2")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def promising(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate allow the threshold."""
    least = least_estimate(threshold)
    of = lambda side: sketched.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(f"n_{x}").to_numpy() for x in "ab")
            good = (estimate(_registers(batch.column("s_a")), _registers(batch.column("s_b")), n, m) >= least) | (np.minimum(n, m) < ESTIMATE_FROM)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return sized.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full sets."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("members").alias(f"m_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("m_a"), batch.column("m_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = _shared(x, y)
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long")


def across_components(members: DataFrame, sketched: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket in different components whose sets, as 32-bit hashes, reach percent.

    members: bucket, band, doc_id, component. The largest component of a bucket and the others are each dealt into blocks of about
    512 members and a million hashes, and each pair of blocks that may hold different components is one group, so that no group
    grows with its bucket. A pair is compared in the first band that it shares. Sets are compared within the task: pairs that fail
    are no rows. Shortened hashes can only add pairs.
    """
    least = least_estimate(percent / 100)
    sized = members.join(sketched.select("doc_id", "n_shingles"), "doc_id")
    parts = sized.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("h"))
    most = F.max(F.struct("n", "component", "h"))
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("h").alias("h"), most.alias("most"))
    blocks = lambda n, h: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK, h / BLOCK_HASHES))).cast("int")
    main, rest = blocks(F.col("most.n"), F.col("most.h")), blocks(F.col("n") - F.col("most.n"), F.col("h") - F.col("most.h"))
    open_ = sizes.where("parts > 1 and n > 2").select("bucket", F.col("most.component").alias("main"), main.alias("mains"), rest.alias("others"))
    rows, rows_at = stored(members.join(open_, "bucket"), "open")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.unique((np.frombuffer(v.as_buffer(), np.uint64) >> np.uint64(32)).astype("<u4")).tobytes() for v in batch.column("members")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(short, pa.binary())], ["doc_id", "short"])

    asked = rows.select("doc_id").distinct()
    short = sets.join(asked, "doc_id", "left_semi").mapInArrow(shorten, "doc_id long, short binary")
    known = sketched.select("doc_id", "n_shingles", "sketch").join(short, "doc_id")
    inside, place = F.col("component") == F.col("main"), F.xxhash64("doc_id")
    own = F.when(inside, F.pmod(place, F.col("mains"))).otherwise(F.col("mains") + F.pmod(place, F.col("others"))).cast("int")
    meets = F.sequence(F.when(inside, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(meets))
    dealt = dealt.select("bucket", "band", "doc_id", "component", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(known, "doc_id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        longs = np.array(pdf["sketch"].tolist(), "<i8")
        regs = longs.view("<u2")
        ids, comp, n, own = (pdf[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "own"))
        values = [np.frombuffer(v, "<u4") for v in pdf["short"]]
        band = pdf["band"].iat[0]
        alone = pdf["x"].iat[0] == pdf["y"].iat[0]
        right = np.arange(len(pdf)) if alone else np.flatnonzero(own == pdf["y"].iat[0])
        out = []
        for i in range(len(pdf)) if alone else np.flatnonzero(own == pdf["x"].iat[0]):
            other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) if alone else True)]
            other = other[(longs[other] == longs[i]).argmax(1) == band]
            small, large = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
            good = (100 * small >= percent * large) & ((estimate(regs[other], regs[i], n[other], n[i]) >= least) | (small < ESTIMATE_FROM))
            for j in other[good]:
                same = _shared(values[i], values[j])
                # Two hashes of one set may have become one.
                if 100 * (same + 2) >= percent * (len(values[i]) + len(values[j]) - same - 2):
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    found, _ = stored(dealt.groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long"), "across")
    discard(members.sparkSession, rows_at)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id, kept.

    Lower-cases A-Z, takes words between ASCII white space and sets of distinct shingles of width words (fewer words:
    the whole sequence). Null and empty texts have no shingles and link with nothing; rows without doc_id are kept and
    have no component. component_id is the smallest doc_id reachable over links of similarity percent / 100 or more.
    Texts may have any length; the smallest doc_id of equal sets (ties) stands for them. Rows that repeat a doc_id and its text
    count as one; different texts of one doc_id are linked each for itself. No rows give no rows; other columns are dropped.
    """
    spark, threshold = docs.sparkSession, percent / 100
    docs, numbers = told_apart(docs.select("doc_id", "text"))
    docs = docs.select(F.col("_row").alias("doc_id"), "text")
    rows, _ = stored(sketches(docs, width), "sketches")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    sketched, _ = stored(usable.groupBy("fp_high", "fp_low").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")

    banded = sketched.select("doc_id", F.posexplode("sketch").alias("band", "key")).select("doc_id", "band", F.xxhash64("key", "band").alias("bucket"))
    rank = F.struct(F.xxhash64("doc_id", F.col("band") % LEADERS).alias("by"), F.col("doc_id"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(rank).alias("lead")).where("n > 1").select("bucket", F.col("lead.doc_id").alias("lead"))
    members, members_at = stored(banded.join(shared, "bucket").select("bucket", "band", "doc_id", "lead"), "members")

    tested, tested_at = stored(members.where("doc_id <> lead").select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct(), "pairs")
    likely, likely_at = stored(promising(tested, sketched, threshold), "likely")
    # Of a bucket, any member may be asked for later.
    needed = members.select("doc_id").distinct()
    sets, sets_at = stored(full_sets(docs.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), "sets")
    links, links_at = stored(confirmed(likely, sets, percent), "links")

    classes = connected_components(links)

    labelled = members.join(classes, members.doc_id == classes.id, "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    rest = across_components(labelled, sketched, sets, percent)
    more, _ = stored(confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        links, _ = stored(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "links")
        classes = connected_components(links)
    discard(spark, members_at, tested_at, likely_at, sets_at, links_at)

    heads = sketched.select("fp_high", "fp_low", F.col("doc_id").alias("first_id"))
    heads = heads.join(classes, heads.first_id == classes.id, "left").select("fp_high", "fp_low", F.coalesce("component", "first_id").alias("class_id"))
    out = rows.select("doc_id", "n_shingles", "fp_high", "fp_low").join(heads, ["fp_high", "fp_low"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    if numbers is not None:
        for column in ("doc_id", "component_id"):
            own = numbers.select(F.col("_row").alias(column), F.col("doc_id").alias("_own"))
            out = out.join(own, column, "left").withColumn(column, F.col("_own")).drop("_own")
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The rows of near_duplicates with two-word shingles at 80 per cent in DuckDB, over all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(words) = 1 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s
  FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM shingled),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM shingled UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN lowest USING (doc_id)
"""
