"""What several corpus operators share: reading, intermediate tables, words, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        folder = f"file://{tempfile.mkdtemp(prefix='siftwork-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """df written once to the shared folder and read again, with its path: later steps reread files, not lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siftwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text, ...) with _row, in order of doc_id, and the numbers (_row, doc_id) that this took.

    Where each doc_id has one text, _row is doc_id, and there are no numbers; else it is a number per doc_id and text. Rows
    that repeat both share it; rows without doc_id have none. Under one doc_id texts are compared by 64-bit hashes.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    pairs = docs.where("doc_id IS NOT NULL").select("doc_id", hashed.alias("_text_hash"))
    several = pairs.groupBy("doc_id").agg(F.min("_text_hash").alias("low"), F.max("_text_hash").alias("high")).where("low <> high")
    if several.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), None
    ordered = pairs.distinct().repartitionByRange("doc_id", "_text_hash").sortWithinPartitions("doc_id", "_text_hash")
    numbered, _ = stored(ordered.withColumn("_row", F.monotonically_increasing_id()), "rows")  # in order of partitions, too
    return docs.withColumn("_text_hash", hashed).join(numbered, ["doc_id", "_text_hash"], "left").drop("_text_hash"), numbered.select("_row", "doc_id")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


class WordHashes(dict):
    """64-bit hashes of words, remembered while the vocabulary seen by a task stays below a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(29))) * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of width words, in order; of the whole sequence if it is shorter; none without words."""
    width = min(width, len(h))
    if not width:
        return h
    with np.errstate(over="ignore"):
        n, sums = len(h) - width + 1, np.full(len(h) - width + 1, np.uint64(width * 2 + seed * 1_000_003 + 1), np.uint64)
        for i in range(width):
            sums = (sums ^ h[i : i + n]) * _B
            sums ^= sums >> np.uint64(27)
        return mixed(sums)


#: A key with this part of all rows is hot; there can be no more than its inverse of them.
HOT_SHARE = 1000


def left_join_hot(rows: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """rows.join(small, key, "left") for a small with one row per key, weight being its number of rows (its column is left out).

    Keys that hold a thousandth of all rows or more are at most a thousand, so these rows of small are broadcast, and no
    task gets all rows of one key; the other keys are shuffled. Both tables are read more than once and should be stored.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE >= total
    hot = F.broadcast(small.where(is_hot).drop(weight))  # HOT_SHARE rows at most
    cold = rows.join(hot.select(key), key, "left_anti").join(small.where(~is_hot).drop(weight), key, "left")
    return rows.join(hot, key).unionByName(cold)


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): component is the smallest id reachable.

    Alternating large and small stars: each round replaces every link by a link to the smallest neighbour, until no
    link changes (a few times the logarithm of the longest path: rounds is far beyond any). Only per-vertex minima are aggregated, so that a vertex with very many links is combined before the
    shuffle; the joins back to the links may be split by adaptive execution.
    """
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        out, path = stored(df, "links")
        paths.append(path)
        return out

    def star(links: DataFrame, both: bool) -> DataFrame:
        low = F.least("a", "b"), F.greatest("a", "b")
        pairs = links.select(low[0].alias("v"), low[1].alias("u"))
        if both:
            pairs = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")
        lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(lowest, "u")
        if both:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    links = kept(edges.select("a", "b").where("a <> b").distinct())
    state = None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        links = kept(star(star(links, True), False))
        discard(spark, paths.pop(0))
    else:
        raise RuntimeError("connected components did not settle")
    hubs = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(hubs)
