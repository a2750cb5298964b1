"""Scans, snapshots, seeds and appends of Parquet and CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwork.operators.state import insert_absent, upsert


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores if their files give fewer partitions, as one file of one row group does; else as they are.

    For scans that much work per row follows. On large tables, which have more partitions than cores, nothing is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def listed(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def hydrate(rows: DataFrame, details: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with columns of details by key, null where there is none: one join for all rows."""
    return rows.join(details.select(key, *columns), key, "left")


def one(rows: DataFrame, order: Column, defaults: dict[str, object]) -> DataFrame:
    """The oldest row of a settings table, or one of defaults if it is empty."""
    spark = rows.sparkSession
    fallback = spark.range(1).select(*[F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    both = rows.withColumn("_default", F.lit(False)).unionByName(fallback.withColumn("_default", F.lit(True)))
    return both.orderBy("_default", order).limit(1).drop("_default")


def labelled_images(spark: SparkSession, csv: str, images: str, schema: StructType | str, key: str = "image_id", label: str = "label") -> DataFrame:
    """Rows of a CSV with a header joined to image files by stem; rows without label or image are left out."""
    rows = spark.read.csv(csv, header=True, schema=schema).dropna(subset=[key, label])
    files = spark.read.format("binaryFile").load(images).select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias(key), "path", "length")
    return rows.join(files, key).withColumn(label, F.col(label).cast("int"))


def image_type(content: Column) -> Column:
    """The media type that the first bytes tell."""
    first = F.hex(F.substring(content, 1, 12))
    return F.when(first.startswith("FFD8FF"), "image/jpeg").when(first.startswith("89504E470D0A1A0A"), "image/png").when(first.startswith("52494646") & first.endswith("57454250"), "image/webp")


def snapshot(rows: DataFrame, key: str) -> DataFrame:
    """A row as JSON per row of a table, nulls kept, in order of key."""
    return rows.orderBy(key).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def append_new(rows: DataFrame, old: DataFrame, keys: list[str], path: str) -> None:
    """Append those rows whose unique key isn't there yet."""
    insert_absent(old, rows, keys).write.mode("append").parquet(path)


def seeded(old: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    return upsert(old, seeds, [key])
