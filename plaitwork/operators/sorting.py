"""Distributed sort of fixed-width records, its validator, and range partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_sort(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """A full sort by one range exchange (sampled bounds); binary keys compare as unsigned bytes."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def prefix_partition(key: str, partitions: int):
    """Partition number by the first seven bytes of a binary key, in equal widths, for uniform keys."""
    prefix = F.conv(F.hex(F.rpad(F.substring(key, 1, 7), 7, F.unhex(F.lit("00")))), 16, 10).cast("decimal(20,0)")
    return F.least(F.floor(prefix * partitions / F.lit(1 << 56)), F.lit(partitions - 1)).cast("int")


def validate(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """One row: n rows, checksum (sum of CRC-32), and how often order is broken inside partitions and between them.

    Each partition is read in its own order; between partitions only their first and last keys are compared."""
    marked = df.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.col(key).alias("key"), *([F.col(value).alias("value")] if value else []))
    raw = lambda c: F.col(c) if dict(marked.dtypes)[c] == "binary" else F.col(c).cast("string").cast("binary")
    crc = F.crc32(F.concat(raw("key"), raw("value")) if value else raw("key"))
    inner = marked.withColumn("before", F.lag("key").over(Window.partitionBy("part").orderBy("at")))
    parts = inner.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(crc).alias("crc"), F.sum((F.col("before") > F.col("key")).cast("int")).alias("broken"),
        F.min("key").alias("low"), F.max("key").alias("high"),
    )
    # a row per partition from here
    edges = parts.withColumn("above", F.lag("high").over(Window.orderBy("part")))
    return edges.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("crc"), F.lit(0)).alias("checksum"),
        F.coalesce(F.sum("broken"), F.lit(0)).alias("broken_inside"), F.coalesce(F.sum((F.col("above") > F.col("low")).cast("int")), F.lit(0)).cast("long").alias("broken_between"),
    )


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows; each task keeps k."""
    return df.orderBy(*order).limit(k)
