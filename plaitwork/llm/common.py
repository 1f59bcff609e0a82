"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the code points U+0020 and U+0009 to U+000D, the word separators of this subpackage.
SEPARATORS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = os.path.join(tempfile.gettempdir(), "plaitwork-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """written(), dealt by key: joins and groups by key need no shuffle of this table."""
    spark = df.sparkSession
    name, width = f"{label}_{uuid.uuid4().hex}", shuffle_width(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(width, key).write.bucketBy(width, key).option("path", path).saveAsTable(name)
    return spark.table(name)


#: At most this many hot keys are named in a broadcast.
HOT_KEYS = 10_000


def spread_join(many: DataFrame, one: DataFrame, key: str, least: int = 4096) -> DataFrame:
    """many joined with one, a table that has each key once and in `copies` its number of rows in many.

    Keys of over T rows, where T is the larger of `least` and all rows / HOT_KEYS, are split into shares of about T rows.  There
    are fewer than HOT_KEYS such keys, so what is broadcast, two numbers for each, is bounded whatever the tables' sizes."""
    total = one.agg(F.sum("copies")).first()[0] or 0
    share = max(least, -(-total // HOT_KEYS))
    hot = one.where(F.col("copies") > share).groupBy(F.xxhash64(key).alias("_hot")).agg(F.max(F.ceil(F.col("copies") / share)).cast("int").alias("_shares"))
    hot = F.broadcast(hot)
    left = many.join(hot, F.xxhash64(many[key]) == hot["_hot"], "left")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("_shares", F.lit(1)))).drop("_hot", "_shares")
    right = one.drop("copies").join(hot, F.xxhash64(one[key]) == hot["_hot"], "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_hot", "_shares")
    return left.join(right, [key, "_salt"]).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
