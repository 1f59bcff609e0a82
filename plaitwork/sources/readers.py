"""Readers.  Schemas are given, never inferred; text is split and cast by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.functions.scalars import java_hash

ORDERS = "oid int, bid int, cts string"
ITEMS = "iid int, oid double, gid int, gnum double, price double, gstore double"


def orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDERS).csv(path, sep="|")


def order_items(spark: SparkSession, path: str) -> DataFrame:
    """Items; the order id is written as a number with a fraction and read as an integer."""
    return spark.read.schema(ITEMS).csv(path, sep="|").withColumn("oid", F.col("oid").cast("int"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of numbers with spaces between: (features array<double>)."""
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("features"))


def labeled_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines `(label,[f1,f2,...])`, or `label,f1 f2 ...`: (label double, features array<double>)."""
    line = spark.read.text(path)
    inner = F.regexp_extract("value", r"\[(.*)\]", 1)
    numbers = F.split(F.when(inner != "", inner).otherwise(F.regexp_extract("value", r"^[^,]*,(.*)$", 1)), r"[,\s]+")
    return line.select(F.regexp_extract("value", r"^\(?\s*([^,]+),", 1).cast("double").alias("label"), F.transform(numbers, lambda x: x.cast("double")).alias("features"))


def edge_list(spark: SparkSession, path: str, canonical: bool = False, partitions: int | None = None) -> DataFrame:
    """Lines `src dst [attr]`; # starts a comment.  canonical turns edges so that src <= dst; attributes are 1 either way."""
    part = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    edges = raw.select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"), F.lit(1).alias("attr"))
    if canonical:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "attr")
    return edges.repartition(partitions, "src", "dst") if partitions else edges


def weighted_edges(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    part = F.split("value", sep)
    return spark.read.text(path).select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"), part[2].cast("double").alias("attr"))


def timed_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Lines `user::item::rating::ts`, with digit = ts modulo 10 for splits."""
    part = F.split("value", "::")
    return spark.read.text(path).select(part[0].cast("int").alias("user"), part[1].cast("int").alias("item"), part[2].cast("double").alias("rating"), part[3].cast("long").alias("ts")).withColumn("digit", F.pmod("ts", F.lit(10)))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user int, item int, rating double").csv(path)


def personal_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings above zero of a file; an error if there is none."""
    found = timed_ratings(spark, path).where("rating > 0")
    if found.isEmpty():
        raise ValueError("no ratings provided")
    return found


def in_memory(spark: SparkSession, rows, schema: str, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return df.repartition(partitions) if partitions else df


def id_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, name string").csv(path)


def binary_records(spark: SparkSession, path: str, key: int = 10, length: int = 100) -> DataFrame:
    """Fixed-width records as (key binary, value binary); the splits are at multiples of the length.  No Python worker sees them."""
    records = spark.sparkContext._jsc.sc().binaryRecords(path, length, spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    return DataFrame(rows, spark).toDF("r").select(F.substring("r", 1, key).alias("key"), F.substring("r", key + 1, length - key).alias("value"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines `category::::text`; lines with another number of parts are left out."""
    part = F.split("value", "::::")
    return spark.read.text(path).where(F.size(part) == 2).select(part[0].alias("category"), F.split(part[1], " ").alias("words"))


def wiki_pages(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Pages of an XML dump with at least so many characters of text: (categories, title, text, line)."""
    raw = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text: string>").load(path)
    flat = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    pages = raw.select(flat(F.col("title")).alias("title"), flat(F.col("revision.text")).alias("text")).where(F.length("text") >= least)
    found = pages.withColumn("categories", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[[Cc]ategory:([^\]|]+)"), 1)))
    category = F.array_join(F.transform("categories", lambda c: F.concat(F.lit(":"), c)), "")
    return found.withColumn("line", F.concat(category, F.lit(" :::: "), F.col("title"), F.lit(" "), F.col("text")))


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of `key: value` lines with a blank line between: (user, item, score, time), ids hashed."""
    block = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "")
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}: ?(.*)$", 1)
    return block.select(
        java_hash(field("review/userId")).alias("user"), java_hash(field("product/productId")).alias("item"),
        field("review/score").cast("double").alias("score"), field("review/time").cast("long").alias("time"),
    )


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a Spark event log with the fields that metrics need."""
    task = "`Task Info` struct<`Launch Time`: long, `Finish Time`: long>, `Task Metrics` struct<`Executor Run Time`: long, `Input Metrics`: struct<`Bytes Read`: long>, `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>>"
    stage = "`Stage Info` struct<`Stage ID`: long, `Submission Time`: long, `Completion Time`: long>"
    return spark.read.schema(f"Event string, Timestamp long, `Stage ID` long, `Task Type` string, {task}, {stage}").json(path)
