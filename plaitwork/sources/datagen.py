"""Seeded data generators: each row depends on its number and the seed alone, so a lost partition is made again as it was."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.functions.scalars import Lcg128

_BIG = float(1 << 52)


def uniform(seed: int, *of) -> Column:
    """A number in [0, 1) that depends on the given columns and the seed."""
    return F.pmod(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in of], F.lit(seed)), F.lit(1 << 52)) / F.lit(_BIG)


def normal(seed: int, *of) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(F.lit(1.0) - uniform(seed, *of))) * F.cos(2 * math.pi * uniform(seed + 7919, *of))


def log_normal_graph(spark: SparkSession, n: int, partitions: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 1) -> DataFrame:
    """Edges (src, dst, attr): out-degrees are log-normal, targets uniform."""
    degree = F.least(F.floor(F.exp(mu + sigma * normal(seed, "id"))), F.lit(n)).cast("int")
    ids = spark.range(0, n, 1, partitions).withColumn("d", degree).where("d > 0")
    arcs = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.col("d"))).alias("k"))
    return arcs.select("src", F.floor(uniform(seed + 1, "src", "k") * n).cast("long").alias("dst"), F.lit(1).alias("attr"))


def _vector(dim: int, each) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), each)


def kmeans_points(spark: SparkSession, n: int, k: int, dim: int, scale: float, partitions: int = 2, seed: int = 42) -> DataFrame:
    center = F.col("id") % k
    return spark.range(0, n, 1, partitions).select("id", _vector(dim, lambda j: scale * normal(seed, center, j) + normal(seed + 1, F.col("id"), j)).alias("features"))


def linear_points(spark: SparkSession, n: int, dim: int, eps: float, partitions: int = 2, intercept: float = 0.0, seed: int = 42) -> DataFrame:
    x = spark.range(0, n, 1, partitions).withColumn("features", _vector(dim, lambda j: 2 * uniform(seed, F.col("id"), j) - 1))
    weights = _vector(dim, lambda j: 2 * uniform(seed + 1, F.lit(-1), j) - 1)
    dot = F.aggregate(F.zip_with("features", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.select("id", (dot + intercept + eps * normal(seed + 2, "id")).alias("label"), "features")


def logistic_points(spark: SparkSession, n: int, dim: int, eps: float, partitions: int = 2, prob_one: float = 0.5, seed: int = 42) -> DataFrame:
    label = F.when(uniform(seed + 3, "id") < prob_one, 1.0).otherwise(0.0)
    return spark.range(0, n, 1, partitions).withColumn("label", label).select("id", "label", _vector(dim, lambda j: normal(seed, F.col("id"), j) + eps * F.col("label")).alias("features"))


def svm_points(spark: SparkSession, n: int, dim: int, partitions: int = 2, weight_seed: int = 94720, seed: int = 42) -> DataFrame:
    """y = 1 if w.x + 0.1 N >= 0, x uniform in (-1, 1), w normal."""
    x = spark.range(0, n, 1, partitions).withColumn("features", _vector(dim, lambda j: 2 * uniform(seed, F.col("id"), j) - 1))
    dot = F.aggregate(F.zip_with("features", _vector(dim, lambda j: normal(weight_seed, F.lit(-1), j)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.select("id", F.when(dot + 0.1 * normal(seed + 2, "id") >= 0, 1.0).otherwise(0.0).alias("label"), "features")


def low_rank_matrix(spark: SparkSession, m: int, n: int, rank: int, noise: float = 0.0, train: float = 1.0, partitions: int = 2, seed: int = 42) -> DataFrame:
    """Cells (row, col, value) of A B with entries scaled by rank^-1/4, with noise; train is the share of cells that is kept."""
    scale = rank**-0.25
    factor = lambda of, s: _vector(rank, lambda j: scale * normal(s, of, j))
    cells = spark.range(0, m, 1, partitions).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col"))
    dot = F.aggregate(F.zip_with(factor(F.col("row"), seed), factor(F.col("col"), seed + 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    kept = cells.where(uniform(seed + 2, "row", "col") < train)
    return kept.select("row", "col", (dot + noise * normal(seed + 3, "row", "col")).alias("value"))


def record(random: int, number: int) -> tuple[bytes, bytes]:
    """The 10-byte key and 90-byte value of the sort benchmark's record with this random number."""
    digits = f"{random:032X}"
    body = b"\x00\x11" + f"{number:032X}".encode() + b"\x88\x99\xaa\xbb" + "".join(d * 4 for d in digits[20:]).encode() + b"\xcc\xdd\xee\xff"
    return random.to_bytes(16, "big")[:10], body


def sort_records(spark: SparkSession, n: int, partitions: int = 2) -> DataFrame:
    """(key, value) of records 0 to n - 1; each batch skips ahead to its first number."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, random = None, Lcg128()
        for batch in it:
            keys, values = [], []
            for number in batch.column(0).to_pylist():
                if number != at:
                    random = Lcg128().skip(number)
                key, value = record(random.step(), number)
                at = number + 1
                keys.append(key)
                values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["key", "value"])

    return spark.range(0, n, 1, partitions).mapInArrow(make, "key binary, value binary")


def clicks(rows: DataFrame, seed: int = 42, number: str = "value") -> DataFrame:
    """Page views for numbered rows (of a rate stream, or spark.range): url, status, zip, user."""
    u, v, w, x = (uniform(seed + k, number) for k in range(4))
    return rows.select(
        *rows.columns,
        F.when(u < 0.7, "http://foo.com/").when(u < 0.9, "http://foo.com/news").otherwise("http://foo.com/contact").alias("url"),
        F.when(v < 0.95, 200).otherwise(404).alias("status"),
        F.when(w < 0.5, 94709).otherwise(94117).alias("zip"),
        (F.floor(x * 100) + 1).cast("int").alias("user"),
    )
