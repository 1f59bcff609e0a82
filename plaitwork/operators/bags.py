"""Bag algebra: relations with duplicates, where nulls equal each other and rows are equal by all their values."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bag_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row as often as in the relation that has it less often."""
    return a.intersectAll(b)


def bag_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row of a, less the times that b has it."""
    return a.exceptAll(b)


def bag_max_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row as often as in the relation that has it more often."""
    return a.unionAll(b.exceptAll(a))


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__{c}"]) for c in on])


def _probe(b: DataFrame, on: list[str]) -> DataFrame:
    return b.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()


def semi(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of a, with their duplicates, that have a partner in b on the given columns (all of a's by default)."""
    on = on or a.columns
    other = _probe(b, on)
    return a.join(other, _same(a, other, on), "left_semi")


def anti(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of a, with their duplicates, that have no partner in b."""
    on = on or a.columns
    other = _probe(b, on)
    return a.join(other, _same(a, other, on), "left_anti")


def overlap(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Each row as often as in the relation that has it less often, for a part that is mostly small: only rows of the
    whole that the part has are shuffled."""
    part = part.select(*whole.columns)
    return semi(whole, part).intersectAll(part)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, and those rows of b whose value a doesn't have."""
    return a.unionAll(anti(b.select(*a.columns), a))


def replicate(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count column says; the column goes."""
    times = F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("__i")
    return df.where(F.col(count) > 0).select(*[c for c in df.columns if c != count], times).drop("__i")


def counted(df: DataFrame, name: str = "__n") -> DataFrame:
    """Distinct rows with their multiplicity."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def occurrence(df: DataFrame, name: str = "__occ") -> DataFrame:
    """Number equal rows from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(1))))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark is one process."""
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "plaitwork-checkpoints"))
    return sc.getCheckpointDir().get()


def own_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so that plans of loops stay small and lost executors cost no replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
