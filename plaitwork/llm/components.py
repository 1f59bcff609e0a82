"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is joins and minima of DataFrames; its edges are written to the shared folder, so lineage stays
short and a lost executor costs one round at most.  Only a count and a checksum reach the driver.
A vertex with very many neighbours is one side of an ordinary sort-merge join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaitwork.llm.common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lowest = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = arcs.join(lowest, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex that has an edge; root is the smallest vertex of its component.

    edges has two long columns a and b without nulls; loops and repeats do no harm."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        middle = written(_stars(edges, True), "edges")
        before, edges = edges, written(_stars(middle, False), "edges")
        dropped(before, middle)
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
