"""The relational suite over registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.sources.sinks import view


def register(spark: SparkSession, sf_dir: str) -> None:
    """orders and lineitem as orderTab(oid, bid, cts) and oitemTab(iid, oid, gid, gnum, price, gstore)."""
    view(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("bid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cts")), "orderTab")
    view(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("iid"), F.col("l_orderkey").alias("oid"), F.col("l_partkey").alias("gid"), F.col("l_quantity").alias("gnum"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("gstore")), "oitemTab")


#: Statements by name; the thresholds are parameters, scaled to the tables at hand.
STATEMENTS = {
    "rel_count": "SELECT COUNT(*) AS n FROM orderTab",
    "rel_count_bid": "SELECT COUNT(*) AS n FROM orderTab WHERE bid > {bid}",
    "rel_price_low": "SELECT * FROM oitemTab WHERE price > {low}",
    "rel_price_high": "SELECT * FROM oitemTab WHERE price > {high}",
    "rel_join": "SELECT r.oid, r.bid, r.cts, s.iid, s.gid, s.gnum, s.price, s.gstore FROM orderTab r JOIN oitemTab s ON r.oid = s.oid",
}
THRESHOLDS = {"bid": 100, "low": 25000, "high": 50000}


def statement(name: str, **thresholds) -> str:
    return STATEMENTS[name].format(**{**THRESHOLDS, **thresholds})


def run(spark: SparkSession, sf_dir: str, name: str, **thresholds) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(statement(name, **thresholds))
