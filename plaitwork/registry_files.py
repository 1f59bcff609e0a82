"""Queries that write a table in a format of the readers, read the files back and return their rows, and their SQL.

Each call writes into a folder of its own in the shared folder.  They are registered beside the others of ``registry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.operators import graph, ml, sorting
from plaitwork.operators.bags import own_folder
from plaitwork.registry import _CHAIN, _gd_sql, _nations, _order_lines, _samples, chain, query, table
from plaitwork.sources import readers, sinks
from plaitwork.streaming import clicks


def _lines(df: DataFrame, label: str, sep: str = ",") -> str:
    """df's rows as text lines in a new folder."""
    path = own_folder(df.sparkSession, label)
    sinks.text(df, path, sep)
    return path


def _joined(array: Column, sep: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("double").cast("string")), sep)


@query("SELECT CAST(o_orderkey AS INT) AS oid, CAST(o_custkey AS INT) AS bid, strftime(o_orderdate, '%Y-%m-%d') AS cts FROM orders")
def src_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return readers.orders(spark, _lines(rows, "orders", "|"))


@query("SELECT CAST(l_linenumber AS INT) AS iid, CAST(l_orderkey AS INT) AS oid, CAST(l_partkey AS INT) AS gid, l_quantity AS gnum, l_extendedprice AS price, l_tax AS gstore FROM lineitem")
def src_order_items(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").cast("double"), "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return readers.order_items(spark, _lines(rows, "items", "|"))


@query("SELECT len(embedding) AS n, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, round(list_sum([x::DOUBLE * x::DOUBLE for x in embedding]), 6) AS squares FROM embeddings")
def src_vectors(spark, d):
    found = readers.vectors(spark, _lines(table(spark, d, "embeddings").select(_joined(F.col("embedding"), " ")), "vectors"))
    squares = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    return found.select(F.size("features").cast("long").alias("n"), F.col("features")[0].alias("first"), F.col("features")[63].alias("last"), F.round(squares, 6).alias("squares"))


@query("SELECT CAST(label AS DOUBLE) AS label, len(embedding) AS n, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def src_labeled_points(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("("), F.col("label").cast("double").cast("string"), F.lit(",["), _joined(F.col("embedding"), ","), F.lit("])")))
    return readers.labeled_points(spark, _lines(rows, "points")).select("label", F.size("features").cast("long").alias("n"), F.col("features")[0].alias("first"), F.col("features")[63].alias("last"))


@query("SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, 1 AS attr FROM lineitem")
def src_edge_list(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.lit(7))
    return readers.edge_list(spark, _lines(rows, "edges", " "), canonical=True, partitions=8)


@query("SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS attr FROM lineitem")
def src_weighted_edges(spark, d):
    return readers.weighted_edges(spark, _lines(table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity"), "weighted", "::"))


@query("SELECT CAST(l_partkey AS INT) AS usr, CAST(l_suppkey AS INT) AS item, l_quantity AS rating, l_orderkey * 7 AS ts, l_orderkey * 7 % 10 AS digit FROM lineitem")
def src_timed_ratings(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", F.col("l_orderkey") * 7)
    return readers.timed_ratings(spark, _lines(rows, "ratings", "::")).withColumnRenamed("user", "usr")


@query("SELECT CAST(l_partkey AS INT) AS usr, CAST(l_suppkey AS INT) AS item, l_discount AS rating FROM lineitem")
def src_ratings(spark, d):
    return readers.ratings(spark, _lines(table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_discount"), "ratings")).withColumnRenamed("user", "usr")


@query("SELECT CAST(c_custkey AS INT) AS usr, CAST(c_nationkey AS INT) AS item, CAST(c_nationkey % 3 AS DOUBLE) AS rating FROM customer WHERE c_nationkey % 3 > 0")
def src_personal_ratings(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_nationkey") % 3, F.lit(5))
    return readers.personal_ratings(spark, _lines(rows, "personal", "::")).select(F.col("user").alias("usr"), "item", "rating")


@query("SELECT c_mktsegment AS category, len(string_split(c_name, '#')) AS n, c_name AS words FROM customer")
def src_documents(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", F.regexp_replace("c_name", "#", " "))
    found = readers.documents(spark, _lines(rows, "documents", "::::"))
    return found.select("category", F.size("words").cast("long").alias("n"), F.array_join("words", "#").alias("words"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def src_id_names(spark, d):
    return readers.id_names(spark, _lines(table(spark, d, "customer", "c_custkey", "c_name"), "names"))


_PAGE = "'[[Category:' || p_brand || ']] [[category:' || p_type || '|x]] ' || repeat(p_name || ' ', 12)"


@query(f"SELECT ':' || p_brand || ':' || p_type || ' :::: ' || p_name || ' ' || trim({_PAGE}) AS line, p_name AS title, trim({_PAGE}) AS text FROM part WHERE length(trim({_PAGE})) >= 200")
def src_wiki_pages(spark, d):
    text = F.concat(F.lit("[[Category:"), "p_brand", F.lit("]] [[category:"), "p_type", F.lit("|x]] "), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12)))
    rows = table(spark, d, "part").select(F.col("p_name").alias("title"), F.struct(F.trim(text).alias("text")).alias("revision"))
    path = own_folder(spark, "pages")
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return readers.wiki_pages(spark, path, 200).select("line", "title", "text")


def _hash_sql(text: str) -> str:
    """The 32-bit string hash of ASCII text."""
    return f"((list_reduce([unicode(c) for c in string_split({text}, '')], lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) + 2147483648) % 4294967296 - 2147483648)"


@query(f"SELECT CAST({_hash_sql('c_name')} AS INT) AS usr, CAST({_hash_sql('c_mktsegment')} AS INT) AS item, c_acctbal AS score, c_custkey AS time FROM customer")
def src_reviews(spark, d):
    block = F.format_string("product/productId: %s\nreview/userId: %s\nreview/score: %s\nreview/time: %s\n", "c_mktsegment", "c_name", F.col("c_acctbal").cast("string"), F.col("c_custkey").cast("string"))
    return readers.reviews(spark, _lines(table(spark, d, "customer").select(block), "reviews")).withColumnRenamed("user", "usr")


# records of 100 bytes ----------------------------------------------------------------------------------------------------

_ROW_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Line items as records: ten bytes of a digest as the key, ninety of text as the value."""
    row = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.substring(F.unhex(F.md5(row)), 1, 10).alias("key"), F.encode(F.rpad(row, 90, "."), "UTF-8").alias("value"))


def _read_records(spark: SparkSession, d: str) -> DataFrame:
    path = own_folder(spark, "records")
    sinks.binary_records(_records(spark, d), path)
    return readers.binary_records(spark, path)


@query(f"SELECT upper(substr(md5({_ROW_KEY}), 1, 20)) AS key, rpad({_ROW_KEY}, 90, '.') AS value FROM lineitem")
def so_records(spark, d):
    """Records written as fixed-width files, read back and sorted by unsigned bytes."""
    done = sorting.range_sort(_read_records(spark, d), ["key"])
    return done.select(F.hex("key").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query(f"SELECT count(*) AS n_rows, 0::BIGINT AS broken_inside, 0::BIGINT AS broken_between, true AS same_checksum, min(upper(substr(md5({_ROW_KEY}), 1, 20))) AS low, max(upper(substr(md5({_ROW_KEY}), 1, 20))) AS high FROM lineitem")
def so_validate_records(spark, d):
    """Sorted records are written, read back and validated; their checksum is that of the records before."""
    path = own_folder(spark, "sorted")
    done = sorting.range_sort(_read_records(spark, d), ["key"], 8)
    sinks.binary_records(done, path)
    before = sorting.validate(_records(spark, d), "key", "value").select(F.col("checksum").alias("want"))
    found = sorting.validate(sorting.range_sort(readers.binary_records(spark, path), ["key"], 8), "key", "value")
    ends = readers.binary_records(spark, path).agg(F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"))
    both = found.crossJoin(before).crossJoin(ends)  # one row each
    return both.select("n_rows", "broken_inside", "broken_between", (F.col("checksum") == F.col("want")).alias("same_checksum"), "low", "high")


@query(f"SELECT CAST(('0x' || substr(md5({_ROW_KEY}), 1, 14))::BIGINT // (1::BIGINT << 53) AS INT) AS part, count(*) AS n FROM lineitem GROUP BY 1")
def so_prefix_partition(spark, d):
    return _records(spark, d).groupBy(sorting.prefix_partition("key", 8).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS BIGINT) AS broken_inside, count(*) AS n_rows FROM (SELECT l_partkey AS b, lag(l_partkey) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS a FROM lineitem)")
def so_validate_unsorted(spark, d):
    """Rows in the order of another key: the validator finds every descent."""
    line = table(spark, d, "lineitem").coalesce(1).sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey").select("l_partkey")
    return sorting.validate(line, "l_partkey").select("broken_inside", "n_rows")


# paths, ranks, models, traces ---------------------------------------------------------------------------------------------


def _relax_sql(rounds: int) -> str:
    steps = ["d0 AS (SELECT 42::BIGINT AS id, 0.0::DOUBLE AS distance)", "x AS (SELECT src, dst, min(1 + (src + dst) % 3) AS w FROM e GROUP BY ALL)"]
    steps += [f"d{i + 1} AS (SELECT id, min(distance) AS distance FROM (SELECT id, distance FROM d{i} UNION ALL SELECT dst, distance + w FROM d{i} JOIN x ON src = id) GROUP BY id)" for i in range(rounds)]
    return f"WITH {_CHAIN}, " + ", ".join(steps) + f" SELECT id, distance FROM d{rounds}"


@query(_relax_sql(36))
def gr_sssp_weighted(spark, d):
    """Weights 1 to 3; a vertex is at most 12 hops away, so a shortest path has at most 36 edges."""
    return graph.shortest_paths_from(chain(spark, d), 42, 1 + (F.col("src") + F.col("dst")) % 3)


@query()
def gr_pagerank_converged(spark, d):
    """Dynamic PageRank down to its tolerance; tests hold it against a plain loop."""
    return graph.pagerank_until(chain(spark, d), 1e-3)


_SCORES = _gd_sql(3, "1 / (1 + exp(-(a * wa + b * wb + c * wc))) - f").rpartition(" SELECT round(")[0]


@query(_SCORES + " SELECT round(avg(pow(CASE WHEN a * wa + b * wb + c * wc > 0 THEN 1 ELSE 0 END - f, 2)), 8) AS mse FROM x, w3")
def ml_logreg_mse(spark, d):
    """Mean squared error of 0/1 predictions of a trained model."""
    rows = _samples(spark, d).drop("label").withColumnRenamed("flag", "label")
    weights = ml.gradient_descent(rows, 3, 3, "logistic")
    scored = rows.withColumn("prediction", (ml.dot(F.col("features"), F.lit(weights)) > 0).cast("double"))
    return ml.mean_squared_error(scored).select(F.round("mse", 8).alias("mse"))


@query(_gd_sql(3, "a * wa + b * wb + c * wc - y").rpartition(" SELECT round(")[0] + " SELECT round(avg(pow(a * wa + b * wb + c * wc - y, 2)), 8) AS mse FROM x, w3")
def ml_linreg_mse(spark, d):
    """Training error of a trained model."""
    rows = _samples(spark, d)
    weights = ml.gradient_descent(rows, 3, 3)
    return ml.mean_squared_error(rows.withColumn("prediction", ml.dot(F.col("features"), F.lit(weights)))).select(F.round("mse", 8).alias("mse"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 5")
def expl_union_second(spark, d):
    """All rows below 5 are tracked; the first parent gives its own, the second the rest."""
    customers, suppliers = _nations(spark, d)
    return suppliers.union(customers).explain("k < 5", 1).df


@query("SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 5")
def expl_union_first(spark, d):
    customers, suppliers = _nations(spark, d)
    return suppliers.union(customers).explain("k < 5", 0).df


_BUSY = "SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING sum(l_linenumber) >= 250"


@query(f"SELECT 'lineitem' AS side, l_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN ({_BUSY}) UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey IN ({_BUSY}) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def trace_multiple_explain(spark, d):
    """Explanations of one result in two sources at once, replayed until they reproduce it."""
    orders, lines = _order_lines(spark, d)
    busy = orders.join(lines, ["k"]).reduce_by_key(["o_custkey"], "total", "sum", "l_linenumber").filter("total >= 250")
    found = busy.go_back_to_multiple_and_explain(["orders", "lineitem"])
    return found["lineitem"].df.select(F.lit("lineitem").alias("side"), "k").union(found["orders"].df.select(F.lit("orders").alias("side"), "k"))


@query("WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n FROM e WHERE event_type <> 'error'")
def st_each_batch(spark, d):
    """Counts of a stream, batch by batch, kept as files and added up."""
    views = clicks.stream_of(spark, f"{d}/events.parquet").where("event_type <> 'error'").select("event_type")
    folder = own_folder(spark, "counts")
    count = lambda batch, number: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    sinks.each_batch(views, count).awaitTermination()
    return spark.read.schema("event_type string, n long").parquet(folder).groupBy("event_type").agg(F.sum("n").alias("n"))
