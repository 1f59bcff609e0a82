"""All queries of the engine, over whole tables, and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.operators import graph, ml, sorting
from plaitwork.operators.annotations import Aggregation, RemovingDups
from plaitwork.operators.bags import bag_max_union, cut
from plaitwork.operators.traced import Traced, union
from plaitwork.plans import relational
from plaitwork.streaming import clicks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def traced(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Traced:
    return Traced.source(table(spark, sf_dir, name, *columns), name)


# relational -----------------------------------------------------------------------------------------------------------

_ORDER_TAB = "SELECT o_orderkey AS oid, o_custkey AS bid, strftime(o_orderdate, '%Y-%m-%d') AS cts FROM orders"
_ITEM_TAB = "SELECT l_linenumber AS iid, l_orderkey AS oid, l_partkey AS gid, l_quantity AS gnum, l_extendedprice AS price, l_tax AS gstore FROM lineitem"
for _name in relational.STATEMENTS:
    query(f"WITH orderTab AS ({_ORDER_TAB}), oitemTab AS ({_ITEM_TAB}) " + relational.statement(_name), _name)(lambda spark, d, n=_name: relational.run(spark, d, n))


# bag operators, forward -----------------------------------------------------------------------------------------------

_CUSTOMER = ("c_custkey", "c_nationkey", "c_mktsegment")
_SUPPLIER = ("s_suppkey", "s_nationkey")
_LINE = ("l_orderkey", "l_partkey", "l_quantity", "l_tax")


@query("SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS band FROM orders")
def bag_map(spark, d):
    return traced(spark, d, "orders").map(o_orderkey=F.col("o_orderkey"), band=F.floor(F.col("o_totalprice") / 1000)).df


@query("SELECT c_nationkey + 100 AS k, c_custkey, c_nationkey, c_mktsegment FROM customer")
def bag_key_by(spark, d):
    return traced(spark, d, "customer", *_CUSTOMER).key_by("k", F.col("c_nationkey") + 100).df


@query("SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def bag_flat_map(spark, d):
    return traced(spark, d, "documents", "doc_id", "text").flat_map("word", F.split("text", " "), ["doc_id"]).df


@query("SELECT * FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'")
def bag_filter(spark, d):
    return traced(spark, d, "lineitem").filter("l_discount > 0.05 and l_returnflag = 'R'").df


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def bag_distinct(spark, d):
    return traced(spark, d, "lineitem", "l_partkey", "l_suppkey").distinct().df


_NATIONS = "(SELECT c_nationkey AS k FROM customer) {} (SELECT s_nationkey AS k FROM supplier)"


def _nations(spark, d):
    a = Traced.source(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "customer")
    b = Traced.source(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "supplier")
    return a, b


@query(_NATIONS.format("UNION ALL") + " UNION ALL SELECT n_nationkey FROM nation")
def bag_union(spark, d):
    a, b = _nations(spark, d)
    return union(a, b, Traced.source(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "nation")).df


@query(_NATIONS.format("INTERSECT"))
def bag_intersection(spark, d):
    a, b = _nations(spark, d)
    return a.intersection(b).df


@query("SELECT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def bag_subtract(spark, d):
    a = Traced.source(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))
    return a.subtract(Traced.source(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")))).df


@query("SELECT c_custkey, c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def bag_subtract_by_key(spark, d):
    a = Traced.source(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")))
    return a.subtract_by_key(Traced.source(table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name")), ["k"]).df


@query("SELECT * FROM (SELECT l_partkey FROM lineitem WHERE l_tax < 0.04) INTERSECT ALL (SELECT l_partkey FROM lineitem WHERE l_tax > 0.04)")
def bag_intersect_with_dups(spark, d):
    line = table(spark, d, "lineitem")
    return line.where("l_tax < 0.04").select("l_partkey").intersectAll(line.where("l_tax > 0.04").select("l_partkey"))


@query("SELECT * FROM (SELECT l_partkey FROM lineitem WHERE l_tax < 0.04) EXCEPT ALL (SELECT l_partkey FROM lineitem WHERE l_tax > 0.04)")
def bag_subtract_with_dups(spark, d):
    line = table(spark, d, "lineitem")
    return line.where("l_tax < 0.04").select("l_partkey").exceptAll(line.where("l_tax > 0.04").select("l_partkey"))


@query("""WITH a AS (SELECT l_partkey FROM lineitem WHERE l_tax < 0.04), b AS (SELECT l_partkey FROM lineitem WHERE l_tax > 0.04)
SELECT * FROM a UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def bag_multi_union(spark, d):
    line = table(spark, d, "lineitem")
    return bag_max_union(line.where("l_tax < 0.04").select("l_partkey"), line.where("l_tax > 0.04").select("l_partkey"))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region, nation")
def bag_cartesian(spark, d):
    return traced(spark, d, "region").cartesian(traced(spark, d, "nation")).df


def _order_lines(spark, d):
    orders = Traced.source(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "orders")
    lines = Traced.source(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber", "l_extendedprice"), "lineitem")
    return orders, lines


@query("SELECT o_orderkey AS k, o_custkey, l_partkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def bag_join(spark, d):
    orders, lines = _order_lines(spark, d)
    return orders.join(lines, ["k"]).df


def _by_nation(spark, d):
    a = Traced.source(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), "customer")
    b = Traced.source(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), "supplier")
    c = Traced.source(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "nation")
    e = Traced.source(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name"), "region")
    return a, b, c, e


def _shown(df: DataFrame, fields: list[str]) -> DataFrame:
    """Groups as sorted text, so that they compare."""

    def text(i: int, field: str):
        return F.array_join(F.sort_array(F.transform(f"g{i}", lambda x: x[field].cast("string"))), ",").alias(f"g{i}")

    return df.select("k", *[text(i, field) for i, field in enumerate(fields)])


def _cogroup_sql(n: int) -> str:
    sides = [("customer", "c_nationkey", "c_custkey"), ("supplier", "s_nationkey", "s_suppkey"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")][:n]
    keys = " UNION ".join(f"SELECT {k} AS k FROM {t}" for t, k, _ in sides)
    groups = ", ".join(f"coalesce((SELECT string_agg(CAST({v} AS VARCHAR), ',' ORDER BY CAST({v} AS VARCHAR)) FROM {t} WHERE {k} = keys.k), '') AS g{i}" for i, (t, k, v) in enumerate(sides))
    return f"SELECT k, {groups} FROM ({keys}) AS keys"


@query(_cogroup_sql(2))
def bag_cogroup2(spark, d):
    a, b, _, _ = _by_nation(spark, d)
    return _shown(a.cogroup(b, on=["k"]).df, ["c_custkey", "s_suppkey"])


@query(_cogroup_sql(3))
def bag_cogroup3(spark, d):
    a, b, c, _ = _by_nation(spark, d)
    return _shown(a.cogroup(b, c, on=["k"]).df, ["c_custkey", "s_suppkey", "n_name"])


@query(_cogroup_sql(4))
def bag_cogroup4(spark, d):
    a, b, c, e = _by_nation(spark, d)
    return _shown(a.group_with(b, c, e, on=["k"]).df, ["c_custkey", "s_suppkey", "n_name", "r_name"])


@query("SELECT l_suppkey AS k, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY ALL")
def bag_group_by_key(spark, d):
    rows = Traced.source(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_partkey"))
    return rows.group_by_key(["k"], "parts", "l_partkey").df.select("k", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


for _fn, _sql in (("sum", "round(sum(l_quantity), 2)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)")):

    @query(f"SELECT l_partkey, {_sql} AS v FROM lineitem GROUP BY l_partkey", f"bag_reduce_{_fn}")
    def _reduce(spark, d, fn=_fn):
        out = traced(spark, d, "lineitem", "l_partkey", "l_quantity").reduce_by_key(["l_partkey"], "v", fn, "l_quantity").df
        return out.withColumn("v", F.round("v", 2)) if fn == "sum" else out


@query("SELECT l_orderkey, round(product(1 + l_tax), 8) AS v FROM lineitem GROUP BY l_orderkey")
def bag_reduce_product(spark, d):
    rows = Traced.source(table(spark, d, "lineitem").select("l_orderkey", (1 + F.col("l_tax")).alias("f")))
    return rows.reduce_by_key(["l_orderkey"], "v", "product", "f").df.withColumn("v", F.round("v", 8))


@query("SELECT l_orderkey, list_reduce(list_prepend(0, list(l_partkey ORDER BY l_partkey)), lambda h, x: (h * 31 + x) % 1000003) AS v FROM lineitem GROUP BY l_orderkey")
def bag_fold(spark, d):
    rows = traced(spark, d, "lineitem", "l_orderkey", "l_partkey")
    return rows.fold_by_key(["l_orderkey"], "v", F.lit(0).cast("long"), lambda h, x: (h * 31 + x) % 1000003, "l_partkey").df


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS total, count(*) AS n, round(sum(l_quantity) / count(*), 6) AS mean FROM lineitem GROUP BY l_suppkey")
def bag_aggregate(spark, d):
    out = traced(spark, d, "lineitem", "l_suppkey", "l_quantity").aggregate_by_key(["l_suppkey"], total=F.round(F.sum("l_quantity"), 2), n=F.count(F.lit(1)), mean=F.round(F.sum("l_quantity") / F.count(F.lit(1)), 6))
    return out.df


@query("SELECT o_custkey, o_orderstatus, max(o_totalprice) AS most, min(o_orderdate) AS first_day FROM orders GROUP BY ALL")
def bag_combine(spark, d):
    out = traced(spark, d, "orders").combine(["o_custkey", "o_orderstatus"], None, False, [], None, most=F.max("o_totalprice"), first_day=F.min("o_orderdate"))
    return out.df


@query("SELECT l_suppkey, true AS near FROM lineitem GROUP BY l_suppkey")
def bag_approx_distinct(spark, d):
    rows = traced(spark, d, "lineitem", "l_suppkey", "l_partkey")
    rough = rows.count_approx_distinct_by_key(["l_suppkey"], "rough", "l_partkey").df
    exact = rows.aggregate_by_key(["l_suppkey"], exact=F.countDistinct("l_partkey")).df
    return rough.join(exact, "l_suppkey").select("l_suppkey", (F.abs(F.col("rough") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.2 * F.col("exact"))).alias("near"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def bag_distinct_count(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def bag_count_by_value(spark, d):
    return traced(spark, d, "events", "event_type").aggregate_by_key(["event_type"], n=F.count(F.lit(1))).df


@query("SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer")
def bag_map_values(spark, d):
    rows = Traced.source(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))
    return rows.map_values_with_inverse(["k"], [F.col("k"), F.col("v") / 2], v=F.col("v") * 2).df


@query("SELECT conv_id AS k, unnest(string_split(text, ' ')) AS word FROM conversations")
def bag_flat_map_values(spark, d):
    rows = Traced.source(table(spark, d, "conversations").select(F.col("conv_id").alias("k"), "text"))
    return rows.flat_map_values(["k"], "word", F.split("text", " ")).df


@query("SELECT c_nationkey FROM customer")
def bag_keys(spark, d):
    return traced(spark, d, "customer", *_CUSTOMER).keys(["c_nationkey"]).df


@query("SELECT c_custkey, c_mktsegment FROM customer")
def bag_values(spark, d):
    return traced(spark, d, "customer", *_CUSTOMER).values(["c_nationkey"]).df


for _op, _move in (
    ("coalesce", lambda t: t.coalesce(2)), ("repartition", lambda t: t.repartition(4)),
    ("partition_by", lambda t: t.partition_by(4, "c_nationkey")), ("sort_by_key", lambda t: t.sort_by_key("c_nationkey", "c_custkey")),
):
    query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer", f"bag_{_op}")(lambda spark, d, f=_move: f(traced(spark, d, "customer", *_CUSTOMER)).df)


# provenance -----------------------------------------------------------------------------------------------------------

_ORD = ("o_orderkey", "o_custkey", "o_orderstatus")
_BAND = "CAST(floor(o_totalprice / 1000) AS BIGINT)"


def _bands(spark, d):
    rows = traced(spark, d, "orders", *_ORD, "o_totalprice")
    return rows.map(band=F.floor(F.col("o_totalprice") / 1000), o_orderstatus=F.col("o_orderstatus"))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE {_BAND} >= 300")
def prov_map(spark, d):
    return _bands(spark, d).provenance("band >= 300").df


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY {_BAND}, o_orderstatus ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice) = 1""")
def expl_map(spark, d):
    out = _bands(spark, d)
    return Traced(out.df.distinct(), out.node).explain().df


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey >= 12")
def prov_map_with_inverse(spark, d):
    return traced(spark, d, "customer", *_CUSTOMER).key_by("k", F.col("c_nationkey") + 100).provenance("k >= 112").df


@query("SELECT doc_id, text FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def prov_flat_map(spark, d):
    return traced(spark, d, "documents", "doc_id", "text").flat_map("word", F.split("text", " ")).provenance("word = 'the'").df


@query("""WITH w AS (SELECT doc_id, text, unnest(string_split(text, ' ')) AS word FROM documents),
c AS (SELECT doc_id, text, word, count(*) AS n FROM w WHERE word IN ('the', 'der', 'und') GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY word ORDER BY n DESC, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT DISTINCT doc_id, text FROM r WHERE before < 1""")
def expl_flat_map(spark, d):
    out = traced(spark, d, "documents", "doc_id", "text").flat_map("word", F.split("text", " "))
    return Traced(out.df.where("word in ('the', 'der', 'und')").distinct(), out.node).explain().df


@query("SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def prov_filter(spark, d):
    return traced(spark, d, "orders").filter("o_totalprice > 1000").provenance("o_orderstatus = 'F'").df


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey <= 5")
def prov_distinct(spark, d):
    return traced(spark, d, "lineitem", "l_partkey", "l_suppkey").distinct().provenance("l_suppkey <= 5").df


for _dep, (_t, _k) in enumerate((("customer", "c_nationkey"), ("supplier", "s_nationkey"))):

    @query(f"SELECT {_k} AS k FROM {_t} WHERE {_k} < 5 AND {_k} IN (SELECT c_nationkey FROM customer) AND {_k} IN (SELECT s_nationkey FROM supplier)", f"prov_intersection{_dep}")
    def _prov_intersection(spark, d, dep=_dep):
        a, b = _nations(spark, d)
        return a.intersection(b).provenance("k < 5", dep).df

    @query(f"SELECT {_k} AS k FROM {_t} WHERE {_k} < 5", f"prov_union{_dep}")
    def _prov_union(spark, d, dep=_dep):
        a, b = _nations(spark, d)
        return a.union(b).provenance("k < 5", dep).df


@query("SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) AND s_nationkey < 12")
def expl_union(spark, d):
    """Of each key tracked once, the first parent that has it gives the row; here, what is left for the second."""
    a, b = _nations(spark, d)
    both = a.union(b)
    return Traced(both.df.where("k < 12").distinct(), both.node).explain(None, 1).df


@query("SELECT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_partkey > 100")
def prov_subtract(spark, d):
    a = Traced.source(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))
    return a.subtract(Traced.source(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")))).provenance("k > 100").df


@query("SELECT p_partkey AS k FROM part WHERE false")
def prov_subtract_other(spark, d):
    a = Traced.source(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))
    return a.subtract(Traced.source(table(spark, d, "part").select(F.col("p_partkey").alias("k")))).provenance("k > 100", 1).df


@query("SELECT c_custkey, c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_custkey > 10")
def prov_subtract_by_key(spark, d):
    a = Traced.source(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")))
    return a.subtract_by_key(Traced.source(table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name")), ["k"]).provenance("c_custkey > 10").df


_JOINED = "SELECT o_orderkey AS k, o_custkey, l_partkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice > 90000"


@query(f"SELECT * FROM (SELECT o_orderkey AS k, o_custkey FROM orders) INTERSECT ALL (SELECT k, o_custkey FROM ({_JOINED}))")
def prov_join0(spark, d):
    orders, lines = _order_lines(spark, d)
    return orders.join(lines, ["k"]).provenance("l_extendedprice > 90000").df


@query("SELECT l_orderkey AS k, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 90000")
def prov_join1(spark, d):
    orders, lines = _order_lines(spark, d)
    return orders.join(lines, ["k"]).provenance("l_extendedprice > 90000", 1).df


@query("SELECT DISTINCT o_orderkey AS k, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice > 90000")
def expl_join0(spark, d):
    orders, lines = _order_lines(spark, d)
    return orders.join(lines, ["k"]).explain("l_extendedprice > 90000").df


@query("SELECT l_orderkey AS k, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 90000")
def expl_join1(spark, d):
    orders, lines = _order_lines(spark, d)
    return orders.join(lines, ["k"]).explain("l_extendedprice > 90000", 1).df


for _dep, _cols in enumerate(("r_regionkey, r_name", "n_nationkey, n_name, n_regionkey")):
    _side = ("region", "nation")[_dep]

    @query(f"SELECT {_cols} FROM {_side}" + (" WHERE n_name > 'I'" if _dep else ""), f"prov_cartesian{_dep}")
    def _prov_cartesian(spark, d, dep=_dep):
        return traced(spark, d, "region").cartesian(traced(spark, d, "nation")).provenance("n_name > 'I'", dep).df

    @query(f"SELECT {_cols} FROM {_side}" + (" WHERE n_name > 'I'" if _dep else ""), f"expl_cartesian{_dep}")
    def _expl_cartesian(spark, d, dep=_dep):
        return traced(spark, d, "region").cartesian(traced(spark, d, "nation")).explain("n_name > 'I'", dep).df


_COGROUP_SIDES = (("customer", "c_nationkey", "c_custkey"), ("supplier", "s_nationkey", "s_suppkey"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
for _n in (2, 3, 4):
    for _dep in range(_n):
        _t, _k, _v = _COGROUP_SIDES[_dep]

        @query(f"SELECT {_k} AS k, {_v} FROM {_t} WHERE {_k} < 7", f"prov_cogroup{_n}_{_dep}")
        def _prov_cogroup(spark, d, n=_n, dep=_dep):
            first, *others = _by_nation(spark, d)[:n]
            return first.cogroup(*others, on=["k"]).provenance("k < 7", dep).df


@query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 900)")
def prov_combine(spark, d):
    return traced(spark, d, "lineitem", "l_partkey", "l_quantity").reduce_by_key(["l_partkey"], "v", "sum", "l_quantity").provenance("v > 900").df


@query("SELECT l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1 HAVING max(l_extendedprice) > 80000")
def expl_selection(spark, d):
    return traced(spark, d, "lineitem", "l_partkey", "l_extendedprice").reduce_by_key(["l_partkey"], "v", "max", "l_extendedprice").explain("v > 80000").df


@query("""SELECT l_orderkey, l_tax FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_tax) < 0.055)
AND (l_tax <> 0 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax <> 0))""")
def expl_aggregation(spark, d):
    return traced(spark, d, "lineitem", "l_orderkey", "l_tax").reduce_by_key(["l_orderkey"], "v", "sum", "l_tax").explain("v < 0.055").df


@query("""SELECT l_orderkey, l_tax FROM lineitem WHERE l_tax > 0.02 AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_tax) > 0.3)""")
def expl_aggregation_guard(spark, d):
    """Sums of exactly 0.30 are above or below 0.3 by the order of their terms: it is that of the table's rows, whatever the tasks."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = Traced.source(table(spark, d, "lineitem").select("l_orderkey", "l_tax", *place), "lineitem")
    total = F.reduce(F.sort_array(F.collect_list(F.struct("file", "row", "l_tax"))), F.lit(0.0), lambda v, r: v + F.coalesce(r["l_tax"], F.lit(0.0)))
    return rows.combine(["l_orderkey"], [Aggregation(0, F.col("l_tax") > 0.02)], True, ["sum"], "l_tax", v=total).explain("v > 0.3").df.select("l_orderkey", "l_tax")


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 5)")
def expl_removing_dups(spark, d):
    rows = traced(spark, d, "lineitem", "l_suppkey", "l_partkey")
    return rows.combine(["l_suppkey"], [RemovingDups()], True, ["count_distinct"], "l_partkey", v=F.countDistinct("l_partkey")).explain("v > 5").df


@query("SELECT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey < 5")
def expl_group(spark, d):
    return traced(spark, d, "lineitem", "l_suppkey", "l_partkey").group_by_key(["l_suppkey"], "parts", "l_partkey").explain("l_suppkey < 5").df


# multi-step traces ------------------------------------------------------------------------------------------------------


def _spend(spark, d):
    orders, lines = _order_lines(spark, d)
    return orders.join(lines, ["k"]).reduce_by_key(["o_custkey"], "total", "sum", "l_extendedprice").filter("total > 1500000")


_SPENDERS = "SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING sum(l_extendedprice) > 1500000"


@query(f"SELECT l_orderkey AS k, l_partkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN ({_SPENDERS})")
def trace_join_agg(spark, d):
    return _spend(spark, d).go_back_to("lineitem").df


@query(f"SELECT 'orders' AS side, count(*) AS n FROM orders WHERE o_custkey IN ({_SPENDERS}) AND o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN ({_SPENDERS})")
def trace_two_sources(spark, d):
    found = _spend(spark, d).go_back_to_multiple(["orders", "lineitem"])
    return found["orders"].df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("side"), "n").union(found["lineitem"].df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("side"), "n"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey < 5 OR c_nationkey > 20")
def trace_diamond(spark, d):
    source = traced(spark, d, "customer", *_CUSTOMER)
    low, high = source.filter("c_nationkey < 5"), source.filter("c_nationkey > 20 or c_nationkey < 3")
    return low.union(high).go_back_to("customer").df


@query("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t WHERE n <= 5)""")
def trace_iterate_flip(spark, d):
    """Customers of few orders, per number of orders: a replay of too few rows would move customers between numbers."""
    rows = traced(spark, d, "orders", "o_custkey", "o_orderstatus")
    per = rows.aggregate_by_key(["o_custkey"], n=F.count(F.lit(1)))
    return per.filter("n <= 5").aggregate_by_key(["n"], customers=F.count(F.lit(1))).go_back_and_explain("orders").df


# graph ------------------------------------------------------------------------------------------------------------------

_CHAIN = """e AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem QUALIFY dst IS NOT NULL)"""
_IDS = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def chain(spark, d) -> DataFrame:
    """Edges from each part of an order to the next one."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return line.where("dst is not null").withColumn("attr", F.lit(1))


def _pagerank_sql(rounds: int, first: float = 1.0) -> str:
    steps = ["w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)", f"r0 AS (SELECT id, {first}::DOUBLE AS rank FROM v)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT v.id, 0.15 + 0.85 * coalesce(s.got, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank * w) AS got FROM w JOIN r{i} ON id = src GROUP BY dst) s ON s.dst = v.id)")
    return f"WITH {_CHAIN}, {_IDS}, " + ", ".join(steps)


@query(_pagerank_sql(4) + " SELECT id, round(rank * (SELECT count(*) / sum(rank) FROM r4), 6) AS rank FROM r4")
def gr_pagerank(spark, d):
    return graph.pagerank(chain(spark, d), 4).select("id", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql(12, 0.15) + " SELECT id, round(rank * (SELECT count(*) / sum(rank) FROM r12), 6) AS rank FROM r12")
def gr_pagerank_delta(spark, d):
    """Twelve rounds, in which no change falls to the tolerance, are twelve rounds from the reset probability."""
    return graph.pagerank_until(chain(spark, d), 1e-9, most=12).select("id", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql(4) + " SELECT p_name, round(rank, 6) AS rank FROM r4 JOIN part ON p_partkey = id")
def gr_rank_join(spark, d):
    ranks = graph.pagerank(chain(spark, d), 4, normalize=False)
    return ranks.join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id").select("p_name", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql(3) + " SELECT round(sum((a.rank - b.rank) * (a.rank - b.rank)), 6) AS difference FROM r3 a JOIN r1 b USING (id)")
def gr_rank_diff(spark, d):
    edges = cut(chain(spark, d))
    return graph.rank_difference(graph.pagerank(edges, 3, normalize=False), graph.pagerank(edges, 1, normalize=False)).select(F.round("difference", 6).alias("difference"))


def _min_label_sql(rounds: int) -> str:
    steps = ["b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "c0 AS (SELECT id, id AS component FROM v)"]
    steps += [f"c{i + 1} AS (SELECT c.id, least(c.component, coalesce(n.low, c.component)) AS component FROM c{i} c LEFT JOIN (SELECT src, min(component) AS low FROM b JOIN c{i} ON id = dst GROUP BY src) n ON n.src = c.id)" for i in range(rounds)]
    return f"WITH {_CHAIN}, {_IDS}, " + ", ".join(steps) + f" SELECT id, component FROM c{rounds}"


@query(_min_label_sql(10))
def gr_components(spark, d):
    return graph.connected_components(chain(spark, d))


@query(f"WITH {_CHAIN}, {_IDS} SELECT id, id AS component FROM v")
def gr_scc_canonical(spark, d):
    return graph.strongly_connected_components(graph.canonical(chain(spark, d)))


@query()
def gr_scc_directed(spark, d):
    return graph.strongly_connected_components(chain(spark, d))


@query(f"""WITH {_CHAIN}, {_IDS}, s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b),
p AS (SELECT i AS id FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t)
SELECT v.id, count(p.id) AS triangles FROM v LEFT JOIN p USING (id) GROUP BY v.id""")
def gr_triangles(spark, d):
    return graph.triangle_counts(chain(spark, d))


def _lpa_sql(rounds: int) -> str:
    steps = ["b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)", "l0 AS (SELECT id, id AS label FROM v)"]
    steps += [f"l{i + 1} AS (SELECT dst AS id, label FROM (SELECT dst, label, count(*) AS n FROM b JOIN l{i} ON id = src GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, label) = 1)" for i in range(rounds)]
    return f"WITH {_CHAIN}, {_IDS}, " + ", ".join(steps) + f" SELECT id, label FROM l{rounds}"


@query(_lpa_sql(3))
def gr_lpa(spark, d):
    return graph.label_propagation(chain(spark, d), 3)


_HOPS = 12


def _bfs_sql(edges: str, start: str, rounds: int = _HOPS) -> str:
    steps = [f"h0 AS (SELECT id, 0 AS hops FROM ({start}))"]
    steps += [f"h{i + 1} AS (SELECT id, min(hops) AS hops FROM (SELECT id, hops FROM h{i} UNION ALL SELECT e2.b, hops + 1 FROM h{i} JOIN ({edges}) e2 ON e2.a = h{i}.id) GROUP BY id)" for i in range(rounds)]
    return ", ".join(steps)


@query(f"WITH {_CHAIN}, {_IDS}, " + _bfs_sql("SELECT DISTINCT dst AS a, src AS b FROM e", "SELECT 1 AS id") + f" SELECT id, 1::BIGINT AS landmark, hops FROM h{_HOPS} WHERE id IN (SELECT id FROM v)")
def gr_landmarks(spark, d):
    return graph.landmark_distances(chain(spark, d), [1])


@query(f"WITH {_CHAIN}, " + _bfs_sql("SELECT DISTINCT src AS a, dst AS b FROM e", "SELECT 42 AS id") + f" SELECT id, CAST(hops AS DOUBLE) AS distance FROM h{_HOPS}")
def gr_sssp(spark, d):
    return graph.shortest_paths_from(chain(spark, d), 42)


@query(f"WITH {_CHAIN}, x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM x GROUP BY id")
def gr_degrees(spark, d):
    return graph.degrees(chain(spark, d))


@query(f"WITH {_CHAIN} SELECT src, dst, 1 AS attr, a.p_size AS src_attr, b.p_size AS dst_attr FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst")
def gr_triplets(spark, d):
    return graph.triplets(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("attr")), graph.partition_by_random_vertex_cut(chain(spark, d), 8))


@query(f"WITH {_CHAIN} SELECT src, dst, 1.0::DOUBLE AS attr, CASE WHEN dst % 2 = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS parity_attr FROM e")
def gr_parity_edges(spark, d):
    return graph.parity_edges(chain(spark, d))


@query()
def gr_svd_plus_plus(spark, d):
    """Vectors of customers and suppliers from the quantities between them."""
    deals = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = deals.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg((F.avg("l_quantity") / 10).alias("attr"))
    users, items = graph.svd_plus_plus(edges, rank=4, iterations=1)
    return users.select(F.lit("user").alias("side"), "id", "bias", "norm").union(items.select(F.lit("item").alias("side"), "id", "bias", "norm"))


# machine learning -------------------------------------------------------------------------------------------------------


def _samples(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 100000).alias("label"), F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"), (F.col("l_returnflag") == "R").cast("double").alias("flag"))


_X = "x AS (SELECT l_extendedprice / 100000 AS y, 1.0::DOUBLE AS a, l_quantity / 50 AS b, l_discount * 10 AS c, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM lineitem)"


def _gd_sql(rounds: int, pull: str) -> str:
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc)"]
    for i in range(1, rounds + 1):
        g = f"(SELECT count(*) AS n, sum(p * a) AS ga, sum(p * b) AS gb, sum(p * c) AS gc FROM (SELECT a, b, c, {pull} AS p FROM x, w{i - 1}))"
        steps.append(f"w{i} AS (SELECT wa - ga / n / sqrt({i}) AS wa, wb - gb / n / sqrt({i}) AS wb, wc - gc / n / sqrt({i}) AS wc FROM w{i - 1}, {g})")
    return f"WITH {_X}, " + ", ".join(steps) + f" SELECT round(wa, 6) AS w0, round(wb, 6) AS w1, round(wc, 6) AS w2 FROM w{rounds}"


def _weights(spark, weights: list[float]) -> DataFrame:
    return spark.createDataFrame([tuple(round(w, 6) for w in weights)], "w0 double, w1 double, w2 double")


@query(_gd_sql(3, "a * wa + b * wb + c * wc - y"))
def ml_linreg_gd3(spark, d):
    return _weights(spark, ml.gradient_descent(_samples(spark, d), 3, 3))


@query(_gd_sql(3, "1 / (1 + exp(-(a * wa + b * wb + c * wc))) - f"))
def ml_logreg_gd3(spark, d):
    return _weights(spark, ml.gradient_descent(_samples(spark, d).drop("label").withColumnRenamed("flag", "label"), 3, 3, "logistic"))


@query(_gd_sql(3, "CASE WHEN (2 * f - 1) * (a * wa + b * wb + c * wc) < 1 THEN -(2 * f - 1) ELSE 0 END"))
def ml_svm_gd3(spark, d):
    return _weights(spark, ml.gradient_descent(_samples(spark, d).drop("label").withColumnRenamed("flag", "label"), 3, 3, "svm"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def ml_linreg_closed(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query(f"WITH {_X} SELECT round(avg((y - 0.5) * (y - 0.5)), 8) AS mse FROM x")
def ml_mse(spark, d):
    return ml.mean_squared_error(_samples(spark, d).withColumn("prediction", F.lit(0.5))).select(F.round("mse", 8).alias("mse"))


@query(f"WITH {_X} SELECT round(avg(CASE WHEN (b > 0.5) <> (f = 1) THEN 1.0 ELSE 0.0 END), 8) AS error FROM x")
def ml_train_err(spark, d):
    rows = _samples(spark, d).select(F.col("flag").alias("label"), (F.col("features")[1] > 0.5).cast("double").alias("prediction"))
    return ml.training_error(rows).select(F.round("error", 8).alias("error"))


@query("""WITH s AS (SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc FROM r""")
def ml_auc(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return ml.area_under_roc(rows).select(F.round("auc", 6).alias("auc"))


def _centers(spark, d) -> list[list[float]]:
    """Means of two labels: two rows of a fixed length."""
    rows = table(spark, d, "embeddings").where("label in (0, 1)").groupBy("label").agg(F.array(*[F.round(F.avg(F.col("embedding")[j].cast("double")), 4) for j in range(64)]).alias("c")).orderBy("label").collect()
    return [r["c"] for r in rows]


_CENTER = "[" + ", ".join(f"round(avg(embedding[{j + 1}]::DOUBLE), 4)" for j in range(64)) + "]"
_ASSIGNED = f"""c AS (SELECT label, {_CENTER} AS c FROM embeddings WHERE label IN (0, 1) GROUP BY label),
q AS (SELECT vec_id, embedding, c.label AS cluster, pow(list_distance(embedding::DOUBLE[], c.c), 2) AS cost FROM embeddings, c),
a AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cost, cluster) = 1)"""


@query(f"WITH {_ASSIGNED} SELECT vec_id, cluster, round(cost, 4) AS cost FROM a")
def ml_kmeans_assign(spark, d):
    return ml.assign(table(spark, d, "embeddings"), _centers(spark, d), "embedding").select("vec_id", "cluster", F.round("cost", 4).alias("cost"))


@query(f"WITH {_ASSIGNED} SELECT cluster, round(avg(embedding[1]::DOUBLE), 6) AS x0, round(avg(embedding[64]::DOUBLE), 6) AS x63 FROM a GROUP BY cluster")
def ml_kmeans_lloyd1(spark, d):
    step = ml.lloyd_step(ml.assign(table(spark, d, "embeddings"), _centers(spark, d), "embedding"), 64, "embedding")
    return step.select("cluster", F.round(F.col("center")[0], 6).alias("x0"), F.round(F.col("center")[63], 6).alias("x63"))


@query(f"WITH {_ASSIGNED} SELECT round(sum(cost), 2) AS wssse FROM a")
def ml_wssse(spark, d):
    return ml.wssse(ml.assign(table(spark, d, "embeddings"), _centers(spark, d), "embedding")).select(F.round("wssse", 2).alias("wssse"))


@query()
def ml_kmeans(spark, d):
    rows = table(spark, d, "embeddings").withColumnRenamed("embedding", "features")
    return ml.kmeans(rows, 10, 5).transform(ml.vectors(rows)).select("vec_id", "prediction")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
SELECT doc_id, word, tf, round(tf * CASE WHEN df >= 2 THEN ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) ELSE 0.0 END, 6) AS tfidf FROM tf JOIN df USING (word)""")
def ml_tfidf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    return ml.term_weights(docs, "doc_id", "words").select("doc_id", "word", "tf", F.round("tfidf", 6).alias("tfidf"))


@query("SELECT " + ", ".join(f"round(covar_samp(embedding[{i}]::DOUBLE, embedding[{j}]::DOUBLE), 6) AS c{i}_{j}" for i in range(1, 5) for j in range(i, 5)) + " FROM embeddings")
def ml_pca_cov(spark, d):
    found = ml.covariance(table(spark, d, "embeddings"), 4, "embedding")
    pick = lambda i, j: F.max(F.when((F.col("i") == i - 1) & (F.col("j") == j - 1), F.round("cov", 6))).alias(f"c{i}_{j}")
    return found.agg(*[pick(i, j) for i in range(1, 5) for j in range(i, 5)])


@query()
def ml_pca(spark, d):
    rows = table(spark, d, "embeddings").withColumnRenamed("embedding", "features")
    return ml.pca(rows, 2).transform(ml.vectors(rows)).select("vec_id", F.col("projected").cast("string").alias("projected"))


def _rated(spark, d) -> DataFrame:
    deals = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return deals.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_suppkey").cast("int").alias("item")).agg(F.avg("l_quantity").alias("rating")).withColumn("digit", F.pmod(F.col("user") + F.col("item"), F.lit(10)))


_RATED = "r AS (SELECT o_custkey AS usr, l_suppkey AS item, avg(l_quantity) AS rating, (o_custkey + l_suppkey) % 10 AS digit FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"WITH {_RATED} SELECT CASE WHEN digit < 6 THEN 'train' WHEN digit < 8 THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM r GROUP BY part")
def ml_digit_split(spark, d):
    parts = ml.digit_split(_rated(spark, d))
    counts = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for p, name in zip(parts, ("train", "validation", "test"), strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


@query(f"WITH {_RATED} SELECT round(sqrt(avg(pow(rating - (SELECT avg(rating) FROM r WHERE digit < 6), 2))), 6) AS rmse FROM r WHERE digit >= 8")
def ml_baseline_rmse(spark, d):
    train, _, test = ml.digit_split(_rated(spark, d))
    return ml.baseline_rmse(train, test).select(F.round("rmse", 6).alias("rmse"))


@query(f"""WITH {_RATED}, tr AS (SELECT * FROM r WHERE digit < 6), g AS (SELECT avg(rating) AS mean FROM tr),
i AS (SELECT item, avg(rating) AS p FROM tr GROUP BY item),
s AS (SELECT rating, mean, coalesce(p, mean) AS p FROM r LEFT JOIN i USING (item) CROSS JOIN g WHERE digit >= 8),
e AS (SELECT sqrt(avg(pow(rating - mean, 2))) AS b, sqrt(avg(pow(rating - p, 2))) AS q FROM s)
SELECT round(b, 6) AS baseline, round(q, 6) AS rmse, round((b - q) / b * 100, 4) AS improvement FROM e""")
def ml_improvement(spark, d):
    """How much better an item's mean rating predicts than the mean of all."""
    train, _, test = ml.digit_split(_rated(spark, d))
    means = train.groupBy("item").agg(F.avg("rating").alias("own"))
    overall = train.agg(F.avg("rating").alias("mean"))
    predicted = test.join(means, "item", "left").crossJoin(F.broadcast(overall)).select("rating", F.coalesce("own", "mean").alias("prediction"))  # overall is one row
    return ml.improvement(train, predicted).select(F.round("baseline", 6).alias("baseline"), F.round("rmse", 6).alias("rmse"), F.round("improvement", 4).alias("improvement"))


@query()
def ml_als(spark, d):
    train, _, test = ml.digit_split(_rated(spark, d))
    return ml.als(train, 8, 5, 0.1).transform(test).select("user", "item", "rating", "prediction")


@query()
def ml_tree_cls(spark, d):
    rows = _samples(spark, d).select(F.col("flag").alias("label"), "features")
    return ml.training_error(ml.tree_classifier(rows, depth=3).transform(ml.vectors(rows)))


@query()
def ml_tree_reg(spark, d):
    rows = _samples(spark, d).select("label", "features")
    return ml.mean_squared_error(ml.tree_regressor(rows, depth=3).transform(ml.vectors(rows)))


@query()
def ml_svm(spark, d):
    rows = _samples(spark, d).select(F.col("flag").alias("label"), "features")
    return ml.area_under_roc(ml.raw_scores(ml.linear_svm(rows, 5).transform(ml.vectors(rows))))


# streaming --------------------------------------------------------------------------------------------------------------

_VIEWS = "e AS (SELECT ts, event_type AS url, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, user_id % 10 AS zip, user_id AS usr FROM events)"


def _sliding_sql(hours: int, slide: int) -> str:
    base = f"to_timestamp(floor(epoch(ts) / {slide * 3600}) * {slide * 3600})"
    back = f"{base} - to_hours(CAST({slide} * k AS BIGINT))"
    return f"{_VIEWS}, s AS (SELECT ({back})::TIMESTAMPTZ AT TIME ZONE 'UTC' AS window_start, e.* FROM e, unnest(range(0, {-(-hours // slide)})) AS u(k) WHERE epoch({back}) + {hours * 3600} > epoch(ts))"


def _stream(spark, d, metric: str, **kw) -> DataFrame:
    import uuid

    views = clicks.views_of_events(clicks.stream_of(spark, f"{d}/events.parquet"))
    out = clicks.run_to_table(clicks.metric(metric)(views, unit="hours", **kw), f"t_{uuid.uuid4().hex}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {_VIEWS} SELECT date_trunc('hour', ts) AS window_start, url, count(*) AS n FROM e GROUP BY ALL")
def st_page_counts(spark, d):
    return _stream(spark, d, "pageCounts", length=1)


@query(f"WITH {_sliding_sql(10, 2)} SELECT window_start, url, count(*) AS n FROM s GROUP BY ALL")
def st_sliding_counts(spark, d):
    return _stream(spark, d, "slidingPageCounts", length=10, slide=2)


@query(f"WITH {_sliding_sql(30, 2)}, r AS (SELECT window_start, zip, avg(CASE WHEN status <> 200 THEN 1.0 ELSE 0.0 END) AS rate FROM s GROUP BY ALL) SELECT window_start, zip, round(rate, 8) AS rate, CASE WHEN rate > 0.05 THEN '**' ELSE '' END AS flag FROM r")
def st_error_rate(spark, d):
    return _stream(spark, d, "errorRatePerZipCode", length=30, slide=2).withColumn("rate", F.round("rate", 8))


@query(f"WITH {_sliding_sql(15, 2)} SELECT window_start, count(DISTINCT usr) AS users FROM s GROUP BY ALL")
def st_active_users(spark, d):
    return _stream(spark, d, "activeUserCount", length=15, slide=2)


@query("SELECT c_custkey AS usr, c_name AS name, event_type AS url FROM events JOIN customer ON user_id = c_custkey")
def st_popular_users(spark, d):
    """A stream-static join, kept as a table batch by batch."""
    import uuid

    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    views = clicks.views_of_events(clicks.stream_of(spark, f"{d}/events.parquet"))
    return clicks.run_to_table(clicks.popular_users(views, users), f"t_{uuid.uuid4().hex}", "append").withColumnRenamed("user", "usr")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def st_word_count(spark, d):
    import uuid

    lines = clicks.stream_of(spark, f"{d}/conversations.parquet").select(F.col("text").alias("value"))
    return clicks.run_to_table(clicks.word_count(lines), f"t_{uuid.uuid4().hex}")


# sorting ----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def so_range_sort(spark, d):
    return sorting.range_sort(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def so_top_k(spark, d):
    return sorting.top_k(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), 50, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n_rows, 0::BIGINT AS broken_inside, 0::BIGINT AS broken_between FROM orders")
def so_validate(spark, d):
    done = sorting.range_sort(table(spark, d, "orders").select(F.hex("o_orderkey").alias("key")), ["key"])
    return sorting.validate(done, "key").drop("checksum")


# more of streaming, generators and model selection ------------------------------------------------------------------------


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def st_stateful_word_count(spark, d):
    """Counts kept as state; the last update of a word is its count."""
    import uuid

    lines = clicks.stream_of(spark, f"{d}/conversations.parquet")
    words = lines.select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    updates = clicks.run_to_table(clicks.stateful_word_count(words), f"t_{uuid.uuid4().hex}", "update")
    return updates.groupBy("word").agg(F.max("n").alias("n"))


@query("SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '(^| )the ')")
def st_grep(spark, d):
    return clicks.grep(table(spark, d, "conversations", "conv_id", "turn", "text"), "(^| )the ", "text")


@query("SELECT true AS near")
def st_distinct_sketch(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    both = clicks.distinct_sketch(words, "word").crossJoin(words.agg(F.countDistinct("word").alias("exact")))  # one row each
    return both.select((F.abs(F.col("estimate") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tag LIMIT 3")
def st_top_tags(spark, d):
    tags = table(spark, d, "events").select(F.concat(F.lit("#"), F.col("event_type")).alias("value"))
    return clicks.top_tags(tags, 3).withColumn("tag", F.expr("substring(tag, 2)"))


@query()
def gen_sort_records(spark, d):
    from plaitwork.sources import datagen

    return sorting.range_sort(datagen.sort_records(spark, 10_000, 4), ["key"]).select(F.hex("key").alias("key"), F.hex("value").alias("value"))


@query()
def gen_log_normal_graph(spark, d):
    from plaitwork.sources import datagen

    return datagen.log_normal_graph(spark, 500, 4, 2.0, 1.0)


@query()
def gen_low_rank_matrix(spark, d):
    from plaitwork.sources import datagen

    return datagen.low_rank_matrix(spark, 50, 20, 10)


@query()
def gen_svm_points(spark, d):
    from plaitwork.sources import datagen

    return datagen.svm_points(spark, 2000, 10)


@query()
def ml_als_selection(spark, d):
    """The grid's best model by validation error, against the mean rating."""
    train, validation, test = ml.digit_split(cut(_rated(spark, d)))
    model, rmse, chosen = ml.select_als(train, validation, (4, 8), (0.1,), (3,))
    scored = ml.improvement(train, model.transform(test))
    return scored.select(F.lit(chosen["rank"]).alias("rank"), F.lit(rmse).alias("validation_rmse"), "rmse", "baseline", "improvement")
