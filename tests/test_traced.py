"""Forward and backward rules on small bags with duplicates and nulls."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaitwork.operators.annotations import Aggregation, RemovingDups, Selection, infer
from plaitwork.operators.bags import anti, bag_intersect, bag_max_union, bag_subtract, merge, replicate
from plaitwork.operators.traced import TraceError, Traced


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def frame(spark, rows, schema):
    return Traced.source(spark.createDataFrame(rows, schema))


def test_three_kinds_of_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (1,), (3,), (None,)], "x int")
    assert bag(bag_intersect(a, b)) == Counter({(1,): 2, (None,): 1})
    assert bag(bag_subtract(a, b)) == Counter({(1,): 1, (2,): 1, (None,): 1})
    assert bag(anti(a, b)) == Counter({(2,): 1})
    assert bag(bag_max_union(a, b)) == Counter({(1,): 3, (2,): 1, (None,): 2, (3,): 1})
    assert bag(merge(a, b)) == Counter({(1,): 3, (2,): 1, (None,): 2, (3,): 1})
    assert bag(replicate(spark.createDataFrame([("a", 2), ("b", 0)], "k string, n long"), "n")) == Counter({("a",): 2})


def test_map_that_collides(spark):
    rows = frame(spark, [(1, "a"), (-1, "a"), (2, "b"), (None, "c")], "x int, y string")
    out = rows.map(ax=F.abs("x"))
    assert bag(out.provenance("ax = 1").df) == Counter({(1, "a"): 1, (-1, "a"): 1})
    assert bag(out.provenance("ax is null").df) == Counter({(None, "c"): 1})
    once = Traced(out.df.where("ax = 1").distinct(), out.node)
    assert bag(once.explain().df) == Counter({(-1, "a"): 1})


def test_inverse_needs_no_join(spark):
    out = frame(spark, [(1,), (2,)], "x int").map([F.col("y") - 1], y=F.col("x") + 1)
    back = out.provenance("y = 3").df
    assert bag(back) == Counter({(2,): 1})
    assert "Join" not in back._jdf.queryExecution().executedPlan().toString()


def test_flat_map_cover(spark):
    rows = frame(spark, [("aab",), ("ab",), ("b",), ("aab",)], "s string")
    out = rows.flat_map("c", F.filter(F.split("s", ""), lambda x: x != ""))
    assert bag(out.provenance("c = 'a'").df) == Counter({("aab",): 2, ("ab",): 1})
    three = Traced(out.df.where("c = 'a'").limit(3), out.node)  # two from the first aab, one more
    assert bag(three.explain().df) == Counter({("aab",): 2})


def test_union_is_greedy(spark):
    a, b = frame(spark, [("x",), ("y",)], "s string"), frame(spark, [("x",), ("x",)], "s string")
    out = a + b
    two = Traced(out.df.where("s = 'x'").limit(2), out.node)
    assert bag(two.explain(None, 0).df) == Counter({("x",): 1})
    assert bag(two.explain(None, 1).df) == Counter({("x",): 1})
    assert bag(out.provenance("s = 'x'", 1).df) == Counter({("x",): 2})


def test_join_with_duplicates(spark):
    a = frame(spark, [(1, "v"), (1, "v"), (2, "u"), (None, "n")], "k int, v string")
    b = frame(spark, [(1, "w"), (1, "w"), (1, "w"), (None, "m")], "k int, w string")
    out = a.join(b, ["k"])
    assert bag(out.df) == Counter({(1, "v", "w"): 6, (None, "n", "m"): 1})
    assert bag(out.provenance("v = 'v'").df) == Counter({(1, "v"): 2})
    some = Traced(out.df.where("v = 'v'").limit(4), out.node)
    assert bag(some.explain(None, 0).df) == Counter({(1, "v"): 2})
    assert bag(some.explain(None, 1).df) == Counter({(1, "w"): 2})  # four rows from two lefts need two rights


def test_cogroup_and_subtract(spark):
    a, b = frame(spark, [(1, "a"), (1, "b"), (None, "n")], "k int, v string"), frame(spark, [(1, "x"), (2, "y")], "k int, w string")
    out = a.cogroup(b, on=["k"])
    assert out.df.count() == 3
    assert bag(out.provenance("k = 1", 0).df) == Counter({(1, "a"): 1, (1, "b"): 1})
    assert bag(out.provenance("k = 2", 1).df) == Counter({(2, "y"): 1})
    gone = a.subtract_by_key(b, ["k"])
    assert bag(gone.df) == Counter({(None, "n"): 1})
    assert gone.provenance(None, 1).df.count() == 0


def test_combine_modes(spark):
    rows = frame(spark, [("a", 0), ("a", 0), ("a", 3), ("b", 0), ("b", 0), ("c", 5)], "k string, v int")
    total = rows.reduce_by_key(["k"], "s", "sum", "v")
    assert bag(total.provenance("k = 'a'").df) == Counter({("a", 0): 2, ("a", 3): 1})
    assert bag(total.explain("k = 'a'").df) == Counter({("a", 3): 1})
    assert bag(total.explain("k = 'b'").df) == Counter({("b", 0): 2})  # no telling value: all of them
    assert bag(rows.reduce_by_key(["k"], "m", "max", "v").explain("k = 'a'").df) == Counter({("a", 3): 1})
    unique = rows.combine(["k"], [RemovingDups()], True, ["collect_set"], "v", s=F.size(F.collect_set("v")))
    assert bag(unique.explain("k = 'a'").df) == Counter({("a", 0): 1, ("a", 3): 1})
    fold = rows.fold_by_key(["k"], "f", F.lit(0), lambda s, x: s * 10 + x, "v")
    assert bag(fold.df) == Counter({("a", 3): 1, ("b", 0): 1, ("c", 5): 1})


def test_annotations_follow_the_aggregate():
    assert infer(["min"]) == [Selection()] and infer(["sum"]) == [Aggregation(0)] and infer(["product"]) == [Aggregation(1)]
    assert infer(["collect_list"]) == [] and infer(["sum", "min"]) == []


def test_physical_operations_keep_the_node(spark):
    rows = frame(spark, [(2,), (1,)], "x int").named("in")
    moved = rows.filter("x > 0").coalesce(1).repartition(2).partition_by(2, "x").sort_by_key("x")
    assert [r.x for r in moved.df.collect()] == [1, 2]
    assert bag(moved.go_back_to("in", "x = 1").df) == Counter({(1,): 1})


def test_errors(spark):
    rows = frame(spark, [(1,)], "x int")
    with pytest.raises(TraceError):
        rows.provenance()
    with pytest.raises(TraceError):
        rows.filter("x = 1").provenance(None, 2)
    with pytest.raises(TraceError):
        rows.filter("x = 1").go_back_to("nowhere")


def test_diamond_merges_paths(spark):
    rows = frame(spark, [(1,), (1,), (2,), (3,)], "x int").named("in")
    out = rows.filter("x < 3").union(rows.filter("x > 1"))
    assert bag(out.go_back_to("in").df) == Counter({(1,): 2, (2,): 1, (3,): 1})


def test_iteration_pulls_in_what_a_filter_flips_on(spark):
    rows = frame(spark, [("a", 1), ("b", 1), ("b", 2), ("c", 9)], "k string, v int").named("in")
    out = rows.aggregate_by_key(["k"], n=F.count(F.lit(1))).filter("n = 1").map(one=F.lit(1)).aggregate_by_key(["one"], keys=F.count(F.lit(1)))
    found = out.go_back_and_explain("in")
    again = found.df.groupBy("k").count().where("count = 1").count()
    assert again == out.df.first()["keys"] == 2


def test_replay_of_provenance_gives_the_tracked_rows(spark):
    a = frame(spark, [(k, v) for k in range(5) for v in range(k)], "k int, v int").named("a")
    b = frame(spark, [(k, k * 10) for k in range(4)], "k int, w int").named("b")
    out = a.join(b, ["k"]).map(k=F.col("k"), s=F.col("v") + F.col("w"))
    least, every = out.go_back_to_multiple_and_explain(["a", "b"], "s > 10"), out.go_back_to_multiple(["a", "b"], "s > 10")
    for name in ("a", "b"):
        assert bag(least[name].df) <= bag(every[name].df)
    joined = every["a"].df.join(every["b"].df, "k").select("k", (F.col("v") + F.col("w")).alias("s"))
    assert bag(out.df.where("s > 10")) <= bag(joined)
