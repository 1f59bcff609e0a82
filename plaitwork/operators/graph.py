"""Graph algorithms on two DataFrames: vertices(id, ...) and edges(src, dst, attr).

Loops cut their lineage with checkpoints; a round is joins on vertex ids and one aggregate with map-side combining, so its cost
follows the edges.  Only counts and largest changes reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.operators.bags import cut

CUT_EVERY = 3


def canonical(edges: DataFrame) -> DataFrame:
    """Edges turned so that src <= dst; duplicates and loops stay, attributes become 1."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1).alias("attr"))


def vertices_of(edges: DataFrame, default: Column | None = None) -> DataFrame:
    """Distinct endpoints, with a default attribute if one is given."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends if default is None else ends.withColumn("attr", default)


def map_edges(edges: DataFrame, attr: Column) -> DataFrame:
    return edges.withColumn("attr", attr)


def map_vertices(vertices: DataFrame, attr: Column) -> DataFrame:
    return vertices.withColumn("attr", attr)


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the attributes of both ends."""
    src = vertices.select(F.col("id").alias("src"), F.col("attr").alias("src_attr"))
    dst = vertices.select(F.col("id").alias("dst"), F.col("attr").alias("dst_attr"))
    return edges.join(src, "src").join(dst, "dst").select("src", "dst", "attr", "src_attr", "dst_attr")


def partition_by_random_vertex_cut(edges: DataFrame, n: int) -> DataFrame:
    """Parallel edges go to one partition, by a hash of both ends."""
    return edges.repartition(n, "src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """in, out and total degree of every vertex."""
    return (
        edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        .union(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        .groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))
    )


def _weighted(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    return edges.select("src", "dst").join(out, "src").withColumn("w", 1.0 / F.col("out")).select("src", "dst", "w")


def pagerank(edges: DataFrame, iterations: int, reset: float = 0.15, normalize: bool = True) -> DataFrame:
    """Static PageRank: ranks start at 1; with normalize, they are scaled once, after the last round, to sum to the vertex count."""
    links = cut(_weighted(edges))
    ids = cut(vertices_of(edges))
    ranks = ids.withColumn("rank", F.lit(1.0))
    for i in range(iterations):
        sent = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        ranks = ids.join(sent.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.lit(reset) + F.lit(1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (i + 1) % CUT_EVERY == 0:
            ranks = cut(ranks)
    if not normalize:
        return ranks
    total = ranks.agg((F.count(F.lit(1)) / F.sum("rank")).alias("scale"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") * F.col("scale")).alias("rank"))  # total is one row


def pagerank_until(edges: DataFrame, tolerance: float, reset: float = 0.15, most: int | None = None, normalize: bool = True) -> DataFrame:
    """Dynamic PageRank: a vertex passes on its change only while the change is over the tolerance.

    Runs until no change is; `most` asks for so many rounds at most, whether or not changes are left."""
    links = cut(_weighted(edges))
    ids = cut(vertices_of(edges))
    state = cut(ids.select("id", F.lit(reset).alias("rank"), F.lit(reset).alias("delta")))
    for _ in count() if most is None else range(most):
        live = state.where(F.col("delta") > tolerance)
        if live.isEmpty():
            break
        sent = links.join(live.select(F.col("id").alias("src"), "delta"), "src").groupBy("dst").agg(F.sum(F.col("delta") * F.col("w")).alias("got"))
        change = F.lit(1 - reset) * F.coalesce("got", F.lit(0.0))
        state = cut(state.join(sent.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.col("rank") + change).alias("rank"), change.alias("delta")))
    ranks = state.select("id", "rank")
    if not normalize:
        return ranks
    total = ranks.agg((F.count(F.lit(1)) / F.sum("rank")).alias("scale"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") * F.col("scale")).alias("rank"))  # total is one row


def rank_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum of squared differences of two rankings; a vertex that b lacks counts nothing."""
    both = a.join(b.select("id", F.col("rank").alias("other")), "id", "left")
    return both.agg(F.sum(F.coalesce(F.pow(F.col("rank") - F.col("other"), 2), F.lit(0.0))).alias("difference"))


def pregel(vertices: DataFrame, edges: DataFrame, first: Column, program: Callable[[Column, Column], Column], send: Column, towards: str, combine: Callable[[str], Column], rounds: int | None = None, active: str = "either") -> DataFrame:
    """A vertex-program loop: (id, attr).

    send is an expression of src_attr, dst_attr and attr (of the edge) that gives a message or null; towards is the end (src or
    dst) that gets it.  Messages of a vertex are combined by an aggregate of the column `message`; program makes the new
    attribute from the old one and the message.  Vertices that got a message last round are active; the loop ends when none is.
    An edge sends if an end that `active` names (src, dst or either) is active; with src, only edges of the frontier meet the
    other end's state.  With `rounds`, a loop that isn't done after so many is an error."""
    state = cut(vertices.select("id", program(F.col("attr"), first).alias("attr"), F.lit(True).alias("active")))
    edges = cut(edges)
    for _ in count() if rounds is None else range(rounds):
        src = state.select(F.col("id").alias("src"), F.col("attr").alias("src_attr"), F.col("active").alias("src_active"))
        dst = state.select(F.col("id").alias("dst"), F.col("attr").alias("dst_attr"), F.col("active").alias("dst_active"))
        if active == "src":
            seen = edges.join(src.where("src_active"), "src").join(dst, "dst")
        elif active == "dst":
            seen = edges.join(dst.where("dst_active"), "dst").join(src, "src")
        else:
            seen = edges.join(src, "src").join(dst, "dst").where("src_active or dst_active")
        got = seen.select(F.col(towards).alias("id"), send.alias("message")).where("message is not null").groupBy("id").agg(combine("message").alias("message"))
        new = F.when(F.col("message").isNotNull(), program(F.col("attr"), F.col("message"))).otherwise(F.col("attr"))
        state = cut(state.join(got, "id", "left").select("id", new.alias("attr"), F.col("message").isNotNull().alias("active")))
        if state.where("active").isEmpty():
            return state.select("id", "attr")
    raise RuntimeError(f"pregel: vertices are still active after {rounds} rounds")


def shortest_paths_from(edges: DataFrame, source: int, weight: Column | None = None) -> DataFrame:
    """(id, distance) of vertices that can be reached from the source; weights are 1 unless given.

    A path has fewer edges than there are vertices, so a loop that goes on longer (a negative cycle) is an error."""
    weighted = edges.select("src", "dst", (weight if weight is not None else F.lit(1.0)).cast("double").alias("attr"))
    start = cut(vertices_of(edges)).withColumn("attr", F.when(F.col("id") == source, 0.0).otherwise(float("inf")))
    step = F.when(F.col("src_attr") + F.col("attr") < F.col("dst_attr"), F.col("src_attr") + F.col("attr"))
    done = pregel(start, weighted, F.lit(float("inf")), lambda a, m: F.least(a, m), step, "dst", F.min, max(1, start.count()), "src")
    return done.where(F.col("attr") < float("inf")).select("id", F.col("attr").alias("distance"))


def landmark_distances(edges: DataFrame, landmarks: list[int]) -> DataFrame:
    """(id, landmark, hops) along edge directions from each vertex to each landmark it reaches."""
    back = cut(edges.select(F.col("dst").alias("at"), F.col("src").alias("to")).distinct())
    ids = vertices_of(edges)
    front = cut(ids.where(F.col("id").isin(landmarks)).select("id", F.col("id").alias("landmark"), F.lit(0).alias("hops")))
    found, hops = front, 0
    while True:
        hops += 1
        step = front.join(back, front["id"] == back["at"]).select(F.col("to").alias("id"), "landmark").distinct()
        front = cut(step.join(found, ["id", "landmark"], "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            return found
        found = found.union(front)
        if hops % CUT_EVERY == 0:
            found = cut(found)


def landmark_maps(edges: DataFrame, landmarks: list[int]) -> DataFrame:
    """(id, hops): a map from landmark to hops for every vertex."""
    pairs = landmark_distances(edges, landmarks).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("landmark", "hops")))).alias("hops"))
    return vertices_of(edges).join(pairs, "id", "left")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least vertex id of each component, by hooking to least neighbours and jumping pointers."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(vertices_of(edges).withColumn("component", F.col("id")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("low"))
        hooked = label.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", "component", F.least("component", "low").alias("new"))
        jumped = hooked.join(hooked.select(F.col("id").alias("new"), F.col("new").alias("above")), "new", "left").select("id", "component", F.coalesce("above", "new").alias("new"))
        step = cut(jumped)
        if step.where(F.col("component") != F.col("new")).isEmpty():
            return step.select("id", F.col("new").alias("component"))
        label = step.select("id", F.col("new").alias("component"))


def _least_reaching(ids: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, color): the least vertex from which each vertex can be reached."""
    color = cut(ids.withColumn("color", F.col("id")))
    for _ in range(rounds):
        sent = edges.join(color.select(F.col("id").alias("src"), "color"), "src").groupBy("dst").agg(F.min("color").alias("low"))
        step = cut(color.join(sent.withColumnRenamed("dst", "id"), "id", "left").select("id", F.least("color", "low").alias("color"), (F.col("low") < F.col("color")).alias("moved")))
        color = step.select("id", "color")
        if step.where("moved").isEmpty():
            return color
    raise RuntimeError("colours didn't settle")


def strongly_connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): the least id of each strongly connected component.

    Each outer round takes away vertices without edges in or out, spreads least ids forward as colours, and confirms backwards inside a
    colour from its root.  With `rounds`, vertices that are left after so many rounds keep their colours."""
    ids, left = vertices_of(edges), cut(edges.where("src <> dst").select("src", "dst").distinct())
    if left.where("src > dst").isEmpty() or left.where("src < dst").isEmpty():
        return ids.select("id", F.col("id").alias("component"))  # ids are a topological order: no cycle
    done: list[DataFrame] = []
    rest, outer = cut(ids), 0
    while not rest.isEmpty():
        while True:  # a vertex without edges in or out is a component of its own
            inner = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))
            alone = cut(rest.join(inner, "id", "left_anti"))
            if alone.isEmpty():
                break
            done.append(alone.select("id", F.col("id").alias("component")))
            rest = cut(rest.join(alone, "id", "left_anti"))
            left = cut(left.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(rest.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if rest.isEmpty():
            break
        color = _least_reaching(rest, left)
        outer += 1
        if rounds is not None and outer > rounds:
            done.append(color.select("id", F.col("color").alias("component")))
            break
        same = cut(left.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst", "a"))
        found = cut(color.where("id = color").select("id", F.col("color").alias("component")))
        front = found
        while not front.isEmpty():
            step = same.join(front.select(F.col("id").alias("dst"), "component"), "dst").where("a = component").select(F.col("src").alias("id"), "component").distinct()
            front = cut(step.join(found, "id", "left_anti"))
            found = cut(found.union(front))
        done.append(found)
        rest = cut(rest.join(found, "id", "left_anti"))
        left = cut(left.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(rest.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    return reduce(DataFrame.union, done) if done else ids.select("id", F.col("id").alias("component"))


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(id, triangles) of every vertex; parallel edges count once, loops don't count.

    Edges point from the end of lower degree to the other, so a hub has few edges out and no vertex starts very many wedges."""
    simple = canonical(edges).where("src <> dst").select("src", "dst").distinct()
    degree = simple.select(F.col("src").alias("id")).union(simple.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    a = degree.select(F.col("id").alias("src"), F.col("d").alias("ds"))
    b = degree.select(F.col("id").alias("dst"), F.col("d").alias("dd"))
    first = F.struct(F.col("ds"), F.col("src")) < F.struct(F.col("dd"), F.col("dst"))
    arcs = cut(simple.join(a, "src").join(b, "dst").select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v")))
    wedges = arcs.join(arcs.select("u", F.col("v").alias("w")), "u").where("v <> w")
    closed = wedges.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    per = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return vertices_of(edges).join(per, "id", "left").select("id", F.coalesce("triangles", F.lit(0).cast("long")).alias("triangles"))


def label_propagation(edges: DataFrame, iterations: int) -> DataFrame:
    """(id, label): the most frequent label of the neighbours, both directions; of equally frequent ones the least."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    label = vertices_of(edges).withColumn("label", F.col("id"))
    for i in range(iterations):
        votes = both.join(label.select(F.col("id").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        # the largest (n, -label) is the winner
        best = votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("best")).select(F.col("dst").alias("id"), (-F.col("best.m")).alias("label"))
        label = vertices_of(edges).join(best, "id", "left").select("id", F.coalesce("label", "id").alias("label")) if i == 0 else label.select("id").join(best, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        if (i + 1) % CUT_EVERY == 0:
            label = cut(label)
    return label


def parity_edges(edges: DataFrame) -> DataFrame:
    """Edges with their own attribute as a double; the attribute by parity of dst is also given, as parity_attr."""
    return edges.select("src", "dst", F.col("attr").cast("double").alias("attr"), F.when(F.col("dst") % 2 == 1, 5.0).otherwise(1.0).alias("parity_attr"))


def two_cliques(spark, n: int) -> DataFrame:
    """Cliques of n and n + 1 vertices, and an edge between 0 and n."""
    ids = lambda lo, hi, name: spark.range(lo, hi).withColumnRenamed("id", name)
    one = ids(0, n, "src").crossJoin(ids(0, n, "dst"))
    two = ids(n, 2 * n + 1, "src").crossJoin(ids(n, 2 * n + 1, "dst"))
    return one.union(two).union(spark.range(1).select(F.lit(0).cast("long"), F.lit(n).cast("long"))).where("src <> dst").withColumn("attr", F.lit(1))


def svd_plus_plus(edges: DataFrame, rank: int = 10, iterations: int = 2, low: float = 0.0, high: float = 5.0, g1: float = 0.007, g2: float = 0.007, g6: float = 0.005, g7: float = 0.015, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """SVD++ on (src user, dst item, attr rating): (users, items) with vectors, biases and norms, in full-batch rounds of DataFrame steps.

    A user's implicit part is the mean over its items' second vectors; each round adds to every vertex the summed gradient of its edges."""
    edges = cut(edges.select("src", "dst", F.col("attr").cast("double").alias("attr")))
    mean = edges.agg(F.avg("attr")).first()[0] or 0.0
    vec = lambda salt: F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda k: (F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed + salt)), F.lit(1_000_003)) / 1_000_003.0) * 0.1)
    zero = F.array_repeat(F.lit(0.0), rank)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    times = lambda a, s: F.transform(a, lambda x: x * s)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    vsum = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(rank)])
    stats = lambda end: edges.groupBy(F.col(end).alias("id")).agg(F.avg("attr").alias("avg"), (1 / F.sqrt(F.count(F.lit(1)))).alias("norm"))
    users = cut(stats("src").select("id", vec(0).alias("p"), (F.col("avg") - mean).alias("bias"), "norm"))
    items = cut(stats("dst").select("id", vec(1).alias("q"), vec(2).alias("y"), (F.col("avg") - mean).alias("bias"), "norm"))
    for _ in range(iterations):
        i = items.select(F.col("id").alias("dst"), "q", "y", F.col("bias").alias("bi"))
        part = edges.join(i, "dst").groupBy("src").agg(vsum("y").alias("sy"))
        u = users.join(part.withColumnRenamed("src", "id"), "id", "left").select(F.col("id").alias("src"), "p", F.col("bias").alias("bu"), F.col("norm").alias("nu"), plus(F.col("p"), times(F.coalesce("sy", zero), F.col("norm"))).alias("pu"))
        seen = edges.join(u, "src").join(i, "dst")
        guess = F.greatest(F.lit(low), F.least(F.lit(high), F.lit(mean) + F.col("bu") + F.col("bi") + dot(F.col("q"), F.col("pu"))))
        seen = cut(seen.withColumn("e", F.col("attr") - guess))
        du = seen.select(F.col("src").alias("id"), times(plus(times(F.col("q"), F.col("e")), times(F.col("p"), F.lit(-g7))), F.lit(g2)).alias("dp"), (F.lit(g1) * (F.col("e") - F.lit(g6) * F.col("bu"))).alias("db"))
        di = seen.select(F.col("dst").alias("id"), times(plus(times(F.col("pu"), F.col("e")), times(F.col("q"), F.lit(-g7))), F.lit(g2)).alias("dq"), times(plus(times(F.col("q"), F.col("e") * F.col("nu")), times(F.col("y"), F.lit(-g7))), F.lit(g2)).alias("dy"), (F.lit(g1) * (F.col("e") - F.lit(g6) * F.col("bi"))).alias("db"))
        users = cut(users.join(du.groupBy("id").agg(vsum("dp").alias("dp"), F.sum("db").alias("db")), "id").select("id", plus(F.col("p"), F.col("dp")).alias("p"), (F.col("bias") + F.col("db")).alias("bias"), "norm"))
        items = cut(items.join(di.groupBy("id").agg(vsum("dq").alias("dq"), vsum("dy").alias("dy"), F.sum("db").alias("db")), "id").select("id", plus(F.col("q"), F.col("dq")).alias("q"), plus(F.col("y"), F.col("dy")).alias("y"), (F.col("bias") + F.col("db")).alias("bias"), "norm"))
    return users, items
