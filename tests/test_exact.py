"""Trained models, graph loops and streams against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from plaitwork.functions.scalars import java_hash
from plaitwork.operators import graph, ml
from plaitwork.operators.traced import Traced
from plaitwork.sources import sinks
from plaitwork.streaming import clicks


def points(spark, x, label=None):
    rows = [(k, [float(v) for v in row], float(0 if label is None else label[k])) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "id int, features array<double>, label double")


def test_kmeans_finds_blobs_and_lloyd_steps_are_means(spark):
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 4)) + 20 * truth[:, None]
    df = points(spark, x)
    found = {r.id: r.prediction for r in ml.kmeans(df, 3, 20).transform(ml.vectors(df)).select("id", "prediction").collect()}
    assert len({(found[k], truth[k]) for k in range(120)}) == 3
    centers = [x[truth == k][:5].mean(axis=0).tolist() for k in range(3)]
    assigned = ml.assign(df, centers, "features")
    cost = ((x[:, None, :] - np.array(centers)) ** 2).sum(axis=2)
    got = {r.id: (r.cluster, r.cost) for r in assigned.select("id", "cluster", "cost").collect()}
    assert all(got[k][0] == cost[k].argmin() and abs(got[k][1] - cost[k].min()) < 1e-9 for k in range(120))
    assert abs(ml.wssse(assigned).first()[0] - cost.min(axis=1).sum()) < 1e-6
    for r in ml.lloyd_step(assigned, 4, "features").collect():
        assert np.allclose(r.center, x[cost.argmin(axis=1) == r.cluster].mean(axis=0))


def test_trees_learn_steps_exactly(spark):
    x = np.array([[a, b] for a in range(8) for b in range(8)], float)
    label = (x[:, 0] > 3) * 2 + (x[:, 1] > 5)
    df = points(spark, x, label)
    sorted_by_id = lambda model: [r.prediction for r in model.transform(ml.vectors(df)).orderBy("id").collect()]
    assert sorted_by_id(ml.tree_classifier(df, 3)) == label.tolist()
    assert np.allclose(sorted_by_id(ml.tree_regressor(df, 3)), label)
    flat = ml.tree_regressor(df, 1).transform(ml.vectors(df)).orderBy("id").collect()
    half = [label[x[:, 0] <= 3].mean(), label[x[:, 0] > 3].mean()]
    assert np.allclose([r.prediction for r in flat], [half[int(v > 3)] for v in x[:, 0]])
    assert ml.training_error(ml.tree_classifier(df, 3).transform(ml.vectors(df))).first().error == 0


def test_pca_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    df = points(spark, x)
    cov = np.cov(x.T)
    for r in ml.covariance(df, 5).collect():
        assert abs(r["cov"] - cov[r.i, r.j]) < 1e-9
    values, axes = np.linalg.eigh(cov)
    model = ml.pca(df, 2)
    found = np.array(model.pc.toArray())
    for k in range(2):
        assert abs(abs(found[:, k] @ axes[:, -1 - k]) - 1) < 1e-6
    assert np.allclose(model.explainedVariance.toArray(), values[::-1][:2] / values.sum())


def test_als_recovers_low_rank(spark):
    rng = np.random.default_rng(3)
    full = rng.uniform(1, 2, (15, 2)) @ rng.uniform(1, 2, (2, 12))
    cells = spark.createDataFrame([(a, b, float(full[a, b])) for a in range(15) for b in range(12) if (a + b) % 7], "user int, item int, rating double")
    model = ml.als(cells, 2, 20, 0.001)
    assert ml.mean_squared_error(model.transform(cells), "prediction", "rating").first().mse < 0.01


def brute_scc(n, edges):
    reach = np.eye(n, dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(n):
        reach |= reach[:, k : k + 1] & reach[k : k + 1, :]
    return {k: int(np.flatnonzero(reach[k] & reach[:, k])[0]) for k in range(n)}


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((12, 14), (20, 30)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(k, k) for k in range(n)})
        df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, attr int")
        assert {r.id: r.component for r in graph.strongly_connected_components(df).collect()} == brute_scc(n, edges)


def test_pagerank_down_to_its_tolerance(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(15), rng.randrange(15)) for _ in range(50)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, attr int")
    ids = sorted({v for e in edges for v in e})
    out = {v: sum(a == v for a, _ in edges) for v in ids}
    rank, delta = dict.fromkeys(ids, 0.15), dict.fromkeys(ids, 0.15)
    while any(x > 1e-4 for x in delta.values()):
        new = {v: 0.85 * sum(delta[a] / out[a] for a, b in edges if b == v and delta[a] > 1e-4) for v in ids}
        rank, delta = {v: rank[v] + new[v] for v in ids}, new
    got = {r.id: r.rank for r in graph.pagerank_until(df, 1e-4, normalize=False).collect()}
    assert all(abs(got[v] - rank[v]) < 1e-9 for v in ids) and len(got) == len(ids)


def test_weighted_paths_and_active_ends(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12), rng.randint(1, 9)) for _ in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long, attr int")
    far = {0: 0.0}
    for _ in range(12):
        for a, b, w in edges:
            if a in far and far[a] + w < far.get(b, 1e9):
                far[b] = far[a] + w
    start = next(a for a, *_ in edges)
    shift = {start: 0.0}
    for _ in range(12):
        for a, b, w in edges:
            if a in shift and shift[a] + w < shift.get(b, 1e9):
                shift[b] = shift[a] + w
    assert {r.id: r.distance for r in graph.shortest_paths_from(df, start, F.col("attr")).collect()} == shift
    least = [{r.id: r.attr for r in graph.pregel(graph.vertices_of(df, F.col("id")), df, F.lit(99), lambda a, m: F.least(a, m), F.when(F.col("src_attr") < F.col("dst_attr"), F.col("src_attr")), "dst", F.min, active=end).collect()} for end in ("either", "src")]
    assert least[0] == least[1]


def test_hash_of_characters_beyond_the_bmp(spark):
    def plain(text):
        raw, h = text.encode("utf-16-be"), 0
        for k in range(0, len(raw), 2):
            h = (31 * h + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "a", "héllo", "😀", "x😀y𝟘" * 5, "你好"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", java_hash(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: plain(t) for t in texts}


def test_explanations_of_a_hot_output(spark):
    """One output value of most rows: as many rows as are tracked, the first ones in column order."""
    rows = [(k, "x" if k % 10 else f"y{k}") for k in range(400)]
    source = Traced.source(spark.createDataFrame(rows, "k int, w string"), "s")
    low = source.map(w=F.col("w"))
    some = Traced(low.df.where("w = 'x'").limit(17), low.node)
    assert sorted(r.k for r in some.explain().df.collect()) == [k for k in range(400) if k % 10][:17]
    words = Traced.source(spark.createDataFrame([(k, ["x"] * (k % 3 + 1)) for k in range(90)], "k int, ws array<string>"), "t").flat_map("w", F.col("ws"))
    few = Traced(words.df.limit(10), words.node).explain().df.collect()
    assert sorted(r.k for r in few) == [2, 5, 8, 11]  # three words each, the first such rows


def test_a_model_lives_across_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    for k in range(3):
        x = rng.normal(size=(200, 2))
        points(spark, np.c_[np.ones(200), x], (x @ [2, -1] > 0.3).astype(float)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = clicks.stream_of(spark, str(tmp_path / "in"), 1)
    model, seen = clicks.StreamingLogistic(3, 10), []
    update = model.update
    model.update = lambda batch, number: (update(batch, number), seen.append(list(model.weights)))
    model.train_on(stream).awaitTermination()
    assert len(seen) == 3 and seen[0] != seen[1] != seen[2]
    scored = model.predict_on(spark.read.parquet(str(tmp_path / "in")))
    assert ml.training_error(scored).first().error < 0.1


def test_streams_on_a_clock_and_into_files(spark, tmp_path):
    spark.range(10).withColumn("even", F.col("id") % 2 == 0).write.parquet(str(tmp_path / "in"))
    stream, got = clicks.stream_of(spark, str(tmp_path / "in")), []
    query = sinks.each_batch(stream, lambda batch, number: got.append(batch.count()), every="100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert sum(got) == 10
    assert sinks.table(stream, "append").count() == 10
    assert {r.even: r["count"] for r in sinks.table(clicks.stream_of(spark, str(tmp_path / "in")).groupBy("even").count()).collect()} == {True: 5, False: 5}
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("id long").parquet(str(tmp_path / "none"))
    assert sinks.table(empty.groupBy("id").count()).count() == 0


QUEUE = [["a b", "b"], ["c"], []]


def waiting_lines(at: int) -> tuple[list[str], int]:
    """A queue: one entry at a time."""
    return (QUEUE[at], at + 1) if at < len(QUEUE) else ([], at)


def test_a_receiver_of_ones_own(spark):
    got = []
    query = sinks.each_batch(clicks.receive(spark, "tests.test_exact:waiting_lines"), lambda batch, number: got.extend(r.value for r in batch.collect()), every="100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == ["a b", "b", "c"]


def test_improvement_over_the_mean(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "rating double")
    predicted = spark.createDataFrame([(4.0, 4.5), (0.0, -0.5)], "rating double, prediction double")
    row = ml.improvement(train, predicted).first()
    assert (row.baseline, row.rmse, row.improvement) == (2.0, 0.5, 75.0)


def test_rows_that_emit_a_word_often_and_repeat(spark):
    """Provenance takes each row once for every copy of it, however often it emits a tracked word."""
    rows = spark.createDataFrame([(1, "x x y"), (1, "x x y"), (2, "y"), (3, None), (4, "x")], "k int, t string")
    words = Traced.source(rows, "rows").flat_map("w", F.split("t", " "), ["k"])
    assert sorted(r.k for r in words.provenance("w = 'x'").df.collect()) == [1, 1, 4]
    assert sorted(r.k for r in words.explain("w = 'x' and k = 1").df.collect()) == [1, 1]
    assert words.provenance("w = 'z'").df.count() == words.explain("w = 'z'").df.count() == 0


def test_cached_computation(spark):
    from pyspark import StorageLevel

    from plaitwork.plans.lineage import TraceConfig

    base = Traced.source(spark.range(10), "base")
    out = base.map(half=F.floor(F.col("id") / 2)).distinct()
    config = TraceConfig(cache_computation=StorageLevel.MEMORY_AND_DISK)
    assert sorted(r.id for r in out.go_back_to("base", "half = 3", config=config).df.collect()) == [6, 7]
    assert base.node.full.is_cached and out.node.full.is_cached
    base.node.full.unpersist()
    out.node.full.unpersist()
