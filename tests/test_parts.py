"""Sources, sinks, generators, sorting, streaming, ML and the harness."""

import zlib

import pytest
from pyspark.sql import functions as F

from plaitwork import registry
from plaitwork.functions.scalars import Lcg128, format_size, java_hash, parse_size
from plaitwork.operators import ml, sorting
from plaitwork.plans import report
from plaitwork.sources import datagen, readers, sinks
from plaitwork.streaming import clicks


def test_text_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert readers.orders(spark, put("o", "0|7|2007-04-24\n")).collect()[0].bid == 7
    assert readers.order_items(spark, put("i", "1|2.0|3|4.5|5|6\n")).collect()[0].oid == 2
    assert readers.vectors(spark, put("v", "1 2.5\n")).collect()[0].features == [1.0, 2.5]
    assert readers.labeled_points(spark, put("l", "(1.0,[2.0,3.0])\n")).collect()[0].features == [2.0, 3.0]
    edges = readers.edge_list(spark, put("e", "# c\n2 1 9\n1 2\n"), canonical=True).collect()
    assert [(r.src, r.dst, r.attr) for r in edges] == [(1, 2, 1), (1, 2, 1)]
    assert readers.timed_ratings(spark, put("r", "1::2::3.5::17\n")).collect()[0].digit == 7
    assert readers.ratings(spark, put("c", "1,2,3.5\n")).collect()[0].rating == 3.5
    with pytest.raises(ValueError):
        readers.personal_ratings(spark, put("z", "1::2::0::17\n"))
    assert readers.documents(spark, put("d", "a::::b c\nbad\n")).collect()[0].words == ["b", "c"]
    assert readers.id_names(spark, put("n", "1,x\n")).collect()[0].name == "x"
    page = "<m><page><title>T</title><revision><text>[[Category:Z]] " + "w" * 120 + "</text></revision></page><page><title>s</title><revision><text>x</text></revision></page></m>"
    assert [r.categories for r in readers.wiki_pages(spark, put("x", page)).collect()] == [["Z"]]
    review = "product/productId: P\nreview/userId: ab\nreview/score: 4.0\nreview/time: 5\n\n"
    assert readers.reviews(spark, put("m", review)).collect()[0].user == ord("a") * 31 + ord("b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.text(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).collect()[0].value == "1,a"
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.text(df, str(tmp_path / "t"))
    assert sinks.total(df, "x") == 1 and sinks.mean(df, "x") == 1 and sinks.for_all(df, F.col("x") > 0)
    assert sinks.persist(df, "MEMORY_ONLY").count() == 1


def test_sort_records_round_trip_and_validate(spark, tmp_path):
    made = datagen.sort_records(spark, 200, 3)
    sinks.binary_records(made, str(tmp_path / "r"))
    back = readers.binary_records(spark, str(tmp_path / "r"))
    want = [datagen.record(Lcg128().skip(k + 1).x, k) for k in range(200)]
    assert sorted((bytes(r.key), bytes(r.value)) for r in back.collect()) == sorted(want)
    out = sorting.validate(sorting.range_sort(back, ["key"], 3), "key", "value").first()
    assert (out.n_rows, out.broken_inside, out.broken_between) == (200, 0, 0)
    assert out.checksum == sum(zlib.crc32(k + v) for k, v in want)
    assert sorting.validate(spark.range(5).select((-F.col("id")).alias("key")).coalesce(1), "key").first().broken_inside == 4
    low = spark.createDataFrame([(bytearray(b"\x01"),), (bytearray(b"\x7f\x00"),), (bytearray(b"\xff"),)], "key binary")
    assert [bytes(r.key)[0] for r in sorting.range_sort(low, ["key"], 1).collect()] == [1, 0x7F, 0xFF]
    assert [r.p for r in low.select(sorting.prefix_partition("key", 4).alias("p")).collect()] == [0, 1, 3]


def test_scalars(spark):
    assert spark.createDataFrame([("hello",)], "s string").select(java_hash(F.col("s")).alias("h")).first().h == 99162322
    assert parse_size("1m") == 10_000 and format_size(2_000) == "2.0k"
    walk = Lcg128()
    for _ in range(5):
        walk.step()
    assert walk.x == Lcg128().skip(5).x


def test_generators_depend_on_their_seed_alone(spark):
    for make in (lambda: datagen.log_normal_graph(spark, 20, 2, 1.0, 0.5), lambda: datagen.svm_points(spark, 20, 3), lambda: datagen.linear_points(spark, 20, 3, 0.1), lambda: datagen.logistic_points(spark, 20, 3, 1.0), lambda: datagen.kmeans_points(spark, 20, 2, 3, 5.0), lambda: datagen.low_rank_matrix(spark, 4, 5, 2)):
        a, b = make(), make().repartition(5)
        assert a.count() and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert datagen.clicks(spark.range(50).withColumnRenamed("id", "value")).where("user between 1 and 100").count() == 50


def test_ml(spark):
    points = datagen.svm_points(spark, 300, 3)
    weights = ml.gradient_descent(points, 3, 10, "svm")
    scored = points.withColumn("score", ml.dot(F.col("features"), F.lit(weights)))
    assert ml.area_under_roc(scored).first().auc > 0.9
    model = ml.linear_svm(points, 10)
    assert ml.evaluate_auc(model.transform(ml.vectors(points))) > 0.9
    line = datagen.linear_points(spark, 200, 2, 0.01)
    assert ml.mean_squared_error(ml.linear_regression(line).transform(ml.vectors(line))).first().mse < 0.01
    train, test = ml.hash_split(points, "id")
    assert train.count() + test.count() == 300
    cells = datagen.low_rank_matrix(spark, 12, 8, 2).select(F.col("row").cast("int").alias("user"), F.col("col").cast("int").alias("item"), F.col("value").alias("rating"), ((F.col("row") + F.col("col")) % 10).alias("digit"))
    a, b, _ = ml.digit_split(cells)
    assert ml.select_als(a, b, (2,), (0.1,), (2,))[1] < 10
    text = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "id int, words array<string>")
    assert ml.tf_idf(text).count() == 2 and ml.random_relabel(text, "id").count() == 2 and ml.category_labels(text, "id").count() == 2


def test_streams(spark, tmp_path):
    ts = "2024-01-01T00:00:0"
    rows = [(f"{ts}{k}", "u" if k % 2 else "w", 200 if k else 500, 1, k) for k in range(4)]
    spark.createDataFrame(rows, "ts string, url string, status int, zip int, user int").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "s"))
    batch = spark.read.parquet(str(tmp_path / "s"))
    for k, name in enumerate(("pageCounts", "slidingPageCounts", "errorRatePerZipCode", "activeUserCount")):
        stream = clicks.run_to_table(clicks.metric(name)(clicks.stream_of(spark, str(tmp_path / "s"))), f"t{k}")
        assert sorted(map(str, stream.collect())) == sorted(map(str, clicks.metric(name)(batch).collect()))
    with pytest.raises(ValueError):
        clicks.metric("none")
    words = clicks.stream_of(spark, str(tmp_path / "s")).select(F.col("url").alias("word"))
    assert {r.word: r.n for r in clicks.run_to_table(clicks.stateful_word_count(words), "t9", "update").collect()} == {"u": 2, "w": 2}
    assert clicks.grep(batch, "^u", "url").count() == 2
    assert [r.tag for r in clicks.top_tags(spark.createDataFrame([("#a #b",), ("#a x",)], "value string")).collect()] == ["#a", "#b"]
    assert clicks.distinct_sketch(batch, "url").first().estimate == 2
    assert clicks.frequency_sketch(batch, "url").count() == 1


def test_streams_of_folders_named_like_files(spark, tmp_path):
    """The word counts over a table that is one file, and over the same rows in a folder of files of the same name."""
    lines = spark.createDataFrame([(k, k, "user", f"a b{k % 3}  c") for k in range(30)], "conv_id long, turn int, role string, text string")
    (tmp_path / "file").mkdir()
    lines.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "file" / "conversations.parquet")
    lines.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    want = {"a": 30, "c": 30, "b0": 10, "b1": 10, "b2": 10}
    for kind in ("file", "folder"):
        for name in ("st_word_count", "st_stateful_word_count"):
            assert {r.word: r.n for r in registry.QUERIES[name](spark, str(tmp_path / kind)).collect()} == want
    assert clicks.stream_of(spark, f"file:{tmp_path}/folder/conversations.parquet").isStreaming


def test_harness(spark, tmp_path):
    runs = report.run_all([("a", None, lambda: 1), ("b", lambda: 1 / 0, lambda: 1), ("c", None, lambda: 1 / 0), ("d", None, lambda: 1)])
    assert [(r.type, r.status) for r in runs] == [("a", 0), ("b-gen", 1), ("c", 1)]
    report.write_report(runs, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().count("\n") == 4
    assert [r.status for r in report.sweep(spark, "s", "partitions", [2, 4], lambda: spark.range(3).count())] == [0, 0]
    log = '{"Event":"SparkListenerTaskEnd","Task Type":"ResultTask","Task Info":{"Launch Time":1,"Finish Time":4},"Task Metrics":{"Input Metrics":{"Bytes Read":7},"Shuffle Read Metrics":{"Remote Bytes Read":1,"Local Bytes Read":2},"Shuffle Write Metrics":{"Shuffle Bytes Written":5}}}\n{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":0,"Submission Time":1,"Completion Time":9}}\n'
    (tmp_path / "log").write_text(log)
    events = readers.event_log(spark, str(tmp_path / "log"))
    assert report.task_metrics(events).first().result_ms == 3 and report.stage_metrics(events).first().stage_ms == 8
