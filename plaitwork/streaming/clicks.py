"""Click-stream metrics as Structured Streaming; each builder works on a stream or a batch of (ts, url, status, zip, user)."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from plaitwork.operators import ml
from plaitwork.sources import sinks

# Fixed value: the share of errors above which a zip code is flagged.
FLAG = 0.05
HOURS = {"batch": 1, "slide": 2, "pages": 10, "errors": 30, "users": 15}


def _timed(views: DataFrame, late: str | None) -> DataFrame:
    """Event time as a timestamp (a watermark needs one), with a watermark on streams."""
    timed = views.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late and views.isStreaming else timed


def _window(length: int, slide: int | None, unit: str):
    return F.window("ts", f"{length} {unit}", f"{slide} {unit}") if slide else F.window("ts", f"{length} {unit}")


def page_counts(views: DataFrame, length: int = 1, unit: str = "seconds", late: str | None = None) -> DataFrame:
    grouped = _timed(views, late).groupBy(_window(length, None, unit).alias("w"), "url").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "url", "n")


def sliding_page_counts(views: DataFrame, length: int = 10, slide: int = 2, unit: str = "seconds", late: str | None = None) -> DataFrame:
    grouped = _timed(views, late).groupBy(_window(length, slide, unit).alias("w"), "url").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "url", "n")


def error_rate(views: DataFrame, length: int = 30, slide: int = 2, unit: str = "seconds", late: str | None = None) -> DataFrame:
    rate = F.avg((F.col("status") != 200).cast("int"))
    grouped = _timed(views, late).groupBy(_window(length, slide, unit).alias("w"), "zip").agg(rate.alias("rate"))
    return grouped.select(F.col("w.start").alias("window_start"), "zip", "rate", F.when(F.col("rate") > FLAG, "**").otherwise("").alias("flag"))


def active_users(views: DataFrame, length: int = 15, slide: int = 2, unit: str = "seconds", late: str | None = None) -> DataFrame:
    """Exact distinct users per window; a stream keeps the set of a window, a batch counts in two shuffles."""
    grouped = _timed(views, late).withColumn("w", _window(length, slide, unit))
    if views.isStreaming:
        counted = grouped.groupBy("w").agg(F.size(F.collect_set("user")).cast("long").alias("users"))
    else:
        counted = grouped.select("w", "user").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("users"))
    return counted.select(F.col("w.start").alias("window_start"), "users")


def popular_users(views: DataFrame, users: DataFrame) -> DataFrame:
    """Views joined with a static table of (user, name)."""
    return views.select("user", "url").join(users, "user").select("user", "name", "url")


METRICS: dict[str, Callable[..., DataFrame]] = {
    "pageCounts": page_counts, "slidingPageCounts": sliding_page_counts, "errorRatePerZipCode": error_rate,
    "activeUserCount": active_users, "popularUsersSeen": popular_users,
}


def metric(name: str) -> Callable[..., DataFrame]:
    if name not in METRICS:
        raise ValueError(f"no metric is named {name}; there are {', '.join(METRICS)}")
    return METRICS[name]


def views_of_events(events: DataFrame) -> DataFrame:
    """The events table as page views: errors are status 500, the zip is the last digit of the user."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("url"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("user_id") % 10).alias("zip"), F.col("user_id").alias("user"),
    )


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet file or folder at path; what the name ends in doesn't tell them apart."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    folder, _, name = path.rpartition("/")
    one_file = name.endswith(".parquet") and not any(status.isDirectory() for status in found or ())
    return reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)


class Receiver(DataSource):
    """A stream of lines from a function of one's own, named by the option `fetch` ("module:function").

    The function takes an offset and returns the lines after it and the next offset.  It runs on the driver, as a queue or a
    socket does, and must give the same lines again for an offset that was not yet committed."""

    @classmethod
    def name(cls) -> str:
        return "receiver"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Received(self.options["fetch"])


class _Received(SimpleDataSourceStreamReader):
    def __init__(self, fetch: str):
        self.fetch = fetch

    def _lines(self, start: dict) -> tuple[list[tuple[str]], dict]:
        module, _, function = self.fetch.partition(":")
        lines, following = getattr(importlib.import_module(module), function)(start["at"])
        return [(line,) for line in lines], {"at": following}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        lines, following = self._lines(start)
        return iter(lines), following

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        at = start
        while at["at"] < end["at"]:
            lines, at = self._lines(at)
            yield from lines


def receive(spark: SparkSession, fetch: str) -> DataFrame:
    """The stream of lines that the function `fetch` ("module:function") hands out."""
    spark.dataSource.register(Receiver)
    return spark.readStream.format("receiver").option("fetch", fetch).load()


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is, into Parquet files of the shared folder, and return them as the view `name`."""
    return sinks.view(sinks.table(stream, mode), name)


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.explode(F.split(column, " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def grep(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    return lines.where(F.col(column).rlike(pattern))


def stateful_word_count(words: DataFrame) -> DataFrame:
    """(word, n): running counts kept as state, one update per word and batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"word": [key[0]], "n": [n]})

    return words.groupBy("word").applyInPandasWithState(update, "word string, n long", "n long", "update", "NoTimeout")


def top_tags(lines: DataFrame, k: int = 10, column: str = "value") -> DataFrame:
    tags = lines.select(F.explode(F.split(column, r"\s+")).alias("tag")).where(F.col("tag").startswith("#"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def frequency_sketch(df: DataFrame, column: str, eps: float = 0.01, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    return df.agg(F.count_min_sketch(F.col(column), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def distinct_sketch(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column)).alias("estimate"))


def refit_each_batch(stream: DataFrame, fit: Callable[[DataFrame], object], keep: Callable[[int, object], None]):
    """Fit a model again on every batch of labelled rows (streaming logistic regression and the like); keep gets each model."""
    return sinks.each_batch(stream, lambda batch, number: None if batch.isEmpty() else keep(number, fit(batch)))


class StreamingLogistic:
    """Logistic regression whose weights live across batches: each batch of (features, label) moves them some rounds further."""

    def __init__(self, dim: int, rounds: int = 5, step: float = 1.0):
        self.weights, self.rounds, self.step = [0.0] * dim, rounds, step

    def update(self, batch: DataFrame, number: int = 0) -> None:
        if not batch.isEmpty():
            self.weights = ml.gradient_descent(batch, len(self.weights), self.rounds, "logistic", self.step, self.weights)

    def train_on(self, stream: DataFrame, every: str | None = None):
        return sinks.each_batch(stream, self.update, every=every)

    def predict_on(self, rows: DataFrame) -> DataFrame:
        """rows, of a stream or a table, with the present weights' prediction."""
        return rows.withColumn("prediction", (ml.dot(F.col("features"), F.lit(self.weights)) > 0).cast("double"))
