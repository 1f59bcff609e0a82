"""A small benchmark runner: timed runs with their real outcome, parameter sweeps, and metrics of an event log."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Session settings that sweeps vary.
SUBMIT_OPTIONS = {
    "memory": "spark.executor.memory", "serializer": "spark.serializer", "codec": "spark.io.compression.codec",
    "rdd_compress": "spark.rdd.compress", "parallelism": "spark.default.parallelism", "partitions": "spark.sql.shuffle.partitions",
    "rpc_timeout": "spark.rpc.askTimeout",
}


@dataclass
class Run:
    type: str
    start: str
    duration: float
    size_mb: float
    mb_per_s: float
    status: int
    error: str = ""


def size_of(path: str) -> float:
    """MB of files under a local path."""
    p = Path(path)
    return sum(f.stat().st_size for f in ([p] if p.is_file() else p.rglob("*")) if f.is_file()) / 2**20


def timed(name: str, work: Callable[[], object], size_mb: float = 0.0) -> Run:
    start, began, error = time.strftime("%Y-%m-%d %H:%M:%S"), time.perf_counter(), ""
    try:
        work()
    except Exception as e:
        error = f"{type(e).__name__}: {e}"[:200]
    took = time.perf_counter() - began
    return Run(name, start, round(took, 3), round(size_mb, 6), round(size_mb / took, 6) if took else 0.0, int(bool(error)), error)


def run_all(workloads: Iterable[tuple[str, Callable[[], object] | None, Callable[[], object]]]) -> list[Run]:
    """(name, generate or None, run) in turn: a failed generation skips its run, a failed run ends the series."""
    out = []
    for name, generate, run in workloads:
        if generate is not None:
            out.append(timed(f"{name}-gen", generate))
            if out[-1].status:
                continue
        out.append(timed(name, run))
        if out[-1].status:
            break
    return out


def sweep(spark, name: str, option: str, values: Iterable, work: Callable[[], object]) -> list[Run]:
    """The same work under several values of a setting; settings that need a new session are refused by Spark and reported."""
    key, out = SUBMIT_OPTIONS.get(option, option), []
    before = spark.conf.get(key, None)
    for value in values:
        out.append(timed(f"{name}[{option}={value}]", lambda v=value: (spark.conf.set(key, str(v)), work())))
    if before is not None:
        spark.conf.set(key, before)
    return out


def write_report(runs: list[Run], path: str) -> None:
    with open(path, "w", newline="") as f:
        writer = csv.DictWriter(f, fieldnames=list(asdict(runs[0])) if runs else ["type"])
        writer.writeheader()
        writer.writerows(asdict(r) for r in runs)


def task_metrics(log: DataFrame) -> DataFrame:
    """One row: tasks, bytes read and shuffled, and time by task type, of an event log."""
    m = F.col("Task Metrics")
    tasks = log.where("Event = 'SparkListenerTaskEnd'")
    took = F.col("Task Info.Finish Time") - F.col("Task Info.Launch Time")
    kind = lambda name: F.sum(F.when(F.col("Task Type") == name, took).otherwise(0))
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks"), F.sum(m["Input Metrics"]["Bytes Read"]).alias("input_bytes"),
        F.sum(m["Shuffle Read Metrics"]["Remote Bytes Read"] + m["Shuffle Read Metrics"]["Local Bytes Read"]).alias("shuffle_read"),
        F.sum(m["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("shuffle_written"),
        kind("ShuffleMapTask").alias("map_ms"), kind("ResultTask").alias("result_ms"),
    )


def stage_metrics(log: DataFrame) -> DataFrame:
    """(stages, stage_ms): durations of all stages summed."""
    s = F.col("Stage Info")
    return log.where("Event = 'SparkListenerStageCompleted'").agg(F.count(F.lit(1)).alias("stages"), F.sum(s["Completion Time"] - s["Submission Time"]).alias("stage_ms"))


def application_ms(log: DataFrame) -> DataFrame:
    ends = log.where("Event in ('SparkListenerApplicationStart', 'SparkListenerApplicationEnd')")
    return ends.agg((F.max("Timestamp") - F.min("Timestamp")).alias("application_ms"))
