"""Counts of a stream's micro-batches, written while it runs."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, batch bigint, at timestamp, metric string, value bigint"


class BatchMetrics(StreamingQueryListener):
    """Writes one small JSON file per micro-batch with what ``observe`` counted under ``name``.

    Files are named by query run and batch number, so a repeated event writes the same file
    again. Metrics are counts or sums; a null counts as 0.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder = spark, name, folder
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is None:
            return
        lines = [
            json.dumps({"run": str(progress.runId), "batch": progress.batchId, "at": progress.timestamp,
                        "metric": metric, "value": int(value or 0)})
            for metric, value in seen.asDict().items()
        ]
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{progress.runId}-{progress.batchId:08d}.json")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
        finally:
            out.close()

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, run: str, seconds: float = 60) -> None:
        """Until the events of a query run that has ended have all been seen."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(run) in self.ended, seconds):
                raise TimeoutError(f"no end of query run {run} within {seconds} seconds")


@contextmanager
def recorded(spark: SparkSession, name: str, folder: str) -> Iterator[BatchMetrics]:
    """Record the metrics of all queries started meanwhile that observe ``name``."""
    listener = BatchMetrics(spark, name, folder)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def watched(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``rows`` with aggregates that are taken as they pass; no second look at them."""
    first, *rest = [value.alias(metric) for metric, value in counts.items()]
    return rows.observe(name, first, *rest)


def table(spark: SparkSession, folder: str) -> DataFrame:
    """``(run, batch, at, metric, value)``, a row per metric of each micro-batch so far."""
    return spark.read.schema(SCHEMA).json(folder)


def totals(metrics: DataFrame) -> DataFrame:
    """``(metric, total, batches)`` over all micro-batches."""
    return metrics.groupBy("metric").agg(
        F.sum("value").alias("total"), F.count_distinct("run", "batch").alias("batches")
    )
