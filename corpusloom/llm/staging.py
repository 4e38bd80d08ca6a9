"""Tables that one operator writes to the shared folder and reads again."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import work_path

BROADCAST_ROWS = 4_000_000


class Staging:
    """Written tables survive a lost executor; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []  # keeps the frames, so that their ids stay unique

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = work_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        self.tables.append(table)
        return table

    def only(self, *tables: DataFrame) -> None:
        """Drop all tables but these."""
        for table in self.tables:
            if not any(table is t for t in tables):
                self.drop(table)

    def swap(self, old: DataFrame, new: DataFrame, label: str) -> DataFrame:
        """Write ``new``, which may read ``old``, then drop ``old``."""
        table = self.keep(new, label)
        self.drop(old)
        return table

    def free_shuffles(self) -> None:
        """Let Spark delete shuffle files that only written tables were made from. It does so
        when the driver collects its garbage, which a large heap may put off for hours."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, table: DataFrame) -> None:
        path = self.paths.pop(id(table), None)
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            where.getFileSystem(conf).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """What is written meanwhile goes to Python workers in batches of at most ``most`` bytes
    (or the session's own smaller bound): a task's buffers on both sides follow them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    told = str(before).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(told[-1:], 1)
    if int(told.rstrip("kmg")) * unit > most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few(keys: DataFrame) -> DataFrame:
    """``keys`` (written rows of a few numbers) hinted for broadcast when counted to
    be at most ``BROADCAST_ROWS``; a larger table is left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def lowest(df: DataFrame, most: int, *key: str) -> DataFrame:
    """The ``most`` rows with the lowest hash of ``key``. Counting the rows first leaves
    about twice as many to sort, however large ``df`` is."""
    total = df.count()
    if total > 2 * most:
        bound = int(2 * most / total * 2**64) - 2**63
        df = df.where(F.xxhash64(*key) < bound)
    return df.orderBy(F.xxhash64(*key), *key).limit(most)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with more underscores before it until no column of ``df`` has it."""
    while name in df.columns:
        name = "_" + name
    return name


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when their path does not have it.

    Sends the package's sources along with the job, once per context.
    """
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    context = spark.sparkContext
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if root in known or getattr(context, "_corpusloom_shipped", None):
        return
    # the driver serves the archive as long as the context lives
    folder = context._corpusloom_shipped = tempfile.TemporaryDirectory()
    archive = os.path.join(folder.name, "corpusloom")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "corpusloom"))
