"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The settings only make the defaults explicit; a cluster's own values (shuffle
# partitions, memory, checkpoint folder) come from spark-submit and are kept.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _chosen_warehouse(spark: SparkSession) -> str | None:
    """The warehouse, unless it is Spark's default below the driver's own working folder."""
    at, path = spark.conf.get("spark.sql.warehouse.dir", None), spark._jvm.org.apache.hadoop.fs.Path
    own = path(spark._jvm.java.lang.System.getProperty("user.dir"), "spark-warehouse")
    return at if at and path(at).toUri().getPath() != own.toUri().getPath() else None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Without that setting it is the context's checkpoint folder. On a master other than
    ``local[...]``, a path without a scheme lies in the default file system, as anywhere in
    Spark, a chosen warehouse stands in for a folder that is not set, and none at all is an
    error. Only with an explicit local master, one process, is a temporary folder used instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    one_process = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None
    if not folder:
        folder = tempfile.mkdtemp(prefix="corpusloom-") if one_process else _chosen_warehouse(spark)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return (folder if one_process else _qualified(spark, folder)).rstrip("/")


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several actions need the same expensive rows: the written files
    outlive any executor, so nothing upstream is computed again after a loss.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the folder of a table that :func:`stage` wrote and nothing reads any more."""
    spark, folder = staged.sparkSession, shared_folder(staged.sparkSession)
    for path in {name.rsplit("/", 1)[0] for name in staged.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        plain = where.toUri().getPath()
        if plain.startswith(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()):
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a file scan, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


SCAN_PARTITIONS = "spark.corpusloom.scan.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` as it is, or hashed on ``key`` where the caller asks for it.

    A file is never split below its row groups, so tables written as one row group
    are read in one task. Write them with more row groups, or set
    ``spark.corpusloom.scan.partitions`` for a session that reads such tables; it is
    off unless set, whatever the size of the input.
    """
    partitions = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(partitions), F.xxhash64(key)) if partitions else df


BROADCAST_BYTES = 64 * 1024 * 1024


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint when Catalyst's size estimate allows it.

    A limit bounds that estimate, so a vocabulary cut to its size qualifies; any
    larger table is left to an ordinary join.
    """
    return F.broadcast(df) if planned_bytes(df) <= BROADCAST_BYTES else df
