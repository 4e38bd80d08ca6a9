"""Files in and out: binary trees, JSON lines, tab-separated tables, text lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.session import small_side, stage

JSON_GLOB = "*.[jJ][sS][oO][nN]"
CORRUPT = "_corrupt_record"

# Byte limits of one JSON-lines file: the larger one is the default.
ROLL_BYTES = 64 * 1024 * 1024
SMALL_ROLL_BYTES = 1024 * 1024

BATCH_SIZE = 50


def extension_glob(extensions: Sequence[str]) -> str:
    """Glob for a list of extensions; case matters."""
    return "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """``path, modificationTime, length, content`` of a folder tree. Unreadable
    files are skipped, and so are empty ones, which a Spark file scan never lists."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", extension_glob(extensions))
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(root)
    )


def with_corrupt(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def scan_json_lines(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Records of a folder tree, one JSON object per line; the extension's case
    does not matter. A bad line keeps its text in ``_corrupt_record``."""
    return (
        spark.read.schema(with_corrupt(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", JSON_GLOB)
        .json(root)
    )


def parse_json_lines(lines: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """The same for lines that are already in a column."""
    parsed = F.from_json(
        F.col(column), with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, parsed.alias("r")).select(*rest, "r.*")


def write_json_lines(df: DataFrame, path: str, roll_bytes: int = ROLL_BYTES) -> None:
    """One JSON object per record; files hold about ``roll_bytes`` each.

    The row limit follows from the mean record length, so files are not cut at an
    exact byte.
    """
    mean = df.agg(F.avg(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0]
    rows = max(1, int(roll_bytes // mean)) if mean else 0
    df.write.option("maxRecordsPerFile", rows).option("ignoreNullFields", False).json(path)


def scan_tsv(spark: SparkSession, path: str, key: str = "path", **options: str) -> DataFrame:
    """Document keys of a tab-separated matrix: text before the first tab.

    Only the key is taken from a line, so the schema stays fixed however many
    columns the matrix has. The header is the line that starts with ``key`` and has no
    number behind it; a document of that name has numbers.
    """
    lines = spark.read.options(**options).text(path)
    first = F.substring_index("value", "\t", 1)
    last = F.substring_index("value", "\t", -1)
    header = (first == key) & last.try_cast("double").isNull()
    return lines.where(~header).select(
        first.alias(key), F.substring("value", F.length(first) + 2, F.length("value")).alias("cells")
    )


def scan_cluster_column(spark: SparkSession, path: str, column: str = "cluster") -> DataFrame:
    """A file of numbered cluster ids, ``position,"id"``, quotes removed."""
    return (
        spark.read.schema(f"position bigint, {column} string")
        .option("header", True)
        .option("quote", '"')
        .csv(path)
    )


def write_lines(lines: DataFrame, path: str, one_file: bool = False, compression: str | None = None) -> None:
    """Text lines from column ``line``. ``one_file`` gathers them into one file;
    leave it off for anything large. With a ``compression`` such as ``gzip`` the files
    get its ending, by which every Spark reader knows it."""
    out = lines.select("line")
    (out.coalesce(1) if one_file else out).write.text(path, compression=compression)


def corpus_stats_json(stats: DataFrame, total: DataFrame) -> DataFrame:
    """``(line)``: the corpus statistics as JSON lines, the total and then one
    line per word, highest count first. One object for the whole vocabulary would
    have to be built in a single task."""
    head = total.select(F.to_json(F.struct(F.col("total_docs").alias("totalDocs"))).alias("line"))
    words = stats.orderBy(F.desc("count"), F.asc("term")).select(
        F.to_json(F.struct("term", "documents", "count")).alias("line")
    )
    return head.unionByName(words)


def send_batches(
    df: DataFrame,
    send: Callable[[list[dict]], None],
    batch_size: int = BATCH_SIZE,
    commit: Callable[[], None] | None = None,
) -> DataFrame:
    """Hand rows to a caller's writer, ``batch_size`` at a time, in each task.

    Returns ``(batches, rows, failed, error)`` per task: ``rows`` were sent, ``failed``
    were in a batch that raised, and ``error`` is the text of the last such error. The
    rest goes on after it; ``commit`` runs once at a task's end. Values arrive as they
    are, integers beside nulls too. Tasks can be repeated after a loss, so the writer
    should write by key.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, batches, rows, failed, error = [], 0, 0, 0, None

        def flush() -> None:
            nonlocal batch, batches, rows, failed, error
            try:
                send(batch)
                rows += len(batch)
            except Exception as problem:
                failed += len(batch)
                error = f"{type(problem).__name__}: {problem}"
            batches, batch = batches + 1, []

        for part in parts:
            for record in part.to_pylist():
                batch.append(record)
                if len(batch) >= batch_size:
                    flush()
        if batch:
            flush()
        if commit is not None:
            commit()
        columns = [pa.array([v], pa.int64()) for v in (batches, rows, failed)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([error], pa.string())], ["batches", "rows", "failed", "error"])

    return df.mapInArrow(run, "batches bigint, rows bigint, failed bigint, error string")


def numbered_lines(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """``(position, line)`` of text files, counted on from one file to the next by path.

    A file is read in splits, each in order by one task. What is counted is the lines per
    split; a running sum over the splits, one row for each, gives every split its first
    number, and a line adds its place in its split. The lines themselves are neither
    sorted nor gathered. Empty lines count, an empty folder gives no rows. The files
    must not change while they are read.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_lines"), F.min("_id").alias("_least"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    placed = lines.join(small_side(stage(begun, "splits")), ["_file", "_start"])
    return placed.select((F.col("_before") + F.col("_id") - F.col("_least") + first).alias("position"), "line")


def paired_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """``(position, left, right)``: the lines of two texts that have the same number; the
    longer one's rest goes."""
    one = numbered_lines(spark, left).withColumnRenamed("line", "left")
    other = numbered_lines(spark, right).withColumnRenamed("line", "right")
    return one.join(other, "position")
