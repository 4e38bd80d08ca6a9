"""Streaming versions of the batch steps, run until the input is used up.

Every flow reads a folder as an unbounded source, keeps its progress in a
checkpoint and writes by key or through the exactly-once file sink, so stopping
and starting it again neither loses nor doubles a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import words as ops
from corpusloom.operators.index import IndexTable
from corpusloom.session import small_side, work_path
from corpusloom.sources.files import CORRUPT, JSON_GLOB, extension_glob, with_corrupt

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def json_stream(
    spark: SparkSession, root: str, schema: str, max_files: int = 1000, max_bytes: str | None = None
) -> DataFrame:
    """JSON lines as they appear below ``root``; each file is read once. The two
    limits bound what one micro-batch takes in. A bad line is a row of nulls that keeps
    its text in ``_corrupt_record``."""
    reader = (
        spark.readStream.schema(with_corrupt(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", JSON_GLOB)
    )
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    else:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(root)


def file_stream(spark: SparkSession, root: str, extensions: list[str], max_files: int = 1000) -> DataFrame:
    """Binary files as they appear below ``root``."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", extension_glob(extensions))
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )


def _finish(query: StreamingQuery, timeout: int | None) -> StreamingQuery:
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout} seconds")
    return query


def append_to(rows: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> StreamingQuery:
    """Write a stateless stream to parquet and end when the input is used up."""
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return _finish(query, timeout)


def each_batch(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    timeout: int | None = None,
) -> StreamingQuery:
    """Hand every micro-batch with its number to ``write``, which has to be
    repeatable for the same number."""
    query = (
        rows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return _finish(query, timeout)


def split_bad(good: Callable[[DataFrame, int], None], bad_path: str) -> Callable[[DataFrame, int], None]:
    """A writer for :func:`each_batch`: whole records go to ``good``, the texts of bad
    lines to a folder of their batch below ``bad_path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line")).write.mode("overwrite").parquet(
            f"{bad_path}/batch={number}"
        )
        good(batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT), number)

    return write


def word_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, n)`` of a document stream. A document is one row, so its
    counts are complete at once and no state is kept."""
    return ops.word_count_by_doc(ops.doc_terms(docs))


def running_stats(
    docs: DataFrame, table: IndexTable, checkpoint: str, timeout: int | None = None
) -> StreamingQuery:
    """Running corpus statistics in a keyed table ``term, documents, count``.

    Update mode passes on only the words a batch changed. Each document has to
    arrive once; drop repeated ids first where that is not given (ids without an
    event time are then remembered for ever).
    """
    spark = docs.sparkSession
    if spark.conf.get(STATE_PROVIDER, None) is None or "HDFSBacked" in spark.conf.get(STATE_PROVIDER):
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
    stats = ops.corpus_word_stats(word_counts(docs))
    writer = writer_of(checkpoint)
    return each_batch(stats, lambda batch, number: table.write(batch, number, writer=writer), checkpoint, "update", timeout)


def tfidf_of_counts(counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse TF-IDF of a stream of ``(path, count map)`` records against a fixed
    vocabulary table with ``term, documents, total_docs``.

    The record's map gives both its words and their number, so this is a
    stream-static join without state.
    """
    sized = counted.select(
        F.col("path").alias("doc_id"), F.size("count").alias("distinct_terms"), F.explode("count").alias("term", "n")
    )
    return sized.join(small_side(vocab), "term").select(
        "doc_id",
        "term",
        (F.col("n") / F.col("distinct_terms") * F.log10(F.col("total_docs") / F.col("documents"))).alias("tfidf"),
    )


def feed_index(
    rows: DataFrame, table: IndexTable, checkpoint: str, order: str | None = None, timeout: int | None = None
) -> StreamingQuery:
    """Full-document writes of a stream. A checkpoint is a writer of its own and its
    batch numbers name the commits, so a batch that is run again replaces itself and
    a stream from a new checkpoint touches no earlier commit."""
    writer = writer_of(checkpoint)
    return each_batch(rows, lambda batch, number: table.write(batch, number, order, writer), checkpoint, "append", timeout)


def writer_of(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def new_checkpoint(spark: SparkSession) -> str:
    return work_path(spark, "checkpoint")
