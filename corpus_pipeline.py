"""Training-data pipeline over ``documents``: each stage reads what the one before wrote.

Four stages filter or clean and return the columns of ``documents``; the last one turns
the remaining texts into tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, line_dedup, minhash, sentencepiece_codec, toxicity
from corpusloom.llm.queries import piece_model
from corpusloom.llm.staging import Staging


#: bytes of a batch that goes to a Python worker and back; Spark's own default, 64 MB, leaves as
#: much again in the buffers of every task of an executor. It bounds memory, never a result.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no later query of the session send larger Arrow batches than ``BATCH_BYTES``;
    a smaller value that the session was given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = str(spark.conf.get(key, str(BATCH_BYTES * 2))).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(told[-1:], 1)
    if int(told.rstrip("kmg")) * unit > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the models learn from the documents read here.

    Null, empty and wordless texts say nothing either way and stay, as do rows without
    doc_id. Repeated rows are scored alike. Without labelled documents nothing goes.
    """
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but their first one.

    ``n_chars`` follows the text. A document that loses every line goes; null and empty
    texts stay as they are, and a null source counts as no site.
    """
    return line_dedup.drop_boilerplate(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go, except the first document of each group.

    Documents without words are near nothing and stay, repeated rows of the kept
    document stay too.
    """
    small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts hold none, and null
    or wordless items are in no document."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the piece ids of each text with begin and end, and the text they decode to;
    a null text counts as empty."""
    small_batches(spark)
    return sentencepiece_codec.encode(docs, piece_model(), decoded=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", as_tokens),
]

# SQL expresses neither the trained model nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; every stage's result is written first. Columns
    besides those of ``documents`` go along up to the last stage; an empty table gives no rows."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.swap(docs, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
