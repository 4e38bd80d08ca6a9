"""Job: counts, corpus statistics, vocabulary and TF-IDF of a document table.

``python -m corpusloom.plans.corpus --documents IN --output OUT``
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from corpusloom.operators import words as ops
from corpusloom.session import build_session
from corpusloom.sources.tables import scan


def corpus_tables(
    docs: DataFrame,
    out: str,
    size: int = ops.VOCABULARY_SIZE,
    min_count: int = ops.MIN_COUNT,
    total_docs: str = "exact",
) -> None:
    """Write ``terms``, ``stats``, ``vocabulary`` and ``tfidf`` below ``out``.

    Texts are tokenised once: everything after the first table reads that table.
    """
    spark = docs.sparkSession
    ops.doc_terms(docs).write.parquet(f"{out}/terms")
    terms = spark.read.parquet(f"{out}/terms")
    ops.corpus_word_stats(ops.word_count_by_doc(terms)).write.parquet(f"{out}/stats")
    ops.vocabulary_with_total(terms, size, min_count).write.parquet(f"{out}/vocabulary")
    vocab = spark.read.parquet(f"{out}/vocabulary")
    ops.tfidf(terms, vocab, total_docs_mode=total_docs).write.parquet(f"{out}/tfidf")


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--documents", required=True, help="parquet with doc_id, text, lang")
    args.add_argument("--output", required=True)
    args.add_argument("--wordcount", type=int, default=ops.VOCABULARY_SIZE)
    args.add_argument("--min", type=int, default=ops.MIN_COUNT)
    args.add_argument("--total-docs", choices=("exact", "2n_plus_1"), default="exact")
    args.add_argument("--master")
    given = args.parse_args(argv)
    spark = build_session("corpus", given.master)
    docs = scan(spark, given.documents, ["doc_id", "text", "lang"], key="doc_id")
    corpus_tables(docs, given.output, given.wordcount, given.min, given.total_docs)


if __name__ == "__main__":
    main()
