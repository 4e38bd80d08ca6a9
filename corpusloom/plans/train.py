"""Job: train the document clustering.

``python -m corpusloom.plans.train --documents IN --output MODEL --cluster-number K``
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.language import detect_in_row, detect_language
from corpusloom.plans import clustering as km
from corpusloom.session import build_session, discard, stage
from corpusloom.sources.tables import scan


def read_corpus(
    spark: SparkSession,
    path: str,
    where: str | None = None,
    profiles: str | None = None,
    languages: Sequence[str] = ("en", "fr"),
) -> DataFrame:
    """``(doc_id, text, lang)`` without null texts. Given a profile table, the
    language is detected; otherwise the table has to bring it. With hashed profiles
    (a ``bucket`` column) it is detected in the row, so texts are read once."""
    condition = F.col("text").isNotNull()
    if where:
        condition = condition & F.expr(where)
    if profiles is None:
        return scan(spark, path, ["doc_id", "text", "lang"], condition, "doc_id")
    docs = scan(spark, path, ["doc_id", "text"], condition, "doc_id")
    learned = spark.read.parquet(profiles)
    if "bucket" in learned.columns:
        found = detect_in_row(docs, learned, languages, keep=["text"])
        return found.select("doc_id", "text", F.col("detected").alias("lang"))
    found = detect_language(docs, learned, languages)
    return docs.join(found.select("doc_id", F.col("detected").alias("lang")), "doc_id")


def arguments(description: str) -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description=description)
    args.add_argument("--documents", required=True, help="parquet with doc_id, text and lang")
    args.add_argument("--where", help="SQL condition on the documents")
    args.add_argument("--profiles", help="language profile table, of trigrams or hashed; detects the language")
    args.add_argument("--languages", default="en,fr", help="codes the profiles cover")
    args.add_argument("--master")
    return args


def main(argv: list[str] | None = None) -> float:
    args = arguments(__doc__)
    args.add_argument("-o", "--output", required=True, help="folder for the model")
    args.add_argument("-n", "--cluster-number", type=int, required=True)
    given = args.parse_args(argv)
    spark = build_session("train", given.master)
    docs = read_corpus(spark, given.documents, given.where, given.profiles, given.languages.split(","))
    tokens = stage(km.document_tokens(docs), "tokens")
    model = km.train(tokens, given.cluster_number)
    km.save(model, given.output)
    cost = km.cost(model, tokens).first()["wssse"]
    discard(tokens)
    print(f"within-set sum of squared errors: {cost}")
    return cost


if __name__ == "__main__":
    main()
