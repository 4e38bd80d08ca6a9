"""Ranking by the weight of query words, and spelling suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import match as m
from corpusloom.functions.rows import literal_rows, once
from corpusloom.operators import fuzzy
from corpusloom.session import small_side


def relevance(terms: DataFrame, words: Sequence[str], k: int | None = 10) -> DataFrame:
    """``(doc_id, score)``, best first: the sum of tf-idf over the query's words.

    The formula is this library's own. Per document only its size and the entries
    of the few query words are kept and hashed by id; the document counts of those
    words (one global aggregation) and the scores both read that small shuffle, so
    texts are tokenised once. The top ``k`` needs no sort of the rest.
    """
    words = sorted(set(words))
    entry = F.filter("terms", lambda e: e["term"].isin(words))
    hits = terms.select("doc_id", F.size("terms").alias("distinct_terms"), entry.alias("hits"))
    hits = hits.repartition("doc_id")

    def count_of(word: str) -> Column:
        found = F.filter("hits", lambda e: e["term"] == word)
        return F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0))

    frequencies = hits.agg(
        F.struct(
            F.count_if(F.col("distinct_terms") > 0).alias("total"),
            *[F.count_if(count_of(w) > 0).alias(f"df_{i}") for i, w in enumerate(words)],
        )
    ).scalar()
    weighted = hits.withColumn("freq", frequencies)
    score = sum(
        (
            count_of(w)
            / F.col("distinct_terms")
            * F.coalesce(F.log10(F.try_divide(F.col("freq.total"), F.col(f"freq.df_{i}"))), F.lit(0.0))
            for i, w in enumerate(words)
        ),
        F.lit(0.0),
    )
    scored = weighted.select("doc_id", "hits", score.alias("score"))
    scored = once(scored, F.when(F.size("hits") > 0, F.col("score")), "score", "doc_id")
    scored = scored.where(F.col("score").isNotNull())
    if k is None:
        return scored
    return scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def suggest(
    stats: DataFrame,
    words: Sequence[str],
    edits: int = 2,
    per_word: int = 1,
    index: DataFrame | None = None,
) -> DataFrame:
    """``(word, suggestion, distance, documents)`` for words not in ``stats``.

    Candidates differ in length by at most ``edits``; nearest first, then most
    documents, then term. The query's words are the
    small side; the vocabulary is read once and never moved whole, as each task
    keeps its best candidates per word. A known word meets itself at distance 0
    and is dropped with its candidates. With an ``index`` of the vocabulary's
    deletion variants (``fuzzy.variant_index``) only terms that share a variant
    with a word are looked at.
    """
    words = sorted({w.lower() for w in words})
    lengths = [(w, n) for w in words for n in range(max(1, len(w) - edits), len(w) + edits + 1)]
    asked = literal_rows(stats.sparkSession, lengths, "word: string, size: int")
    best = Window.partitionBy("word").orderBy(F.asc("distance"), F.desc("documents"), F.asc("term"))
    if index is None:
        near = (
            stats.withColumn("size", F.length("term"))
            .join(small_side(asked), "size")
            .withColumn("distance", F.levenshtein(F.col("term"), F.col("word"), edits))
            .where(F.col("distance") >= 0)
        )
    else:
        # few terms are near a request's words, but the plan cannot tell
        near = stats.join(F.broadcast(fuzzy.similar_terms(index, words, edits)), "term")
    ranked = (
        near.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= per_word)
    )
    nearest = F.min("distance").over(Window.partitionBy("word"))
    return (
        ranked.withColumn("nearest", nearest)
        .where(F.col("nearest") > 0)
        .select("word", F.col("term").alias("suggestion"), "distance", "documents")
    )


def suggested_query(suggestions: DataFrame, query: str) -> DataFrame:
    """One row ``suggested``: the query with each unknown word replaced.

    ``suggestions`` has at most one row per word of the query.
    """
    found = suggestions.agg(
        F.map_from_entries(F.collect_list(F.struct("word", "suggestion"))).alias("by_word")
    )
    parts = F.array(*[F.lit(w) for w in m.query_words(query)])
    replaced = F.transform(parts, lambda w: F.coalesce(F.try_element_at("by_word", w), w))
    return found.select(F.array_join(replaced, " ").alias("suggested"))
