"""Fuzzy words through a table of deletion variants.

Two words within ``k`` edits have a common string that either reaches by at most ``k``
deletions, also when only their first ``PREFIX`` characters are looked at. A vocabulary's
variants are therefore met by an equality join; the edit distance is asked only of the few
words that share one, and never of the tokens of documents, which are found by their terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.match import allowed_edits
from corpusloom.functions.rows import expand, literal_rows
from corpusloom.functions.text import let
from corpusloom.session import small_side

#: characters of a word that variants are made of; at most 37 variants for two edits
PREFIX = 8
MOST_EDITS = 2


def _shorter(word: Column) -> Column:
    """Every string that lacks one character of ``word``."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))
    )
    return F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))


def variants(word: Column, edits: int = MOST_EDITS) -> Column:
    """The distinct strings left of the first ``PREFIX`` characters of ``word`` after
    deleting at most ``edits`` (0 to 2) of them; null for null."""
    if not 0 <= edits <= MOST_EDITS:
        raise ValueError(f"edits must be 0 to {MOST_EDITS}")

    def widened(head: Column) -> Column:
        if edits == 0:
            return F.array(head)
        if edits == 1:
            return F.array_distinct(F.concat(F.array(head), _shorter(head)))
        return let(
            F.array_distinct(_shorter(head)),
            lambda one: F.array_distinct(F.concat(F.array(head), one, F.flatten(F.transform(one, _shorter)))),
        )

    return F.when(word.isNotNull(), let(word.substr(1, PREFIX), widened))


def variant_index(
    vocabulary: DataFrame, edits: int = MOST_EDITS, words: Sequence[str] | None = None
) -> DataFrame:
    """``(variant, term)`` rows of a vocabulary with one row per ``term``.

    Write it, bucketed or sorted by ``variant``, where many requests come; the vocabulary is
    far smaller than its documents. With ``words`` only terms of a length that these may reach
    are taken, for an index that serves a single request.
    """
    terms = vocabulary.select("term").where(F.col("term").isNotNull())
    if words is not None:
        sizes = [len(w) for w in words] or [0]
        terms = terms.where(F.length("term").between(min(sizes) - edits, max(sizes) + edits))
    return terms.select(F.explode(variants(F.col("term"), edits)).alias("variant"), "term")


def similar_terms(index: DataFrame, words: Sequence[str], edits: int | None = None) -> DataFrame:
    """``(word, term, distance)``: the terms of an index within ``edits`` of each word, or
    within the distance its length allows (0, 1 or 2). Words are lower-cased, repeated ones
    count once, and no word gives no rows."""
    limits = {w.lower(): allowed_edits(w) if edits is None else edits for w in words}
    spark = index.sparkSession
    asked = literal_rows(spark, list(limits.items()), "word: string, most: int")
    every = [
        asked.where(F.col("most") == n).select("word", "most", F.explode(variants(F.col("word"), n)).alias("variant"))
        for n in sorted(set(limits.values())) or [0]
    ]
    met = every[0]
    for other in every[1:]:
        met = met.union(other)
    pairs = index.join(small_side(met), "variant").select("word", "term", "most").distinct()
    distance = F.levenshtein(F.col("term"), F.col("word"))
    return pairs.select("word", "term", distance.alias("distance"), "most").where("distance <= most").drop("most")


def with_similar_words(
    postings: DataFrame, near: DataFrame, n_words: int = 1, key: str = "doc_id", terms: str = "terms"
) -> DataFrame:
    """Rows of ``postings`` that hold a term near at least ``n_words`` different words.

    ``terms`` are the row's distinct words with their counts (see ``words.doc_terms``) and
    ``near`` comes from :func:`similar_terms`; ``n_words=1`` joins the words by OR, their
    number by AND. Only matching terms leave a task. Rows that repeat a key are found
    together; rows without one are not found.
    """
    entries = expand(postings.select(key, terms), terms, key)
    hits = entries.join(small_side(near.select("term", "word")), "term").groupBy(key, "word").agg(F.lit(1).alias("one"))
    found = hits.groupBy(key).agg(F.count("*").alias("found")).where(F.col("found") >= n_words)
    return postings.join(found.select(key), key, "left_semi")
