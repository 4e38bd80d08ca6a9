"""Word counts per document and over the corpus, vocabulary and TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.functions.rows import expand
from corpusloom.functions.shingles import shingle_counter
from corpusloom.functions.stems import stem as suffix_stem
from corpusloom.session import small_side, stage

TokenRule = Callable[[Column], Callable[[Column], Column]]

# Bounds of the vocabulary: entries looked at, and the least corpus count kept.
VOCABULARY_SIZE = 6000
MIN_COUNT = 10


def doc_terms(
    docs: DataFrame,
    rule: TokenRule | None = tx.index_rule,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
) -> DataFrame:
    """One row per document: ``doc_id, terms``.

    ``terms`` is empty for a document without kept words; every operator below
    expands it, which drops that document. No filter is placed here: pushed
    below the projection it would make every document be tokenised twice.

    ``rule`` takes the language column and returns a test on one token; ``lang``
    may be a column name or ``None`` for the language-neutral chain.
    """
    lang_col = F.col(lang) if lang else None
    keep = rule(lang_col if lang_col is not None else F.lit(None).cast("string")) if rule else None
    return docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), tx.term_counts(F.col(text), lang_col, keep).alias("terms")
    )


def shared(terms: DataFrame) -> DataFrame:
    """Write the counted documents once, for plans that use them twice.

    Both uses then read the written table instead of tokenising every text again.
    """
    return stage(terms, "terms")


def term_entries(terms: DataFrame) -> DataFrame:
    """``(doc_id, distinct_terms, term, n)``; the size is taken before the
    expansion so that the array itself is not copied to every row."""
    sized = terms.select("doc_id", F.size("terms").alias("distinct_terms"), "terms")
    return expand(sized, "terms", "doc_id", "distinct_terms")


def word_count_by_doc(terms: DataFrame) -> DataFrame:
    """``(doc_id, term, n)`` from :func:`doc_terms`; no shuffle."""
    return expand(terms, "terms", "doc_id")


def drop_stopwords(tokens: DataFrame, words: DataFrame, token: str = "term") -> DataFrame:
    """Remove listed words; ``words`` is a ``(lang, word)`` table.

    No broadcast hint: adaptive execution broadcasts the list when its size
    allows and shuffles otherwise.
    """
    same = (tokens["lang"] == words["lang"]) & (tokens[token] == words["word"])
    return tokens.join(words, same, "left_anti")


def stem_counts(
    counts: DataFrame,
    stems: DataFrame | None = None,
    rule: Callable[[Column, Column], Column] = suffix_stem,
) -> DataFrame:
    """``(lang, term, documents, count)`` rows with their ``stem``.

    Stems are computed on the vocabulary, once per distinct term, by ``rule`` (suffix
    stages; ``text.light_stem`` takes plurals only). ``stems`` is an optional
    ``(lang, term, stem)`` table instead; a term it lacks is its own stem.
    """
    if stems is None:
        return counts.withColumn("stem", rule(F.col("term"), F.col("lang")))
    looked_up = counts.join(stems, ["lang", "term"], "left")
    return looked_up.withColumn("stem", F.coalesce("stem", "term"))


def corpus_word_stats(counts: DataFrame, documents: str | None = None) -> DataFrame:
    """``(term, documents, count)`` from ``(doc_id, term, n)`` rows.

    Each (document, term) pair is one row, so ``documents`` needs no distinct;
    a hot term is folded map-side before the shuffle. Rows that stand for several
    documents (:func:`shingle_counts`) have their number in the column ``documents``.
    """
    seen = F.sum(documents) if documents else F.count(F.lit(1))
    return counts.groupBy("term").agg(seen.alias("documents"), F.sum("n").alias("count"))


def shingle_counts(tokens: DataFrame, column: str = "tokens", low: int = 1, high: int = 3) -> DataFrame:
    """``(term, documents, n)``: the shingles of :func:`text.shingles`, counted in Arrow batches.

    Each row of ``tokens`` is a document. Shingles are told apart as numbers, and their strings
    are made once a block of documents, not once a document; a term comes once a block, so the
    rows are to be added up. They are dealt by term before that: most shingles are rare, folding
    them again where they are made saves next to nothing, and a hot one has a row a block.
    """
    counted = tokens.select(column).mapInArrow(shingle_counter(low, high), "term string, documents long, n long")
    return counted.repartition("term")


def upper_keys(counts: DataFrame, *group: str) -> DataFrame:
    """Counts under upper-case keys, for exports that want them.

    The working key is lower-case; terms that only differ before upper-casing
    (``ß`` and ``ss``) are added up here.
    """
    return counts.groupBy(*group, F.upper("term").alias("term")).agg(F.sum("n").alias("n"))


def tfidf_wide(scores: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One column per listed term, 0 where a document lacks it.

    The terms are given, so no pass is spent on finding them; for a whole
    vocabulary use :func:`dense_lines`, whose width costs no columns. As many
    columns as ``spark.sql.pivotMaxValues`` allows.
    """
    most = int(scores.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if len(terms) > most:
        raise ValueError(f"{len(terms)} columns; spark.sql.pivotMaxValues is {most}")
    wide = scores.groupBy("doc_id").pivot("term", list(terms)).agg(F.first("tfidf"))
    return wide.na.fill(0.0)


def total_docs(terms: DataFrame, mode: str = "exact") -> DataFrame:
    """One row ``total_docs``: documents that have at least one term.

    ``mode="2n_plus_1"`` reproduces a counter that steps twice per document and
    once more when the input ends.
    """
    n = F.count_if(F.size("terms") > 0)
    if mode == "2n_plus_1":
        n = n * 2 + 1
    elif mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    return terms.agg(n.alias("total_docs"))


def vocabulary(
    stats: DataFrame, size: int = VOCABULARY_SIZE, min_count: int = MIN_COUNT
) -> DataFrame:
    """The first ``size`` words by corpus count, of those the ones counted at
    least ``min_count`` times. Equal counts are ordered by term."""
    first = stats.orderBy(F.desc("count"), F.asc("term")).limit(size)
    return first.where(F.col("count") >= min_count)


def vocabulary_with_total(
    terms: DataFrame, size: int = VOCABULARY_SIZE, min_count: int = MIN_COUNT
) -> DataFrame:
    """:func:`vocabulary` with ``total_docs`` on every row, in one pass.

    Every document adds one null-term entry, so the null group counts the
    documents in the same aggregation that counts the words. It has the smallest
    null-first sort key and thus survives the top-``size + 1`` selection; the
    final window sees at most that many rows.
    """
    marker = F.array(
        F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"))
    )
    marked = F.when(F.size("terms") > 0, F.concat(marker, "terms"))
    entries = expand(terms.select(marked.alias("marked")), "marked")
    first = (
        corpus_word_stats(entries)
        .orderBy(F.col("term").isNotNull(), F.desc("count"), F.asc("term"))
        .limit(size + 1)
    )
    whole = Window.partitionBy(F.lit(1))
    total = F.max(F.when(F.col("term").isNull(), F.col("documents"))).over(whole)
    return first.withColumn("total_docs", total).where(
        F.col("term").isNotNull() & (F.col("count") >= min_count)
    )


def tfidf(
    terms: DataFrame,
    vocab: DataFrame,
    compat_float: bool = False,
    total_docs_mode: str = "exact",
) -> DataFrame:
    """Sparse TF-IDF ``(doc_id, term, tf, idf, tfidf)``.

    ``tf`` divides by the number of distinct terms of the document (counted
    before the vocabulary cut), ``idf`` is ``log10(total_docs / documents)``.
    ``vocab`` comes from :func:`vocabulary_with_total`, whose limit keeps it small
    enough to broadcast; a larger table of the same shape is joined by shuffle.
    """
    entries = term_entries(terms)
    total = F.col("total_docs")
    if total_docs_mode == "2n_plus_1":
        total = total * 2 + 1
    scored = entries.join(small_side(vocab), "term").select(
        "doc_id",
        "term",
        (F.col("n") / F.col("distinct_terms")).alias("tf"),
        F.log10(total / F.col("documents")).alias("idf"),
    )
    scored = scored.withColumn("tfidf", F.col("tf") * F.col("idf"))
    if compat_float:
        scored = scored.select(
            "doc_id", "term", *[F.col(c).cast("float").alias(c) for c in ("tf", "idf", "tfidf")]
        )
    return scored


def top_terms(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best terms per document with their ``rank``.

    A document's rows sit in one task when they come from :func:`tfidf`, so the
    group limit before the shuffle leaves ``n`` rows per document.
    """
    best = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), F.asc("term"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def idf_natural(counts: DataFrame, total: DataFrame) -> DataFrame:
    """Smoothed natural-log idf, ``ln((m + 1) / (df + 1))``, per term."""
    m = total.select(F.col("total_docs")).scalar()
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("documents"))
        .withColumn("idf", F.log((m + 1) / (F.col("documents") + 1)))
    )


def dense_lines(terms: DataFrame, vocab: DataFrame, sep: str = "\t", digits: int | None = None) -> DataFrame:
    """One text line per document, a cell for every vocabulary word.

    Cells hold the whole number, or ``digits`` decimals of it.

    The cells stay sparse until the text is built: each entry carries its column
    number, and runs of empty cells are written with ``repeat``. Documents
    without any vocabulary word get a line of zeros. A line holds at most as many
    entries as the vocabulary is allowed to have.
    """
    numbered = vocab.select(
        "term",
        "documents",
        "total_docs",
        F.row_number()
        .over(Window.partitionBy(F.lit(1)).orderBy(F.desc("count"), F.asc("term")))
        .alias("column"),
    )
    width = numbered.agg(F.count(F.lit(1)).alias("width")).scalar()
    entries = term_entries(terms)
    value = (
        F.col("n") / F.col("distinct_terms") * F.log10(F.col("total_docs") / F.col("documents"))
    )
    shown = value.cast("string") if digits is None else F.format_string(f"%.{digits}f", value)
    cells = (
        entries.join(small_side(numbered), "term", "left")
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("column").isNotNull(),
                        F.struct("column", shown.alias("cell")),
                    )
                )
            ).alias("cells")
        )
    )
    zero = "0.0" if digits is None else f"{0:.{digits}f}"

    def piece(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get("cells", i - 1)["column"], F.lit(0))
        return F.concat(F.repeat(F.lit(sep + zero), entry["column"] - before - 1), F.lit(sep), entry["cell"])

    last = F.coalesce(F.get("cells", F.size("cells") - 1)["column"], F.lit(0))
    tail = F.repeat(F.lit(sep + zero), (F.col("width") - last).cast("int"))
    return (
        cells.withColumn("width", width)
        .withColumn("body", F.concat(F.array_join(F.transform("cells", piece), ""), tail))
        .select("doc_id", F.concat(F.col("doc_id").cast("string"), "body").alias("line"))
    )


def header_line(vocab: DataFrame, key: str = "path", sep: str = "\t") -> DataFrame:
    """The header that goes with :func:`dense_lines`, as a one-row table."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("rank"), "term")))
    words = F.transform(ordered, lambda e: e["term"])
    return vocab.agg(F.concat_ws(sep, F.lit(key), words).alias("line"))
