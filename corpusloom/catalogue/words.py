"""Queries over the words of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.catalogue import stems_sql
from corpusloom.functions import stems, stopwords
from corpusloom.functions import text as tx
from corpusloom.functions.rows import expand
from corpusloom.operators import words as ops


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.doc_terms(c.documents(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ops.shared(_terms(spark, sf_dir))
    return ops.tfidf(terms, ops.vocabulary_with_total(terms))


def tfidf_top(spark, sf_dir):
    return ops.top_terms(_scores(spark, sf_dir), 10).select(
        "doc_id", "term", F.col("rank").cast("bigint").alias("rank"), F.round("tfidf", 6).alias("tfidf")
    )


def tfidf_sparse(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "doc_id", "term", *[F.round(x, 6).alias(x) for x in ("tf", "idf", "tfidf")]
    )


def tfidf_dense(spark, sf_dir):
    terms = ops.shared(_terms(spark, sf_dir))
    lines = ops.dense_lines(terms, ops.vocabulary_with_total(terms), digits=6)
    tabs = F.length("line") - F.length(F.replace("line", F.lit("\t"), F.lit("")))
    return lines.select("doc_id", (tabs + 1).cast("bigint").alias("cells"), F.md5("line").alias("digest"))


def tokenise_documents(spark, sf_dir):
    tokens = tx.tokenise(F.col("text"), F.col("lang"))
    return c.documents(spark, sf_dir).select("doc_id", "lang", tokens.alias("tokens")).select(
        "doc_id",
        "lang",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


def _term_totals(docs: DataFrame, rule) -> DataFrame:
    counts = tx.term_counts(F.col("text"), F.col("lang"), rule(F.col("lang")) if rule else None)
    return (
        expand(docs.select("lang", counts.alias("terms")), "terms", "lang")
        .groupBy("lang", "term")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("count"))
    )


def tokens_by_lang(spark, sf_dir):
    return _term_totals(c.documents(spark, sf_dir), None)


def stopwords_removed(spark, sf_dir):
    return _term_totals(c.documents(spark, sf_dir), tx.not_stopword)


def stopword_table(spark, sf_dir):
    totals = _term_totals(c.documents(spark, sf_dir), None)
    rows = [(lang, w) for lang, words in stopwords.DEFAULTS.items() for w in words]
    listed = spark.createDataFrame(rows, "lang string, word string")
    return ops.drop_stopwords(totals, listed)


def _by_stem(stemmed):
    return (
        stemmed
        .groupBy("lang", "stem")
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("count").alias("count"))
    )


def stem_vocab(spark, sf_dir):
    return _by_stem(ops.stem_counts(_term_totals(c.documents(spark, sf_dir), tx.index_rule)))


def stem_plurals(spark, sf_dir):
    totals = _term_totals(c.documents(spark, sf_dir), tx.index_rule)
    return _by_stem(ops.stem_counts(totals, rule=tx.light_stem))


def stem_terms(spark, sf_dir):
    """The stem of every word of the corpus under the rules of both languages."""
    stats = ops.corpus_word_stats(ops.word_count_by_doc(ops.doc_terms(c.documents(spark, sf_dir), None)))
    return stats.select("term", stems.english(F.col("term")).alias("en"), stems.french(F.col("term")).alias("fr"))


def surface_words(spark, sf_dir):
    return _term_totals(c.documents(spark, sf_dir), tx.index_rule)


def shingle_stats(spark, sf_dir):
    tokens = tx.tokenise(F.col("text"), F.col("lang"))
    grams = ops.shingle_counts(c.documents(spark, sf_dir).select(tokens.alias("tokens")))
    return ops.corpus_word_stats(grams, "documents")


def token_filters(spark, sf_dir):
    rules = {
        "ascii_letter": tx.has_ascii_letter,
        "length_2_255": tx.length_between(),
        "not_a_number": tx.not_a_number,
        "whole_match": tx.whole_match("[a-z]+"),
    }
    counts = tx.term_counts(F.col("text"), F.col("lang"))
    kept = F.array(
        *[F.struct(F.lit(name).alias("rule"), rule(F.col("term")).alias("keep")) for name, rule in rules.items()]
    )
    return (
        expand(c.documents(spark, sf_dir).select(counts.alias("terms")), "terms")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .select("n", F.explode(kept).alias("r"))
        .where("r.keep")
        .groupBy("r.rule")
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("tokens"))
    )


def word_count_by_doc(spark, sf_dir):
    return ops.word_count_by_doc(_terms(spark, sf_dir))


def word_count_digits_rule(spark, sf_dir):
    terms = ops.doc_terms(c.documents(spark, sf_dir), lambda lang: tx.every(tx.not_a_number, tx.not_stopword(lang)))
    return ops.corpus_word_stats(ops.word_count_by_doc(terms))


def corpus_stats(spark, sf_dir):
    return ops.corpus_word_stats(ops.word_count_by_doc(_terms(spark, sf_dir)))


def upper_case_counts(spark, sf_dir):
    return ops.upper_keys(ops.word_count_by_doc(_terms(spark, sf_dir)))


WIDE_TERMS = ["nicht", "una", "mit", "los", "thin"]


def tfidf_wide(spark, sf_dir):
    wide = ops.tfidf_wide(_scores(spark, sf_dir), WIDE_TERMS)
    return wide.select("doc_id", *[F.round(t, 6).alias(t) for t in WIDE_TERMS])


def total_docs(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    exact = ops.total_docs(terms)
    return exact.select(
        "total_docs", (F.col("total_docs") * 2 + 1).alias("total_docs_2n_plus_1")
    )


def vocabulary(spark, sf_dir):
    return ops.vocabulary(corpus_stats(spark, sf_dir))


def idf_natural(spark, sf_dir):
    terms = ops.shared(_terms(spark, sf_dir))
    idf = ops.idf_natural(ops.word_count_by_doc(terms), ops.total_docs(terms))
    return idf.withColumn("idf", F.round("idf", 6))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_top, tfidf_sparse, tfidf_dense, tokenise_documents, tokens_by_lang,
        stopwords_removed, stopword_table, stem_vocab, stem_plurals, stem_terms, surface_words, shingle_stats,
        token_filters, word_count_by_doc, word_count_digits_rule, corpus_stats,
        total_docs, vocabulary, idf_natural, upper_case_counts, tfidf_wide,
    )
}

_TOTALS = """SELECT lang, term, count(*) AS documents, sum(n)::BIGINT AS "count"
FROM (SELECT doc_id, lang, token AS term, count(*) AS n FROM {source} GROUP BY ALL)
GROUP BY lang, term"""

_STEM = """CASE
  WHEN lang = 'en' THEN CASE
    WHEN regexp_matches(term, 'ies$') AND NOT regexp_matches(term, '[ea]ies$') THEN regexp_replace(term, 'ies$', 'y')
    WHEN regexp_matches(term, 'es$') AND NOT regexp_matches(term, '[aeo]es$') THEN regexp_replace(term, 'es$', 'e')
    WHEN regexp_matches(term, 's$') AND NOT regexp_matches(term, '[us]s$') THEN regexp_replace(term, 's$', '')
    ELSE term END
  WHEN lang = 'fr' THEN CASE
    WHEN regexp_matches(term, 'eaux$') THEN regexp_replace(term, 'x$', '')
    WHEN regexp_matches(term, '[^s]s$') AND length(term) > 3 THEN regexp_replace(term, 's$', '')
    ELSE term END
  ELSE term END"""

ORACLES = {
    "tfidf_top": f"""WITH {c.TFIDF},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM scores)
SELECT doc_id, term, rank, round(tfidf, 6) AS tfidf FROM ranked WHERE rank <= 10""",
    "tfidf_sparse": f"""WITH {c.TFIDF}
SELECT doc_id, term, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM scores""",
    "tfidf_dense": f"""WITH {c.TFIDF},
numbered AS (SELECT term, row_number() OVER (ORDER BY "count" DESC, term) AS col FROM vocab),
cells AS (
  SELECT l.doc_id, v.col, coalesce(s.tfidf, 0.0) AS tfidf
  FROM lengths l CROSS JOIN numbered v
  LEFT JOIN scores s ON s.doc_id = l.doc_id AND s.term = v.term),
lines AS (
  SELECT doc_id, count(*) + 1 AS cells,
         doc_id::VARCHAR || chr(9) || string_agg(printf('%.6f', tfidf), chr(9) ORDER BY col) AS line
  FROM cells GROUP BY doc_id)
SELECT doc_id, cells, md5(line) AS digest FROM lines""",
    "tokenise_documents": f"""WITH cut AS (
  SELECT doc_id, lang, {c.words_sql('text')} AS ws FROM documents WHERE text IS NOT NULL),
elided AS (
  SELECT doc_id, lang, [CASE
    WHEN lang = 'fr' THEN regexp_replace(w, {c.quoted(tx.ELISION)}, '')
    WHEN lang = 'en' THEN regexp_replace(w, {c.quoted(tx.POSSESSIVE)}, '') ELSE w END FOR w IN ws] AS ws FROM cut)
SELECT doc_id, lang, len(ws)::BIGINT AS n_tokens, md5(array_to_string(ws, ' ')) AS digest FROM elided""",
    "tokens_by_lang": f"WITH {c.TOKENS} {_TOTALS.format(source='tokens')}",
    "stopwords_removed": f"""WITH {c.TOKENS},
free AS (SELECT * FROM tokens WHERE NOT ({c.stopword_sql('token', 'lang')}))
{_TOTALS.format(source='free')}""",
    "stopword_table": f"""WITH {c.TOKENS},
free AS (SELECT * FROM tokens WHERE NOT (
  (lang = 'en' AND token IN {c.in_list(stopwords.ENGLISH)}) OR
  (lang = 'fr' AND token IN {c.in_list(stopwords.FRENCH)})))
{_TOTALS.format(source='free')}""",
    "stem_plurals": f"""WITH {c.COUNTS},
totals AS ({_TOTALS.format(source='kept')}),
stemmed AS (SELECT lang, {_STEM} AS stem, "count" FROM totals)
SELECT lang, stem, count(*) AS terms, sum("count")::BIGINT AS "count" FROM stemmed GROUP BY lang, stem""",
    "stem_vocab": f"""WITH {c.COUNTS},
totals AS ({_TOTALS.format(source='kept')}),
words AS (SELECT DISTINCT term FROM totals),
{stems_sql.STAGES},
stemmed AS (
  SELECT lang, CASE lang WHEN 'en' THEN s.en WHEN 'fr' THEN s.fr ELSE term END AS stem, "count"
  FROM totals JOIN stems s USING (term))
SELECT lang, stem, count(*) AS terms, sum("count")::BIGINT AS "count" FROM stemmed GROUP BY lang, stem""",
    "stem_terms": f"""WITH {c.TOKENS}, words AS (SELECT DISTINCT token AS term FROM tokens),
{stems_sql.STAGES} SELECT term, en, fr FROM stems""",
    "surface_words": f"WITH {c.COUNTS} {_TOTALS.format(source='kept')}",
    "shingle_stats": f"""WITH numbered AS (
  SELECT doc_id, lang, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, lang, {c.words_sql('text')} AS ws FROM documents WHERE text IS NOT NULL)),
elided AS (
  SELECT doc_id, pos, CASE
    WHEN lang = 'fr' THEN regexp_replace(raw, {c.quoted(tx.ELISION)}, '')
    WHEN lang = 'en' THEN regexp_replace(raw, {c.quoted(tx.POSSESSIVE)}, '') ELSE raw END AS t FROM numbered),
led AS (
  SELECT doc_id, t, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3
  FROM elided WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (
  SELECT doc_id, t AS term FROM led
  UNION ALL SELECT doc_id, t || ' ' || t2 FROM led WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, t || ' ' || t2 || ' ' || t3 FROM led WHERE t3 IS NOT NULL)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS "count"
FROM grams GROUP BY term""",
    "token_filters": f"""WITH {c.TOKENS},
totals AS (SELECT token, count(*) AS n FROM tokens GROUP BY token),
tagged AS (
  SELECT n, unnest([
    CASE WHEN regexp_matches(token, '[A-Za-z]') THEN 'ascii_letter' END,
    CASE WHEN length(token) BETWEEN 2 AND 255 THEN 'length_2_255' END,
    CASE WHEN NOT regexp_matches(token, '^[0-9]+$') AND length(token) >= 2 THEN 'not_a_number' END,
    CASE WHEN regexp_matches(token, '^(?:[a-z]+)$') THEN 'whole_match' END]) AS rule FROM totals)
SELECT rule, count(*) AS terms, sum(n)::BIGINT AS tokens FROM tagged WHERE rule IS NOT NULL GROUP BY rule""",
    "word_count_by_doc": f"WITH {c.COUNTS} SELECT doc_id, term, n FROM counts",
    "word_count_digits_rule": f"""WITH {c.TOKENS},
kept AS (
  SELECT doc_id, token FROM tokens
  WHERE NOT regexp_matches(token, '^[0-9]+$') AND length(token) >= 2
    AND NOT ({c.stopword_sql('token', 'lang')}))
SELECT token AS term, count(DISTINCT doc_id) AS documents, count(*) AS "count" FROM kept GROUP BY token""",
    "corpus_stats": f"""WITH {c.STATS} SELECT term, documents, "count" FROM stats""",
    "upper_case_counts": f"""WITH {c.COUNTS}
SELECT replace(upper(term), 'ẞ', 'SS') AS term, sum(n)::BIGINT AS n FROM counts GROUP BY 1""",
    "tfidf_wide": f"""WITH {c.TFIDF}
SELECT doc_id, {', '.join(f"coalesce(max(round(tfidf, 6)) FILTER (WHERE term = '{t}'), 0.0) AS {t}" for t in WIDE_TERMS)}
FROM scores GROUP BY doc_id""",
    "total_docs": f"""WITH {c.COUNTS}
SELECT count(DISTINCT doc_id) AS total_docs, 2 * count(DISTINCT doc_id) + 1 AS total_docs_2n_plus_1 FROM counts""",
    "vocabulary": f"""WITH {c.VOCABULARY} SELECT term, documents, "count" FROM vocab""",
    "idf_natural": f"""WITH {c.STATS},
m AS (SELECT count(DISTINCT doc_id) AS m FROM counts)
SELECT term, documents, round(ln((m + 1)::DOUBLE / (documents + 1)), 6) AS idf FROM stats CROSS JOIN m""",
}
