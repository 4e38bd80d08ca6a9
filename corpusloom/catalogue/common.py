"""Shared pieces of the query catalogue: table reading and SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import stopwords
from corpusloom.functions import text as tx
from corpusloom.sources.tables import scan


def table(
    spark: SparkSession, sf_dir: str, name: str, key: str | None = None, columns=None
) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", columns, key=key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text columns of ``documents``, ready for CPU-heavy work."""
    return table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"])


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


# --- the token chain in SQL ---------------------------------------------------


# the token pattern without possessive quantifiers, which the SQL side lacks
TOKEN_SQL = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"


def words_sql(text: str) -> str:
    cleaned = f"lower(replace(replace({text}, '_', ' '), '.pdf', ''))"
    return f"regexp_extract_all({cleaned}, '{TOKEN_SQL}')"


def stopword_sql(token: str, lang: str) -> str:
    whens = " ".join(
        f"WHEN {lang} = '{code}' THEN {token} IN {in_list(words)}"
        for code, words in stopwords.DEFAULTS.items()
    )
    return f"CASE {whens} ELSE {token} IN {in_list(stopwords.STANDARD)} END"


# tokens: every token of every document after the language rules
TOKENS = f"""
raw_tokens AS (
  SELECT doc_id, lang, unnest({words_sql('text')}) AS raw
  FROM documents WHERE text IS NOT NULL),
tokens AS (
  SELECT doc_id, lang,
    CASE WHEN lang = 'fr' THEN regexp_replace(raw, {quoted(tx.ELISION)}, '')
         WHEN lang = 'en' THEN regexp_replace(raw, {quoted(tx.POSSESSIVE)}, '')
         ELSE raw END AS token
  FROM raw_tokens)"""

# counts: (doc_id, term, n) under the default index rule
COUNTS = f"""{TOKENS},
kept AS (
  SELECT doc_id, lang, token FROM tokens
  WHERE length(token) BETWEEN 2 AND 255
    AND regexp_matches(token, '{tx.ASCII_LETTER}')
    AND NOT ({stopword_sql('token', 'lang')})),
counts AS (
  SELECT doc_id, token AS term, count(*) AS n FROM kept GROUP BY doc_id, token)"""

STATS = f"""{COUNTS},
stats AS (
  SELECT term, count(*) AS documents, sum(n)::BIGINT AS "count" FROM counts GROUP BY term)"""

VOCABULARY = f"""{STATS},
vocab AS (
  SELECT * FROM (SELECT * FROM stats ORDER BY "count" DESC, term LIMIT 6000)
  WHERE "count" >= 10)"""

TFIDF = f"""{VOCABULARY},
lengths AS (SELECT doc_id, count(*) AS distinct_terms FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS total_docs FROM lengths),
scores AS (
  SELECT c.doc_id, c.term, c.n::DOUBLE / l.distinct_terms AS tf,
         log10(t.total_docs::DOUBLE / v.documents) AS idf,
         (c.n::DOUBLE / l.distinct_terms) * log10(t.total_docs::DOUBLE / v.documents) AS tfidf
  FROM counts c JOIN vocab v USING (term) JOIN lengths l USING (doc_id) CROSS JOIN total t)"""
