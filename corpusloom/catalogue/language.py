"""Language profiles and detection over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.operators import language as lg

LANGUAGES = ("de", "en", "es", "fr")


def lang_profiles(spark, sf_dir):
    return lg.language_profiles(c.documents(spark, sf_dir))


def lang_detect(spark, sf_dir):
    docs = c.documents(spark, sf_dir)
    found = lg.detect_language(docs, lg.language_profiles(docs), LANGUAGES)
    return found.withColumn("score", F.round("score", 6))


def lang_detect_row(spark, sf_dir):
    docs = c.documents(spark, sf_dir)
    found = lg.detect_in_row(docs, lg.hashed_profiles(docs), LANGUAGES)
    return found.withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (lang_profiles, lang_detect, lang_detect_row)}

_PROFILES = f"""chars AS (
  SELECT doc_id, lang, regexp_extract_all(
    ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '(?s).') AS l
  FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT doc_id, lang, l[i] || l[i + 1] || l[i + 2] AS gram
  FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) - 1)) AS i FROM chars)),
counts AS (SELECT doc_id, lang, gram, count(*) AS n FROM grams GROUP BY ALL),
summed AS (
  SELECT lang, gram, sum(n)::BIGINT AS n FROM counts WHERE lang IS NOT NULL GROUP BY lang, gram),
profiles AS (
  SELECT lang, gram, n, sum(n) OVER (PARTITION BY lang)::BIGINT AS total FROM summed)"""

_HASHED = f"(unicode(gram[1]) * {lg.FIRST} + unicode(gram[2]) * {lg.SECOND} + unicode(gram[3])) % {lg.BUCKETS}"

ORACLES = {
    "lang_detect_row": f"""WITH {_PROFILES},
places AS (SELECT doc_id, lang, {_HASHED} AS bucket, n FROM counts),
learned AS (SELECT lang, bucket, sum(n) AS n FROM places WHERE lang IN {c.in_list(LANGUAGES)} GROUP BY lang, bucket),
wholes AS (SELECT lang, sum(n) AS total FROM learned GROUP BY lang),
scores AS (
  SELECT p.doc_id, w.lang, sum(p.n * ln((coalesce(l.n, 0) + 1) / (w.total + 1))) / sum(p.n) AS score
  FROM places p CROSS JOIN wholes w LEFT JOIN learned l ON l.lang = w.lang AND l.bucket = p.bucket
  GROUP BY p.doc_id, w.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM scores)
SELECT d.doc_id, b.lang AS detected, round(b.score, 6) AS score
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1 WHERE d.text IS NOT NULL""",
    "lang_profiles": f"WITH {_PROFILES} SELECT lang, gram, n, total FROM profiles",
    "lang_detect": f"""WITH {_PROFILES},
totals AS (SELECT DISTINCT lang, total FROM profiles),
sizes AS (SELECT doc_id, sum(n) AS grams FROM counts GROUP BY doc_id),
hits AS (
  SELECT c.doc_id, p.lang, sum(c.n * ln(p.n + 1)) AS s
  FROM counts c JOIN profiles p USING (gram) GROUP BY c.doc_id, p.lang),
scores AS (
  SELECT z.doc_id, t.lang, coalesce(h.s, 0.0) / z.grams - ln(t.total + 1) AS score
  FROM sizes z CROSS JOIN totals t LEFT JOIN hits h ON h.doc_id = z.doc_id AND h.lang = t.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM scores)
SELECT d.doc_id, b.lang AS detected, round(b.score, 6) AS score
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1 WHERE d.text IS NOT NULL""",
}
