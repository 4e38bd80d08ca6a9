"""The named queries of these operators over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    chat, decontaminate, embedding_dedup, line_dedup, minhash, pii, runs, sentencepiece_codec, substring_dedup,
    token_counts, topk, toxicity, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.examples(turns.union(probe)))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), piece_model(), decoded=True)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    remainder = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3")
    return scored.select(
        "doc_id",
        F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated(_table(spark, sf_dir, "documents"))
    return found.withColumn("partners", F.array_join(F.col("partners").cast("array<string>"), ","))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), piece_model())
    return counted.select("*", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(pii.BASE)
    ]
    return found.select("doc_id", *counts, F.sha2(pii.told("base"), 256).alias("base_sha256"), pii.told("spans").alias("spans"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    clean = line_dedup.remove_boilerplate(docs, count="n_removed")
    return clean.select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in a tenth of the documents, told by the id's checksum, the words
    from some place on repeat with some period."""
    told = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", told.alias("h"), F.when(told % 10 == 0, words).alias("w"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.expr("g % greatest(n, 1)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    ))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs are in order, so an equal one further on does not take the place
    best = F.reduce("runs", none, lambda kept, x: F.when(
        kept.isNull() | (x["length"] * kept["period"] > kept["length"] * x["period"]), x
    ).otherwise(kept))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.whole_entries(_table(spark, sf_dir, "embeddings")), k=16)


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_chat": op2_chat,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_top_k": op6_top_k,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_whitening": op13_whitening,
}

# words between the six white-space characters, with only A-Z lower-cased
WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
)

SHINGLES_SQL = f"""
worded AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM worded)"""

ORACLES = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE {SHINGLES_SQL},
sets AS (SELECT doc_id, list_sort(s) AS s, len(s) AS n FROM shingled),
reps AS (SELECT s, n, min(doc_id) AS rid FROM sets WHERE n > 0 GROUP BY s, n),
entries AS (SELECT rid, n, unnest(s) AS g FROM reps),
counted AS (SELECT g FROM entries GROUP BY g HAVING count(*) > 1),
shared AS (SELECT rid, n, g FROM entries SEMI JOIN counted USING (g)),
pairs AS (
  SELECT x.rid AS a, y.rid AS b FROM shared x JOIN shared y ON x.g = y.g AND x.rid < y.rid
  GROUP BY x.rid, y.rid, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT DISTINCT a AS node, a AS root FROM links
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, d.n::BIGINT AS n_shingles,
       coalesce(c.root, r.rid, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.root, r.rid, d.doc_id) AS kept
FROM sets d LEFT JOIN reps r ON r.s = d.s LEFT JOIN classes c ON c.node = r.rid
""",
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
spread AS (
  SELECT bare, min(doc_id) AS first_doc FROM lines WHERE bare <> ''
  GROUP BY bare HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT l.doc_id, l.i, l.line, s.first_doc IS NULL OR s.first_doc = l.doc_id AS stays
  FROM lines l LEFT JOIN spread s USING (bare)),
texts AS (
  SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text
  FROM kept GROUP BY doc_id)
SELECT doc_id, n_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM texts
""",
    "op10_decontaminate": r"""
WITH worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
grams AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0),
doc_grams AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM grams),
item_grams AS (
  SELECT item_id, len(w) AS m, array_to_string(w[j:j+4], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM items WHERE len(w) > 0)),
item_counts AS (SELECT item_id, m, g, count(*) AS c FROM item_grams GROUP BY ALL),
-- every window that starts near a shared shingle
hits AS (SELECT DISTINCT d.doc_id, t.item_id, t.m, d.i FROM doc_grams d JOIN item_counts t USING (g)),
starts AS (
  SELECT DISTINCT doc_id, item_id, m, unnest(range(greatest(i - m, 1), i + 1)) AS s FROM hits),
inside AS (
  SELECT s.doc_id, s.item_id, s.m, s.s, d.g, count(*) AS c
  FROM starts s JOIN doc_grams d ON d.doc_id = s.doc_id AND d.i BETWEEN s.s AND s.s + greatest(s.m - 4, 1) - 1
  GROUP BY ALL),
shared AS (
  SELECT x.doc_id, x.item_id, x.m, x.s, sum(x.c) AS all_n, sum(least(x.c, coalesce(t.c, 0))) AS common
  FROM inside x LEFT JOIN item_counts t ON t.item_id = x.item_id AND t.g = x.g GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, common::DOUBLE / (all_n + greatest(m - 4, 1) - common) AS similarity FROM shared)
SELECT doc_id, item_id, max(similarity) AS similarity FROM scored
WHERE similarity >= 0.8 GROUP BY doc_id, item_id
""",
    "op2_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    -- 32 characters of template, and one more for every control string
    32 + length(role) + length(text)
      + len(regexp_extract_all(role, c)) + len(regexp_extract_all(text, c)) AS chars
  FROM turns, (SELECT '[<\[]␛*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|unk>|pad>|<SYS>>|</SYS>>|/?INST\])' AS c)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
grown AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized),
texts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS told,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
    (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars,
    count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
  FROM grown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, n_examples
FROM texts
""",
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_periodic_runs": r"""
WITH table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
told AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS h
  FROM documents, table_of),
sized AS (
  SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM told),
dealt AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
worded AS (
  SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM dealt),
words AS (SELECT k, n, unnest(w) AS x, unnest(range(n)) AS i FROM worded),
threes AS (SELECT k, n, i, x, lead(x) OVER v AS y, lead(x, 2) OVER v AS z FROM words WINDOW v AS (PARTITION BY k ORDER BY i)),
same AS (
  SELECT l.k, l.i, r.i - l.i AS q FROM threes l JOIN threes r
  ON l.k = r.k AND l.x = r.x AND l.y = r.y AND l.z = r.z AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
islands AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM same),
stretches AS (
  SELECT k, min(i) AS start, count(*) + 2 + q AS length, q FROM islands GROUP BY k, q, island
  HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
runs AS (SELECT k, start, length, min(q) AS period FROM stretches GROUP BY k, start, length),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (k, i) GROUP BY k),
listed AS (
  SELECT k, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told
  FROM runs GROUP BY k),
-- fractions of numbers below 2**26 that differ also differ as doubles
best AS (
  SELECT k, start, length, period, row_number() OVER (
    PARTITION BY k ORDER BY length::DOUBLE / period DESC, start, period) AS rank FROM runs)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
  period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM worded LEFT JOIN listed USING (k) LEFT JOIN (SELECT * FROM best WHERE rank = 1) USING (k) LEFT JOIN kept USING (k)
""",
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.v, y.v) >= 0.9 * sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))),
reach AS (SELECT a AS node, b AS root FROM pairs UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id,
       vec_id <= coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN roots ON node = vec_id
""",
}
