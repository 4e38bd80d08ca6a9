"""Files written and read back, streams against their batch twins."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.catalogue import pages as pg
from corpusloom.catalogue import words as wd
from corpusloom.operators import index as ix
from corpusloom.operators import records as rec
from corpusloom.operators import words as ops
from corpusloom.session import discard, stage, work_path
from corpusloom.sources import files as io
from corpusloom.sources import rolling
from corpusloom.streaming import changing, flows, metrics

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def json_roundtrip(spark, sf_dir):
    path = work_path(spark, "json")
    io.write_json_lines(c.table(spark, sf_dir, "documents"), path)
    back = io.scan_json_lines(spark, path, DOCUMENT)
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"), F.col(io.CORRUPT).alias("bad"))


def json_rolled(spark, sf_dir):
    """Documents in files of at most ``limit`` bytes; ``fits`` looks at the file a row came from."""
    path, limit = work_path(spark, "rolled"), 200_000
    rolling.write_json_rolled(c.table(spark, sf_dir, "documents"), path, limit)
    back = io.scan_json_lines(spark, path, DOCUMENT)
    size, line = F.col("_metadata.file_size"), F.octet_length("text")
    return back.select(
        "doc_id", "lang", "n_chars", F.md5("text").alias("digest"),
        ((size <= limit) | (line > limit / 2)).alias("fits"), F.col(io.CORRUPT).alias("bad"),
    )


def json_bad_lines(spark, sf_dir):
    turns = c.table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "role", "text"))
    # the assistant's lines lose their last character
    cut = F.when(F.col("role") == "assistant", line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    lines = turns.select(F.col("conv_id").alias("id"), "turn", cut.alias("line"))
    parsed = io.parse_json_lines(lines, "line", "conv_id bigint, role string, text string")
    return parsed.select("id", "turn", F.col(io.CORRUPT).isNotNull().alias("bad"))


def _lines(files):
    lines = files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    return lines.where(F.col("line") != "")


def binary_scan(spark, sf_dir):
    path = work_path(spark, "binary")
    io.write_json_lines(c.table(spark, sf_dir, "pages"), path)
    files = io.scan_files(spark, path, ["json"])
    lines = _lines(files)
    return io.parse_json_lines(lines, "line", "page_id bigint, url string").select("page_id", "url")


def tsv_roundtrip(spark, sf_dir):
    terms = ops.shared(ops.doc_terms(c.documents(spark, sf_dir)))
    vocab = ops.vocabulary_with_total(terms)
    path = work_path(spark, "matrix")
    matrix = ops.dense_lines(terms, vocab, digits=6).select("line")
    # a line has a cell for every word of the vocabulary, nearly all of them zero
    io.write_lines(ops.header_line(vocab).unionByName(matrix), path, compression="gzip")
    discard(terms)
    back = io.scan_tsv(spark, path)
    tabs = F.length("cells") - F.length(F.replace("cells", F.lit("\t"), F.lit("")))
    return back.select(
        F.col("path").cast("bigint").alias("doc_id"),
        (tabs + 2).cast("bigint").alias("cells"),
        F.md5(F.concat_ws("\t", "path", "cells")).alias("digest"),
    )


def cluster_column(spark, sf_dir):
    path = work_path(spark, "clusters")
    rows = c.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("position"), F.col("label").cast("string").alias("cluster")
    )
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    back = io.scan_cluster_column(spark, path)
    docs = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "source")
    return ix.join_by_position(docs, back)


def corpus_stats_json(spark, sf_dir):
    terms = ops.shared(ops.doc_terms(c.documents(spark, sf_dir)))
    stats = ops.corpus_word_stats(ops.word_count_by_doc(terms))
    return io.corpus_stats_json(stats, ops.total_docs(terms))


def line_pairs(spark, sf_dir):
    """Two folders of text files, written in another number of parts, joined line by line."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\t", "doc_id", "source").alias("line"))
    vectors = c.table(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws(" ", "label", "vec_id").alias("line"))
    paths = []
    for rows, key, parts in ((docs, "doc_id", 5), (vectors, "vec_id", 3)):
        paths.append(work_path(spark, "lines"))
        rows.repartitionByRange(parts, key).sortWithinPartitions(key).select("line").write.text(paths[-1])
    return io.paired_lines(spark, *paths)


def user_parser(spark, sf_dir):
    def parse(path: str, content: bytes) -> dict:
        html = content.decode("utf-8")
        found = re.search(r"<title>(.*?)</title>", html)
        record = {"content_type": "text/html", "titles": [found.group(1)] if found else []}
        if "</html>" not in html:
            raise ValueError("unterminated document")
        return record

    files = c.table(spark, sf_dir, "pages", "page_id").select(
        F.col("url").alias("path"), F.encode("html", "utf-8").alias("content")
    )
    found = rec.extract_files(files, parse)
    return found.select("path", "file", "content_type", F.get("titles", F.lit(0)).alias("title"), "error")


def batched_writer(spark, sf_dir):
    def send(batch: list[dict]) -> None:
        if len(batch) > io.BATCH_SIZE or any(r["c_custkey"] is None for r in batch):
            raise ValueError("bad batch")

    customers = c.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sent = io.send_batches(customers, send)
    return sent.agg(F.sum("rows").alias("rows"), F.sum("failed").alias("failed"))


# --- streams ------------------------------------------------------------------


def _dropped(spark, sf_dir, frame):
    """Rows as JSON files, and how many files make a third of them."""
    path = work_path(spark, "drops")
    n = max(3, spark.sparkContext.defaultParallelism)
    frame.repartition(n, frame.columns[0]).write.json(path)
    return path, math.ceil(n / 3)


def _doc_stream(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents")
    path, third = _dropped(spark, sf_dir, docs)
    return flows.json_stream(spark, path, DOCUMENT, third)


def stream_word_count(spark, sf_dir):
    out = work_path(spark, "counts")
    flows.append_to(flows.word_counts(_doc_stream(spark, sf_dir)), out, flows.new_checkpoint(spark))
    return spark.read.schema("doc_id bigint, term string, n bigint").parquet(out)


def stream_corpus_stats(spark, sf_dir):
    table = ix.new_index(spark, "term", "term string, documents bigint, count bigint", "stats")
    flows.running_stats(_doc_stream(spark, sf_dir), table, flows.new_checkpoint(spark))
    return table.read()


def stream_changed_stats(spark, sf_dir):
    """Documents that change while they stream in: a draft of each, the real text of those
    with a label, and an old version of all that comes last."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = c.table(spark, sf_dir, "labels").select("doc_id")
    path = work_path(spark, "versions")
    draft = F.concat_ws(" ", F.lit("draft"), F.substring_index("text", " ", 40), F.col("lang"))
    for version, rows in (
        (1, docs.withColumn("text", draft)),
        (2, docs.join(labelled, "doc_id", "left_semi")),
        (0, docs.withColumn("text", F.lit("late words of long ago"))),
    ):
        rows.withColumn("version", F.lit(version)).coalesce(2).write.mode("append").json(path)
    stream = flows.json_stream(spark, path, "doc_id bigint, text string, lang string, version bigint", 3)
    table = ix.new_index(spark, "term", "term string, documents bigint, count bigint", "changing")
    changing.changing_stats(stream, "version", table, flows.new_checkpoint(spark))
    return changing.current_stats(table)


def stream_tfidf(spark, sf_dir):
    terms = stage(ops.doc_terms(c.documents(spark, sf_dir)), "terms")
    vocab_path = work_path(spark, "vocabulary")
    ops.vocabulary_with_total(terms).write.parquet(vocab_path)
    counted = terms.where(F.size("terms") > 0).select(
        F.col("doc_id").alias("path"), F.map_from_entries("terms").alias("count")
    )
    path, third = _dropped(spark, sf_dir, counted)
    records = flows.json_stream(spark, path, "path bigint, count map<string,bigint>", third)
    out = work_path(spark, "tfidf")
    scored = flows.tfidf_of_counts(records, spark.read.parquet(vocab_path))
    flows.append_to(scored, out, flows.new_checkpoint(spark))
    back = spark.read.schema("doc_id bigint, term string, tfidf double").parquet(out)
    return back.withColumn("tfidf", F.round("tfidf", 6))


def stream_upsert(spark, sf_dir):
    table = ix.new_index(spark, "doc_id", DOCUMENT)
    # written twice from fresh progress, cut into other batches the second time: the
    # first feed has another source, all of which the second one replaces
    path, third = _dropped(spark, sf_dir, c.table(spark, sf_dir, "documents"))
    first = flows.json_stream(spark, path, DOCUMENT, third).withColumn("source", F.lit("first"))
    flows.feed_index(first.drop(io.CORRUPT), table, flows.new_checkpoint(spark))
    again = flows.json_stream(spark, path, DOCUMENT, third + 1).drop(io.CORRUPT)
    flows.feed_index(again, table, flows.new_checkpoint(spark))
    return table.read().withColumn("text", F.md5("text"))


def stream_bad_lines(spark, sf_dir):
    """Lines that do not fit the schema are kept, as text, beside the records of a stream."""
    turns = c.table(spark, sf_dir, "conversations")
    path, third = _dropped(spark, sf_dir, turns.where("role <> 'assistant'").select("conv_id", "turn"))
    broken = turns.where("role = 'assistant'").select("conv_id", F.concat(F.lit("no "), "turn").alias("turn"))
    broken.write.mode("append").json(path)
    records = flows.json_stream(spark, path, "conv_id bigint, turn bigint", third)
    good, bad = work_path(spark, "good"), work_path(spark, "bad")
    keep = flows.split_bad(lambda rows, n: rows.write.mode("overwrite").parquet(f"{good}/batch={n}"), bad)
    flows.each_batch(records, keep, flows.new_checkpoint(spark))
    lines = spark.read.schema("line string").parquet(bad)
    kept = io.parse_json_lines(lines, "line", "conv_id bigint, turn string").select("conv_id", "turn")
    whole = spark.read.schema("conv_id bigint, turn bigint").parquet(good)
    return whole.select("conv_id", F.col("turn").cast("string").alias("turn")).union(kept)


def stream_extract(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages")
    path, third = _dropped(spark, sf_dir, pages)
    stream = flows.json_stream(spark, path, "page_id bigint, url string, html string", third)
    records = rec.page_records(stream, "url", "html", "page_id")
    out = work_path(spark, "records")
    wanted = records.select("page_id", "path", "file", "title", "body", "lang", "error")
    flows.append_to(wanted, out, flows.new_checkpoint(spark))
    return spark.read.schema(wanted.schema).parquet(out)


def stream_metrics(spark, sf_dir):
    """Totals of the table of metrics that was written while pages were extracted."""
    pages = c.table(spark, sf_dir, "pages")
    path, third = _dropped(spark, sf_dir, pages)
    stream = flows.json_stream(spark, path, "page_id bigint, url string, html string", third)
    records = metrics.watched(
        rec.page_records(stream, "url", "html", "page_id"), "extract",
        processed=F.count(F.lit(1)), errors=F.count_if(F.col("error").isNotNull()),
        characters=F.sum(F.length("body")),
    )
    folder, out = work_path(spark, "metrics"), work_path(spark, "records")
    with metrics.recorded(spark, "extract", folder) as listener:
        query = flows.append_to(records.select("page_id", "body", "error"), out, flows.new_checkpoint(spark))
        listener.wait(query.runId)
    return metrics.totals(metrics.table(spark, folder)).select("metric", "total", (F.col("batches") > 1).alias("running"))


def stream_files(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages")
    path, third = _dropped(spark, sf_dir, pages)
    files = flows.file_stream(spark, path, ["json"], third)
    lines = _lines(files)
    out = work_path(spark, "lines")
    flows.append_to(lines, out, flows.new_checkpoint(spark))
    back = spark.read.schema("line string").parquet(out)
    read = io.parse_json_lines(back, "line", "page_id bigint, url string, html string")
    return read.select("page_id", "url", F.md5("html").alias("html"))


QUERIES = {
    f.__name__: f
    for f in (
        json_roundtrip, json_rolled, json_bad_lines, binary_scan, tsv_roundtrip, cluster_column,
        corpus_stats_json, line_pairs, user_parser, batched_writer, stream_word_count, stream_corpus_stats,
        stream_changed_stats, stream_tfidf, stream_upsert, stream_bad_lines, stream_extract, stream_metrics, stream_files,
    )
}

ORACLES = {
    "json_roundtrip": "SELECT doc_id, lang, n_chars, md5(text) AS digest, NULL::VARCHAR AS bad FROM documents",
    "json_rolled": """SELECT doc_id, lang, n_chars, md5(text) AS digest, true AS fits, NULL::VARCHAR AS bad
FROM documents""",
    "json_bad_lines": "SELECT conv_id AS id, turn, role = 'assistant' AS bad FROM conversations",
    "binary_scan": "SELECT page_id, url FROM pages",
    "tsv_roundtrip": wd.ORACLES["tfidf_dense"],
    "cluster_column": """SELECT d.doc_id AS position, d.source, e.label::VARCHAR AS cluster
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
    "corpus_stats_json": f"""WITH {c.STATS}
SELECT '{{"totalDocs":' || count(DISTINCT doc_id) || '}}' AS line FROM counts
UNION ALL SELECT '{{"term":"' || term || '","documents":' || documents || ',"count":' || "count" || '}}' FROM stats""",
    "line_pairs": """WITH l AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS position, concat_ws(chr(9), doc_id, source) AS "left" FROM documents),
r AS (SELECT row_number() OVER (ORDER BY vec_id) AS position, concat_ws(' ', label, vec_id) AS "right" FROM embeddings)
SELECT position, "left", "right" FROM l JOIN r USING (position)""",
    "user_parser": """SELECT url AS path, split_part(url, '/', -1) AS file,
  CASE WHEN contains(html, '</html>') THEN 'text/html' END AS content_type,
  CASE WHEN contains(html, '</html>') THEN regexp_extract(html, '<title>(.*?)</title>', 1) END AS title,
  CASE WHEN NOT contains(html, '</html>') THEN 'ValueError: unterminated document' END AS error FROM pages""",
    "batched_writer": "SELECT count(*) AS rows, 0::BIGINT AS failed FROM customer",
    "stream_word_count": wd.ORACLES["word_count_by_doc"],
    "stream_corpus_stats": wd.ORACLES["corpus_stats"],
    "stream_changed_stats": f"""WITH newest AS (
  SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN text ELSE
    concat_ws(' ', 'draft', array_to_string(list_slice(string_split(text, ' '), 1, 40), ' '), lang) END AS text
  FROM documents), {c.STATS.replace("FROM documents", "FROM newest")}
SELECT term, documents, "count" FROM stats""",
    "stream_tfidf": f"WITH {c.TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM scores",
    "stream_upsert": "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents",
    "stream_extract": f"WITH {pg.RECORDS} SELECT page_id, path, file, title, body, lang, error FROM records",
    "stream_metrics": f"""WITH {pg.RECORDS}
SELECT 'processed' AS metric, count(*) AS total, true AS running FROM records
UNION ALL SELECT 'errors', count(error), true FROM records
UNION ALL SELECT 'characters', coalesce(sum(length(body)), 0)::BIGINT, true FROM records""",
    "stream_bad_lines": """SELECT conv_id, CASE WHEN role = 'assistant' THEN 'no ' || turn ELSE turn::VARCHAR END AS turn
FROM conversations""",
    "stream_files": "SELECT page_id, url, md5(html) AS html FROM pages",
}
