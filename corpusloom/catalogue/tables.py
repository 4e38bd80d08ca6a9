"""Keyed tables, positions, clusters and centres."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.functions import text as tx
from corpusloom.operators import clusters as cl
from corpusloom.operators import index as ix
from corpusloom.plans import apply as apply_job
from corpusloom.plans import clustering as km
from corpusloom.plans import train as train_job
from corpusloom.session import small_side, stage, work_path

CLUSTERS = 8
BATCH_TIME = "2024-05-01 12:00:00"


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _index(spark, sf_dir):
    return c.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _digest(rows):
    """Whole documents, the text as its digest to compare."""
    return rows.withColumn("text", F.md5("text"))


def _batch(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels")
    first = labels.select(
        "doc_id", F.concat(F.lit("label text "), "doc_id").alias("text"), F.lit("xx").alias("lang"),
        F.concat(F.lit("q"), "quality").alias("source"), F.lit(1).cast("bigint").alias("n_chars"),
        F.lit(1).alias("version"),
    )
    # a second write of the same keys, and keys the index does not have
    again = first.withColumn("source", F.concat(F.lit("again-"), "source")).withColumn("version", F.lit(2))
    fresh = first.withColumn("doc_id", F.col("doc_id") + 10_000_000)
    return again.where(F.col("source") == "again-q1").unionByName(first).unionByName(fresh)


def index_upsert(spark, sf_dir):
    return _digest(ix.upsert(_index(spark, sf_dir), _batch(spark, sf_dir), "doc_id", "version").drop("version"))


def index_table_twice(spark, sf_dir):
    """A repeated batch, and another writer whose batch numbers start again."""
    table = ix.new_index(spark, "doc_id", DOCUMENT)
    table.write(_index(spark, sf_dir), 0)
    batch = _batch(spark, sf_dir)
    for _ in range(2):
        table.write(batch, 0, "version", writer="second")
    return _digest(table.read())


def index_field_delta(spark, sf_dir):
    """Single fields written as keys and values only, before and after a full write."""
    table = ix.new_index(spark, "doc_id", DOCUMENT)
    labels = c.table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("source"))
    known = labels.join(_index(spark, sf_dir), "doc_id", "left_semi")
    table.write_field(known.withColumn("source", F.lit("too early")), "source", 0)
    table.write(_index(spark, sf_dir), 1)
    table.write_field(labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 10_000_000)), "source", 2)
    return _digest(table.read())


def index_folded(spark, sf_dir):
    """Two writers and single fields, some of it folded into the buckets' base files."""
    path = work_path(spark, "folded")
    table, other = (ix.IndexTable(spark, path, "doc_id", DOCUMENT, buckets=12, fold_after=3) for _ in range(2))
    table.write(_index(spark, sf_dir), 0)
    other.write(_batch(spark, sf_dir), 0, "version", writer="second")
    labels = c.table(spark, sf_dir, "labels")
    table.write_field(labels.select("doc_id", F.lit("zz").alias("lang")), "lang", 0)
    known = labels.where("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("source"))
    other.write_field(known, "source", 0, writer="second")
    return _digest(table.read())


def index_partial_update(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("cluster"))
    shifted = labels.withColumn("doc_id", F.col("doc_id") + 10_000_000)
    return _digest(ix.set_field(_index(spark, sf_dir), labels.unionByName(shifted), "doc_id", "cluster"))


def index_update_existing(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 5).alias("doc_id"), F.concat(F.lit("toxic"), "toxic").alias("source")
    )
    return _digest(ix.set_field(_index(spark, sf_dir), labels, "doc_id", "source", insert=False))


def index_stamped(spark, sf_dir):
    return _digest(ix.stamp(_index(spark, sf_dir), BATCH_TIME))


def positional_join(spark, sf_dir):
    left = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "lang")
    right = c.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("position"), F.col("label").cast("bigint").alias("cluster")
    )
    return ix.join_by_position(left, right)


def _assignment(spark, sf_dir):
    ids = c.table(spark, sf_dir, "documents").select("doc_id")
    return ids.withColumn("cluster", (F.col("doc_id") % CLUSTERS))


def _cluster_words(spark, sf_dir):
    return cl.words_per_cluster(c.documents(spark, sf_dir), _assignment(spark, sf_dir))


def cluster_words(spark, sf_dir):
    return _cluster_words(spark, sf_dir)


def top_words(spark, sf_dir):
    top = cl.top_words(_cluster_words(spark, sf_dir))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def top_words_lines(spark, sf_dir):
    return cl.top_words_lines(cl.top_words(_cluster_words(spark, sf_dir)))


def assignment_lines(spark, sf_dir):
    return cl.assignment_lines(_assignment(spark, sf_dir))


def nearest_centre(spark, sf_dir):
    vectors = c.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    centres = cl.mean_centres(vectors, "label", "embedding")
    near = cl.nearest_centre(vectors.drop("label"), centres, "vec_id", "embedding", "label")
    return near.withColumn("distance", F.round("distance", 6))


def assigned_words(spark, sf_dir):
    tokens = km.document_tokens(c.documents(spark, sf_dir))
    assigned = tokens.withColumn("cluster", F.col("doc_id") % CLUSTERS)
    return cl.words_of_assigned(assigned)


def _tokens(spark, sf_dir):
    return stage(km.document_tokens(c.documents(spark, sf_dir)), "tokens")


def train_assign(spark, sf_dir):
    """Train, then check every document against all centres of the model."""
    tokens = _tokens(spark, sf_dir)
    model = km.train(tokens, CLUSTERS)
    found = km.distances(model, tokens)
    return found.select("doc_id", (F.col("own") <= F.col("nearest") * (1 + 1e-9)).alias("nearest"))


def wssse(spark, sf_dir):
    """The cost is the sum of the smallest distances and does not exceed the cost
    before the last move of the centres."""
    tokens = _tokens(spark, sf_dir)
    model = km.train(tokens, CLUSTERS)
    before = model.stages[-1].summary.trainingCost
    sums = km.distances(model, tokens).agg(F.sum("own").alias("own"), F.sum("nearest").alias("nearest"))
    # the cost again, from the vectors and centres as plain columns
    centres = tokens.sparkSession.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(model.stages[-1].clusterCenters())],
        "cluster int, centre array<double>",
    )
    placed = model.transform(tokens).select("cluster", vector_to_array("tfidf").alias("v"))
    plain = placed.join(F.broadcast(centres), "cluster").agg(
        F.sum(cl.squared_distance(F.col("v"), F.col("centre"))).alias("plain")
    )
    return sums.crossJoin(plain).select(
        (F.abs(F.col("own") - F.col("nearest")) <= 1e-9 * F.col("own")).alias("sum_of_nearest"),
        (F.col("own") <= F.lit(before) * (1 + 1e-9)).alias("not_above_training"),
        (F.abs(F.col("own") - F.col("plain")) <= 1e-6 * F.col("own")).alias("same_in_columns"),
    )


def model_roundtrip(spark, sf_dir):
    """A saved and reloaded model assigns the same clusters."""
    tokens = _tokens(spark, sf_dir)
    model = km.train(tokens, CLUSTERS)
    path = work_path(spark, "model")
    km.save(model, path)
    before = km.assign(model, tokens).select("doc_id", "cluster")
    after = km.assign(km.load(path), tokens).select("doc_id", F.col("cluster").alias("again"))
    return before.join(after, "doc_id").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("cluster") != F.col("again")).alias("differences")
    )


def train_predict_tf(spark, sf_dir):
    """Raw term counts go to the nearest of the centres trained on tf-idf."""
    tokens = _tokens(spark, sf_dir)
    model = km.train(tokens, CLUSTERS)
    found = km.distances(model, tokens, "tf")
    return found.select("doc_id", (F.col("own") <= F.col("nearest") * (1 + 1e-9)).alias("nearest"))


def hashed_counts(spark, sf_dir):
    """A document's hashed vector holds all its tokens, each where the word alone is put."""
    tokens = _tokens(spark, sf_dir)
    hashing = km.clustering_stages(CLUSTERS).getStages()[0]
    words = tokens.select("doc_id", F.explode("tokens").alias("word"))
    alone = hashing.transform(words.select("word").distinct().withColumn("tokens", F.array("word")))
    places = alone.select("word", F.array_position(vector_to_array("tf"), F.lit(1.0)).alias("place"))
    plain = words.join(places, "word").groupBy("doc_id", "place").agg(F.count(F.lit(1)).cast("double").alias("n"))
    plain = plain.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("plain"), F.sum("n").alias("tokens"))
    cells = F.arrays_zip(F.sequence(F.lit(1).cast("bigint"), F.lit(km.FEATURES).cast("bigint")).alias("place"), vector_to_array("tf").alias("n"))
    hashed = hashing.transform(tokens).select("doc_id", F.filter(cells, lambda e: e["n"] > 0).alias("cells"))
    return hashed.join(plain, "doc_id").select(
        "doc_id", F.col("tokens").cast("bigint").alias("tokens"), (F.col("cells") == F.col("plain")).alias("same")
    )


def assign_tf(spark, sf_dir):
    """Clusters of raw term counts against distances summed from words and centres as plain rows."""
    tokens = _tokens(spark, sf_dir)
    model = km.train(tokens, CLUSTERS)
    hashing, _, kmeans = model.stages
    # one row a feature, whatever the corpus
    centres = spark.createDataFrame(
        [(i, [float(x) for x in values]) for i, values in enumerate(zip(*kmeans.clusterCenters()))], "place long, centre array<double>"
    )
    lengths = [float((centre**2).sum()) for centre in kmeans.clusterCenters()]
    entries = hashing.transform(tokens).select(
        "doc_id", F.posexplode(vector_to_array("tf")).alias("place", "n")
    ).where(F.col("n") > 0)
    products = [F.sum(F.col("n") * F.get("centre", F.lit(k))) for k in range(len(lengths))]
    sums = entries.join(small_side(centres), "place").groupBy("doc_id").agg(
        F.array(*[F.lit(length) - 2 * product for length, product in zip(lengths, products)]).alias("far")
    )
    found = km.assign(model, tokens, "tf").select("doc_id", "cluster").join(sums, "doc_id")
    return found.select("doc_id", (F.get("far", "cluster") <= F.array_min("far") + 1e-6).alias("nearest"))


def train_apply_jobs(spark, sf_dir):
    """The two jobs on ``documents``: every document with tokens is placed once, and the listed
    words are the commonest of each cluster, counted again from the placed documents."""
    documents, model = f"{sf_dir}/documents.parquet", work_path(spark, "model")
    placed, listed = work_path(spark, "placed"), work_path(spark, "listed")
    train_job.main(["--documents", documents, "-o", model, "-n", str(CLUSTERS)])
    apply_job.main(["--documents", documents, "-i", model, "--output1", placed, "--output2", listed, "--top", "5"])
    cells = F.split("value", "\t")
    found = spark.read.text(placed).select(cells[0].cast("int").alias("cluster"), cells[1].cast("bigint").alias("doc_id"))
    words = spark.read.text(listed).select(
        cells[0].cast("int").alias("cluster"), F.explode(F.slice(cells, 2, 5)).alias("listed")
    )
    tokens = km.document_tokens(c.documents(spark, sf_dir)).select("doc_id", F.explode("tokens").alias("word"))
    counts = tokens.join(found, "doc_id").groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("cluster").agg(F.max("n").alias("most"))
    right = words.withColumn("n", F.regexp_extract("listed", ":(\\d+)$", 1).cast("bigint")).groupBy("cluster").agg(
        F.max("n").alias("listed"), F.count(F.lit(1)).alias("words")
    )
    same = tops.join(right, "cluster").select("cluster", ((F.col("most") == F.col("listed")) & (F.col("words") <= 5)).alias("same"))
    return found.join(same, "cluster", "left").select(
        "doc_id", F.col("cluster").between(0, CLUSTERS - 1).alias("placed"), F.coalesce("same", F.lit(False)).alias("commonest")
    )


QUERIES = {
    f.__name__: f
    for f in (
        index_upsert, index_table_twice, index_field_delta, index_folded, index_partial_update, index_update_existing,
        index_stamped, positional_join, cluster_words, top_words, top_words_lines,
        assigned_words, assignment_lines, nearest_centre, train_assign, wssse, model_roundtrip, train_predict_tf,
        hashed_counts, assign_tf, train_apply_jobs,
    )
}

_UPSERT = """WITH batch AS (
  SELECT doc_id, md5('label text ' || doc_id) AS text, 'xx' AS lang,
    CASE WHEN quality = 1 THEN 'again-q1' ELSE 'q' || quality END AS source, 1::BIGINT AS n_chars FROM labels
  UNION ALL SELECT doc_id + 10000000, md5('label text ' || doc_id), 'xx', 'q' || quality, 1 FROM labels)
SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM batch)
UNION ALL SELECT * FROM batch"""
_CLUSTER_WORDS = f"""{c.COUNTS},
cw AS (SELECT doc_id % {CLUSTERS} AS cluster, term AS word, sum(n)::BIGINT AS n FROM counts GROUP BY ALL),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS rank FROM cw)
  WHERE rank <= {cl.TOP_WORDS})"""
_WITH_TOKENS = f"{c.COUNTS}, with_tokens AS (SELECT DISTINCT doc_id FROM counts)"

ORACLES = {
    "index_upsert": _UPSERT,
    "index_table_twice": _UPSERT,
    "index_field_delta": """WITH u AS (
  SELECT doc_id, 'q' || quality AS source FROM labels
  UNION ALL SELECT doc_id + 10000000, 'q' || quality FROM labels)
SELECT coalesce(d.doc_id, u.doc_id) AS doc_id, md5(d.text) AS text, d.lang,
  coalesce(u.source, d.source) AS source, d.n_chars
FROM documents d FULL JOIN u ON u.doc_id = d.doc_id""",
    "index_folded": f"""WITH written AS ({_UPSERT})
SELECT w.doc_id, w.text, CASE WHEN l.doc_id IS NULL THEN w.lang ELSE 'zz' END AS lang,
  CASE WHEN l.toxic = 1 THEN NULL ELSE w.source END AS source, w.n_chars
FROM written w LEFT JOIN labels l ON l.doc_id = w.doc_id""",
    "index_partial_update": """WITH u AS (
  SELECT doc_id, quality::BIGINT AS cluster FROM labels
  UNION ALL SELECT doc_id + 10000000, quality FROM labels)
SELECT coalesce(d.doc_id, u.doc_id) AS doc_id, md5(d.text) AS text, d.lang, d.source, d.n_chars, u.cluster
FROM documents d FULL JOIN u ON u.doc_id = d.doc_id""",
    "index_update_existing": """SELECT d.doc_id, md5(d.text) AS text, d.lang, coalesce('toxic' || l.toxic, d.source) AS source, d.n_chars
FROM documents d LEFT JOIN labels l ON l.doc_id + 5 = d.doc_id""",
    "index_stamped": f"SELECT doc_id, md5(text) AS text, lang, source, n_chars, TIMESTAMP '{BATCH_TIME}' AS indexed_at FROM documents",
    "positional_join": """SELECT d.doc_id AS position, d.lang, e.label::BIGINT AS cluster
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
    "cluster_words": f"WITH {_CLUSTER_WORDS} SELECT cluster, word, n FROM cw",
    "assigned_words": f"WITH {_CLUSTER_WORDS} SELECT cluster, word, n FROM cw",
    "top_words": f"WITH {_CLUSTER_WORDS} SELECT cluster, rank, word, n FROM top",
    "top_words_lines": f"""WITH {_CLUSTER_WORDS}
SELECT cluster || chr(9) || string_agg(word || ':' || n, chr(9) ORDER BY rank) AS line FROM top GROUP BY cluster""",
    "assignment_lines": f"SELECT (doc_id % {CLUSTERS}) || chr(9) || doc_id AS line FROM documents",
    "nearest_centre": """WITH cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centres AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
dist AS (
  SELECT v.vec_id, c.label, sum((v.x - c.x) * (v.x - c.x)) AS d
  FROM cells v JOIN centres c USING (i) GROUP BY v.vec_id, c.label),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM dist)
SELECT vec_id, label::BIGINT AS label, round(d, 6) AS distance FROM best WHERE r = 1""",
    "train_assign": f"WITH {_WITH_TOKENS} SELECT doc_id, true AS nearest FROM with_tokens",
    "wssse": "SELECT true AS sum_of_nearest, true AS not_above_training, true AS same_in_columns",
    "model_roundtrip": f"WITH {_WITH_TOKENS} SELECT count(*) AS docs, 0::BIGINT AS differences FROM with_tokens",
    "train_predict_tf": f"WITH {_WITH_TOKENS} SELECT doc_id, true AS nearest FROM with_tokens",
    "assign_tf": f"WITH {_WITH_TOKENS} SELECT doc_id, true AS nearest FROM with_tokens",
    "hashed_counts": f"WITH {c.COUNTS} SELECT doc_id, sum(n)::BIGINT AS tokens, true AS same FROM counts GROUP BY doc_id",
    "train_apply_jobs": f"WITH {_WITH_TOKENS} SELECT doc_id, true AS placed, true AS commonest FROM with_tokens",
}
