"""Words per cluster, and nearest centres."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.functions.rows import expand
from corpusloom.operators.words import TokenRule
from corpusloom.session import BROADCAST_BYTES, planned_bytes

TOP_WORDS = 50


def words_per_cluster(
    docs: DataFrame,
    assignment: DataFrame,
    rule: TokenRule = tx.index_rule,
    cluster: str = "cluster",
) -> DataFrame:
    """``(cluster, word, n)``: how often a word occurs in a cluster's documents.

    The assignment is joined to whole documents, one row each, and words are
    expanded afterwards: no join ever sees a document's words as separate rows.
    Words are counted per document in the row and again map-side per cluster.
    """
    counted = docs.where(F.col("text").isNotNull()).select(
        "doc_id",
        tx.term_counts(F.col("text"), F.col("lang"), rule(F.col("lang"))).alias("terms"),
    )
    joined = counted.join(assignment.select("doc_id", cluster), "doc_id")
    return (
        expand(joined, "terms", cluster)
        .groupBy(cluster, F.col("term").alias("word"))
        .agg(F.sum("n").alias("n"))
    )


def words_of_assigned(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The same counts when tokens and cluster are already in one row, as after
    prediction: neither a join nor another look at the texts."""
    counted = assigned.select(cluster, tx.count_terms(F.col("tokens")).alias("terms"))
    return (
        expand(counted, "terms", cluster)
        .groupBy(cluster, F.col("term").alias("word"))
        .agg(F.sum("n").alias("n"))
    )


def top_words(counts: DataFrame, n: int = TOP_WORDS, cluster: str = "cluster") -> DataFrame:
    """``(cluster, rank, word, n)``; every task cuts its share to ``n`` per
    cluster before the final ranking."""
    best = Window.partitionBy(cluster).orderBy(F.desc("n"), F.asc("word"))
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select(cluster, "rank", "word", "n")


def top_words_lines(top: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One text line per cluster: ``cluster \\t word:n \\t ...`` in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word", "n")))
    cells = F.transform(ordered, lambda e: F.concat(e["word"], F.lit(":"), e["n"].cast("string")))
    return top.groupBy(cluster).agg(cells.alias("cells")).select(
        F.concat_ws("\t", F.col(cluster).cast("string"), F.col("cells")).alias("line")
    )


def assignment_lines(assignment: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assignment.select(
        F.concat_ws("\t", F.col(cluster).cast("string"), F.col("doc_id").cast("string")).alias("line")
    )


def mean_centres(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, centre)``: the mean vector of each group, summed map-side."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return vectors.groupBy(group).agg(vector_to_array(mean).alias("centre"))


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0).cast("double"), lambda s, v: s + v)


def nearest_centre(
    vectors: DataFrame, centres: DataFrame, key: str, vector: str, group: str, parts: int | None = None
) -> DataFrame:
    """``(key, group, distance)`` of the closest centre; ties go to the lowest.

    Every vector meets every centre of its dimension, which is the task; the centres
    are broadcast where their size allows. Beyond that, or with ``parts``, vectors are dealt
    to so many parts (the shuffle partitions by default) and each part gets its copy of the
    centres, as a dimension is one key only. Keys are unique: a task keeps one row per key, so
    that the pairs are folded where they are made.
    """
    prepared = vectors.select(key, F.col(vector).cast("array<double>").alias("_vector"))
    prepared = prepared.withColumn("_size", F.size("_vector"))
    sides = centres.select(F.col(group).alias("_group"), F.col("centre").alias("_centre"), F.size("centre").alias("_size"))
    distance = squared_distance(F.col("_vector"), F.col("_centre"))
    if parts is None and planned_bytes(sides) <= BROADCAST_BYTES:
        pairs = prepared.join(F.broadcast(sides), "_size")
    else:
        parts = parts or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = prepared.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        copies = sides.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = dealt.join(copies, ["_size", "_part"])
    near = pairs.groupBy(key).agg(F.min(F.struct(distance.alias("distance"), F.col("_group").alias("group"))).alias("near"))
    return near.select(key, F.col("near.group").alias(group), F.col("near.distance").alias("distance"))
