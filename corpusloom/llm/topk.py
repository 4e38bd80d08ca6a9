"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets. A first pass over the longest vectors gives
every query a score that its k-th answer will reach at least. With it, each bucket and
query have a local threshold, the smallest cosine a vector of the bucket must have:
above 1 the bucket is skipped; where it is high, single coordinates already rule out
most vectors (a unit vector within the angle keeps close to the query in each of them);
otherwise vectors are cut off by their own length. What remains is verified by exact
integer products.

Queries with similar local thresholds form a block. Blocks and buckets that cannot meet are
ruled out on a small table of both before anything is shuffled, and of a bucket only the vectors
long enough for the block are sent. Blocks hold a bounded number of vectors, and only each
query's best k of a block leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.staging import Staging, few, ship

BUCKET = 4096
QUERY_BLOCK = 256
#: from this local cosine on, coordinates are looked at before products
COORDINATE_COSINE = 0.6
COORDINATES = 4
EXACT = float(1 << 53)


def _dots(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact products of integer rows; in floating point where no sum can round."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ p.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= floor)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def _candidates(q: np.ndarray, length: float, bucket: np.ndarray, lengths: np.ndarray, least: float) -> np.ndarray:
    """Rows of a bucket that may reach the score ``least`` with query ``q``."""
    n = len(bucket)
    if not np.isfinite(least) or least <= 0 or length == 0:
        return np.arange(n)
    local = least / (length * lengths[0]) if lengths[0] > 0 else np.inf
    room = 1 + 1e-9
    if local > room:
        return np.empty(0, np.int64)
    # length: |q| |p| must reach the score; lengths fall along the bucket
    place = np.arange(np.searchsorted(-lengths * length * room, -least, side="right"))
    if local < COORDINATE_COSINE:
        return place
    # coordinates: an angle of at most acos(t) to the query bounds the angle to each axis
    unit = np.clip(q / length, -1, 1)
    for c in np.argsort(-np.abs(unit))[:COORDINATES]:
        t = np.clip(least / (length * lengths[place]), -1, 1)
        own, wide = np.arccos(unit[c]), np.arccos(t)
        low = np.cos(np.minimum(np.pi, own + wide)) - 1e-9
        high = np.cos(np.maximum(0, own - wide)) + 1e-9
        x = bucket[place, c] / lengths[place]
        place = place[(x >= low) & (x <= high)]
    return place


def _search(k: int):
    """Each query's best k of one bucket, for one block of queries."""

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        return np.array(frame["v"].tolist(), np.int64)

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        del key
        found = []
        for dim, asked in queries.groupby(queries["v"].str.len()):
            bucket = vectors[vectors["v"].str.len() == dim]
            if not len(bucket):
                continue
            p = matrix(bucket)
            lengths = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
            order = np.argsort(-lengths, kind="stable")
            p, lengths, ids = p[order], lengths[order], bucket["vec_id"].to_numpy()[order]
            q = matrix(asked)
            q_lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
            least = asked["least"].to_numpy(np.float64, na_value=-np.inf)
            # queries that keep the whole bucket share one product of matrices
            places = [_candidates(q[i], q_lengths[i], p, lengths, least[i]) for i in range(len(q))]
            full = [i for i in range(len(q)) if len(places[i]) == len(p)]
            dots = dict(zip(full, _dots(q[full], p)))
            for i, asker in enumerate(asked["vec_id"].tolist()):
                place = places[i]
                scores = dots[i] if i in dots else _dots(q[i : i + 1], p[place])[0]
                other = ids[place] != asker
                near, scores = ids[place][other], scores[other]
                best = _best(near, scores, k)
                found.append(pd.DataFrame({"query_id": asker, "vec_id": near[best], "score": scores[best]}))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.concat(found)

    return run


def quantised(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """``vec_id`` and ``v``, every component times ``factor`` rounded down; vectors that
    are null, empty or hold a null or non-finite component are left out."""
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    rows = vectors.where("vec_id is not null and embedding is not null").where((F.size("embedding") > 0) & whole)
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def may_reach(length: str, need: str) -> Column:
    """Whether a vector of this length can reach the score that asks for the length ``need``."""
    return F.col(length) * (1 + 1e-9) >= F.col(need)


def in_blocks(staging: Staging, rows: DataFrame, size: int, name: str, *order: Column) -> DataFrame:
    """``rows`` (written) with the number ``name`` of their block: ``size`` rows each, in this order.

    Ranges are sorted each by a task of its own, however many there are; a running sum over one
    row for each tells the blocks where a range begins.
    """
    ranges = rows.repartitionByRange(max(1, -(-rows.count() // size)), *order)
    ranges = staging.keep(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    begin = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_begin")
    numbered = ranges.join(few(staging.keep(begin, "begin")), "_range").withColumn(name, F.floor(place / size).cast("int"))
    return staging.keep(numbered.drop("_range", "_begin"), name)


def reachable(blocks: DataFrame, longest: DataFrame) -> DataFrame:
    """``(dim, bucket, longest, block, need)``: the buckets that some query of a block needs.

    ``blocks(dim, block, need)`` has the least length that its queries ask for, ``longest(dim,
    bucket, longest)`` a bucket's greatest one. Both are small tables, one row for thousands of
    vectors, so what cannot meet is settled before a vector is copied.
    """
    return blocks.join(few(longest), "dim").where(may_reach("longest", "need"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every vector that meets ``is_query`` (a
    condition on vec_id) the ``k`` others with the highest inner products, ties to the
    smaller vec_id; all, if there are fewer.

    ``vectors(vec_id, v)`` holds integer arrays, and only vectors of equal dimension are
    compared. Rows that repeat a vec_id count once, with the smallest of their vectors.
    Scores beyond a long are cut to its range. Other columns are ignored; an empty table
    gives no rows.
    """
    ship(vectors.sparkSession)
    staging = Staging(vectors.sparkSession)
    once = vectors.groupBy("vec_id").agg(F.min("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    once = staging.keep(once.withColumn("length", length).withColumn("dim", F.size("v")), "vectors")
    buckets = in_blocks(staging, once, BUCKET, "bucket", F.col("dim"), F.desc("length"), F.col("vec_id"))
    queries = staging.keep(buckets.where(is_query).drop("bucket"), "queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    longest = buckets.groupBy("dim", "bucket").agg(F.max("length").alias("longest"))
    longest = staging.keep(longest, "longest")

    def searched(rows: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """Each query's best of the buckets that ``pairs`` lists for its block."""
        met = few(staging.keep(pairs, "pairs"))
        left = rows.join(met, ["dim", "bucket"]).where(may_reach("length", "need"))
        right = asked.withColumnRenamed("need", "own").join(met, ["dim", "block"]).where(may_reach("longest", "own"))
        left = left.select("dim", "bucket", "block", "vec_id", "v")
        right = right.select("dim", "bucket", "block", "vec_id", "v", "least")
        key = ["dim", "bucket", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
            _search(k), "query_id long, vec_id long, score long"
        )

    # the longest vectors of each dimension, for every query
    first = longest.groupBy("dim").agg(F.max_by("bucket", "longest").alias("bucket"), F.max("longest").alias("longest"))
    first = staging.keep(first, "first")
    any_length = F.lit(float("-inf"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    asked = asked.withColumn("least", F.lit(None).cast("double")).withColumn("need", any_length)
    blocks = asked.groupBy("dim", "block").agg(F.min("need").alias("need"))
    heads = staging.keep(searched(buckets, asked, blocks.join(few(first), "dim")), "heads")

    # now every query has a score to reach, so a length that others need to reach it
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = heads.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    least = least.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    need = F.when((F.col("least") > 0) & (F.col("length") > 0), F.col("least") / F.col("length")).otherwise(any_length)
    asked = queries.join(least, "vec_id", "left").withColumn("need", need)
    asked = in_blocks(staging, asked, QUERY_BLOCK, "block", F.col("dim"), F.col("need"), F.col("vec_id"))
    blocks = staging.keep(asked.groupBy("dim", "block").agg(F.min("need").alias("need")), "blocks")
    rest = searched(buckets, asked, reachable(blocks, longest.join(few(first), ["dim", "bucket"], "left_anti")))
    ranked = heads.union(rest).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    found = staging.keep(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
    staging.only(found)
    return found
