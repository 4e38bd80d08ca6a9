"""Training and applying the document clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.rows import once

FEATURES = 10_000
ITERATIONS = 20
SEED = 42


def document_tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, tokens)`` under the index rule, duplicates kept; a document
    without tokens drops out."""
    keep = tx.index_rule(F.col("lang"))
    tokens = F.filter(tx.tokenise(F.col("text"), F.col("lang")), keep)
    kept = once(docs.where(F.col("text").isNotNull()), tokens, "tokens", "doc_id")
    return kept.where(F.size("tokens") > 0)


def clustering_stages(k: int, features: int = FEATURES, iterations: int = ITERATIONS, seed: int = SEED) -> Pipeline:
    return Pipeline(
        stages=[
            HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="tfidf"),
            KMeans(
                featuresCol="tfidf", predictionCol="cluster", k=k, maxIter=iterations,
                initMode="k-means||", seed=seed,
            ),
        ]
    )


def train(tokens: DataFrame, k: int, **options) -> PipelineModel:
    """Fit hashed term counts, idf and k-means. ``tokens`` is read several times;
    pass a stored table (see :func:`corpusloom.session.stage`)."""
    return clustering_stages(k, **options).fit(tokens)


def assign(model: PipelineModel, tokens: DataFrame, predict_space: str = "tfidf") -> DataFrame:
    """The columns of ``tokens`` and the ``cluster`` of the nearest centre.

    Documents are placed in the space the centres were trained in;
    ``predict_space="tf"`` compares raw term counts with those centres instead.
    """
    return _placed(model, tokens, predict_space).select(*tokens.columns, "cluster")


def _placed(model: PipelineModel, tokens: DataFrame, predict_space: str) -> DataFrame:
    if predict_space == "tfidf":
        return model.transform(tokens)
    if predict_space == "tf":
        hashing, _, kmeans = model.stages
        return kmeans.copy().setFeaturesCol("tf").transform(hashing.transform(tokens))
    raise ValueError(f"unknown space {predict_space!r}")


def distances(model: PipelineModel, tokens: DataFrame, predict_space: str = "tfidf") -> DataFrame:
    """``(doc_id, cluster, own, nearest)``: squared distance to the assigned
    centre and to the closest one.

    Vectors stay sparse: only the non-zero entries meet the centres, of which
    there are as many as the model was asked for. All vectors of a batch are one
    flat array, and a segmented sum gives their products with the centres.
    """
    placed = _placed(model, tokens, predict_space).select("doc_id", "cluster", F.col(predict_space).alias("vector"))
    centres = np.array(model.stages[-1].clusterCenters())
    shared = tokens.sparkSession.sparkContext.broadcast(centres)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_feature = np.ascontiguousarray(shared.value.T)
        norms = (by_feature**2).sum(axis=0)
        for frame in frames:
            sizes = [len(v["indices"]) for v in frame["vector"]]
            owner = np.repeat(np.arange(len(frame)), sizes)
            at = np.concatenate([[], *(v["indices"] for v in frame["vector"])]).astype(np.int64)
            x = np.concatenate([[], *(v["values"] for v in frame["vector"])])
            squares = np.bincount(owner, x**2, len(frame))
            products = np.column_stack(
                [np.bincount(owner, x * by_feature[at, c], len(frame)) for c in range(len(norms))]
            )
            found = np.maximum(squares[:, None] - 2 * products + norms, 0.0)
            own = found[np.arange(len(frame)), frame["cluster"].to_numpy()]
            yield frame[["doc_id", "cluster"]].assign(own=own, nearest=found.min(axis=1))

    return placed.mapInPandas(measure, "doc_id bigint, cluster int, own double, nearest double")


def cost(model: PipelineModel, tokens: DataFrame) -> DataFrame:
    """One row ``wssse``: the sum of squared distances to the own centre, measured
    with the finished model.

    The cost in a model's training summary is taken before the last move of the
    centres, so it is an upper bound of this one, equal once training converged.
    """
    return distances(model, tokens).agg(F.sum("own").alias("wssse"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


