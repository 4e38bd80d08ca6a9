"""Reading document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread


def scan(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    key: str | None = None,
    descending: str | None = None,
) -> DataFrame:
    """Indexed documents with a pushed-down predicate and a projection.

    ``key`` names a unique id and marks the scan as input for CPU-heavy work
    (see :func:`corpusloom.session.spread`). ``descending`` sorts the result by
    one column; it is a full sort, so ask for it only when the order matters.
    """
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    if key is not None:
        df = spread(df, key)
    if descending is not None:
        df = df.orderBy(F.col(descending).desc())
    return df
