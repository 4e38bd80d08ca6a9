"""Turning arrays into rows without paying for an expensive array twice.

The optimizer pushes a filter below the projection that computes its input, and
infers such filters for ``explode``. With a cheap column that is a gain; with a
whole text chain it means that every document is tokenised once for the filter and
once for the result. Filters on a generator's output stay above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few given ``rows`` as constants of the plan.

    Catalyst takes a frame made from Python objects for boundless and would rather broadcast
    the other side of a join; the size of this one it knows.
    """
    fields = [F.struct(*[F.lit(value) for value in row]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*fields).cast(f"array<struct<{schema}>>")))


def expand(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """``keep`` columns and the fields of each struct in ``array``, one row each.

    The outer form keeps the optimizer from inferring a filter on the array's
    size; the null rows it adds are dropped here.
    """
    rows = df.select(*keep, F.explode_outer(array).alias("entry"))
    return rows.where(F.col("entry").isNotNull()).select(*keep, "entry.*")


def expand_values(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """Like :func:`expand` for an array of plain values."""
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


def once(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``value``, computed once even when it is filtered on
    afterwards."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that meet an expensive predicate, tested where the rows are.

    A plain filter moves down to the scan, below a preceding repartition; a test
    that cuts whole texts is better run after the rows have been spread.
    """
    tested = once(df, predicate, "_kept", *df.columns)
    return tested.where("_kept").drop("_kept")
