"""Facet counts: values, ranges and dates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx

ORDERS = ("count", "reverse_count", "term", "reverse_term")


@dataclass(frozen=True)
class Facet:
    """One value facet. ``kind`` says how a row's values are read: ``value`` (one
    value), ``array`` (each distinct element once) or ``text`` (each distinct
    token once). ``where`` narrows this facet alone."""

    field: str
    size: int = 10
    order: str = "count"
    kind: str = "value"
    where: Column | None = None
    name: str | None = None

    def __post_init__(self):
        if self.order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")

    @property
    def label(self) -> str:
        return self.name or self.field

    def values(self) -> Column:
        field = F.col(self.field)
        if self.kind == "text":
            found = F.array_distinct(tx.tokenise(field))
        elif self.kind == "array":
            found = F.array_distinct(field.cast("array<string>"))
        else:
            found = F.array(field.cast("string"))
        found = F.transform(found, lambda v: F.struct(F.lit(self.label).alias("facet"), v.alias("value")))
        if self.where is not None:
            found = F.when(self.where, found)
        return F.coalesce(found, F.array().cast("array<struct<facet:string,value:string>>"))


def facet_terms(df: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """``(facet, value, n, rank)`` for all facets in one scan and one shuffle.

    Values are counted map-side first, and every task cuts its part to the
    largest requested size before the final ranking of a facet.
    """
    listed = df.select(F.concat(*[f.values() for f in facets]).alias("values"))
    pairs = listed.select(F.explode_outer("values").alias("v")).select("v.facet", "v.value")
    counts = (
        pairs.where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def among(*orders: str) -> Column:
        return F.col("facet").isin([f.label for f in facets if f.order in orders])

    order = Window.partitionBy("facet").orderBy(
        F.when(among("count"), -F.col("n")).when(among("reverse_count"), F.col("n")),
        F.when(among("reverse_term"), F.col("value")).desc(),
        F.asc("value"),
    )
    size = F.coalesce(*[F.when(F.col("facet") == f.label, F.lit(f.size)) for f in facets])
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(f.size for f in facets))
        .where(F.col("rank") <= size)
    )


def facet_field(
    df: DataFrame,
    field: str,
    query: Column | None = None,
    prefix: str | None = None,
    sort: str = "count",
    limit: int | None = 100,
    offset: int = 0,
    mincount: int = 0,
    missing: bool = False,
    ranked: bool = False,
) -> DataFrame:
    """``(value, n)`` of one field with prefix, order, window and least count.

    ``mincount=0`` lists values of the whole table that the query does not reach,
    with a count of zero; with more the query is a condition of the scan. ``missing`` adds
    a null row, outside ``limit`` and last, from the same pass. ``ranked`` adds ``rank``, the
    place in the order from 1 (null for the null row), which needs a ``limit``.
    """
    if ranked and limit is None:
        raise ValueError("a rank needs a limit")
    match = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    value = F.col(field).cast("string").alias("value")
    if mincount >= 1:
        found = df if query is None else df.where(query)
        rows = found.select(value, F.lit(1).alias("hit"))
    else:
        rows = df.select(value, match.cast("int").alias("hit"))
    wanted = F.col("value").startswith(prefix) if prefix else F.col("value").isNotNull()
    if missing:
        # a row without a hit, so that there is a null row in any case
        rows = rows.union(df.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(0)))
        wanted = wanted | F.col("value").isNull()
    counts = rows.where(wanted).groupBy("value").agg(F.sum("hit").alias("n"))
    listed = counts.where((F.col("n") >= mincount) | F.col("value").isNull())
    keys = [F.desc("n"), F.asc("value")] if sort == "count" else [F.asc("value")]
    if limit is None and not offset:
        return listed.orderBy(F.col("value").isNull(), *keys)
    # the rank limit cuts every task's part before the two groups, values and the null row, are ranked
    order = Window.partitionBy(F.col("value").isNull()).orderBy(*keys)
    placed = listed.withColumn("rank", F.row_number().over(order))
    inside = F.lit(True) if limit is None else F.col("rank") <= offset + limit
    inside = (inside & (F.col("rank") > offset)) | F.col("value").isNull()
    if limit is not None:
        placed = placed.where(F.col("rank") <= max(offset + limit, 1))
    placed = placed.where(inside).orderBy(F.col("value").isNull(), *keys)
    if not ranked:
        return placed.select("value", "n")
    return placed.select("value", "n", F.when(F.col("value").isNotNull(), F.col("rank").cast("bigint")).alias("rank"))


# --- buckets ------------------------------------------------------------------

BEFORE, AFTER, BETWEEN = -1, -2, -3
INCLUDES = ("lower", "upper", "edge", "outer", "all")
OTHERS = ("before", "after", "between")


def _bucket_counts(
    df: DataFrame,
    low: Column,
    at_bound: Column,
    before: Column,
    at_start: Column,
    after: Column,
    at_end: Column,
    n_buckets: int,
    other: Sequence[str],
    include: Sequence[str],
) -> DataFrame:
    """``(bucket, n)`` including empty buckets.

    ``low`` is the bucket that starts at or before the value. A value on an inner
    bound belongs to the upper bucket under ``lower``, to the one below it under
    ``upper``, to both under both.
    """
    include = set(include)
    if "all" in include:
        include = {"lower", "upper", "edge", "outer"}
    lower, upper, edge, outer = (x in include for x in ("lower", "upper", "edge", "outer"))
    last = n_buckets - 1
    inside = ~before & ~after
    ids = []
    if lower:
        ids.append(F.when(inside & ~at_end, low))
    else:
        ids.append(F.when(inside & ~at_bound & ~at_end, low))
    if upper:
        ids.append(F.when(inside & ~at_start & (at_bound | at_end), F.when(at_end, F.lit(last)).otherwise(low - 1)))
    if edge and not lower:
        ids.append(F.when(at_start, F.lit(0)))
    if edge and not upper:
        ids.append(F.when(at_end, F.lit(last)))
    start_taken = lower or edge
    end_taken = upper or edge
    if "before" in other:
        ids.append(F.when(before | (at_start & F.lit(outer or not start_taken)), F.lit(BEFORE)))
    if "after" in other:
        ids.append(F.when(after | (at_end & F.lit(outer or not end_taken)), F.lit(AFTER)))
    if "between" in other:
        taken = inside & (~at_start | F.lit(start_taken)) & (~at_end | F.lit(end_taken))
        ids.append(F.when(taken, F.lit(BETWEEN)))
    buckets = F.array(*[i.cast("bigint") for i in ids])
    found = (
        df.select(F.explode(buckets).alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labels = {"before": BEFORE, "after": AFTER, "between": BETWEEN}
    wanted = [labels[o] for o in OTHERS if o in other]
    every = df.sparkSession.range(n_buckets).select(F.col("id").alias("bucket"))
    if wanted:
        extra = df.sparkSession.createDataFrame([(w,) for w in wanted], "bucket bigint")
        every = every.unionByName(extra)
    return every.join(found, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def _reached(df: DataFrame, x: Column, start: Column, stop: Column, other: Sequence[str]) -> DataFrame:
    """Rows that can fall in a bucket; a filter the scan can use, unless the
    counts before and after are wanted too."""
    if {"before", "after"} & set(_others(other)):
        return df.where(x.isNotNull())
    return df.where(x.between(start, stop))


def _label() -> Column:
    return (
        F.when(F.col("bucket") == BEFORE, "before")
        .when(F.col("bucket") == AFTER, "after")
        .when(F.col("bucket") == BETWEEN, "between")
        .otherwise("range")
    )


def _others(other: Sequence[str]) -> tuple[str, ...]:
    if "none" in other:
        return ()
    return OTHERS if "all" in other else tuple(other)


def facet_range(
    df: DataFrame,
    field: str,
    start: float,
    end: float,
    gap: float,
    hardend: bool = False,
    other: Sequence[str] = (),
    include: Sequence[str] = ("lower",),
) -> DataFrame:
    """``(kind, low, high, n)`` for ranges of width ``gap`` from ``start``.

    Without ``hardend`` the last range keeps its full width and the end moves up
    to it; with it the last range is cut at ``end``. Empty ranges are listed.
    """
    n_buckets = max(1, math.ceil((end - start) / gap))
    stop = end if hardend else start + n_buckets * gap
    x = F.col(field).cast("double")
    low = F.floor((x - start) / gap)
    counts = _bucket_counts(
        _reached(df, x, F.lit(float(start)), F.lit(float(stop)), other),
        low,
        x == F.lit(float(start)) + low * gap,
        x < start,
        x == start,
        x > stop,
        x == stop,
        n_buckets,
        _others(other),
        include,
    )
    edge = F.lit(float(start)) + F.col("bucket") * F.lit(float(gap))
    real = F.col("bucket") >= 0
    return counts.select(
        _label().alias("kind"),
        F.when(real, edge).alias("low"),
        F.when(real, F.least(edge + F.lit(float(gap)), F.lit(float(stop)))).alias("high"),
        "n",
    )


def facet_date(
    df: DataFrame,
    field: str,
    start: str,
    end: str,
    gap: int,
    unit: str,
    hardend: bool = False,
    other: Sequence[str] = (),
    include: Sequence[str] = ("lower",),
) -> DataFrame:
    """Date ranges, as :func:`facet_range`; ``gap`` counts ``unit``s, which may be
    calendar months or years. The session time zone should be UTC."""
    unit = unit.upper()
    # bounds take the column's own kind of timestamp, so comparisons need no cast
    ntz = df.schema[field].dataType.simpleString() == "timestamp_ntz"
    kind = "timestamp_ntz" if ntz else "timestamp"
    first, until = F.lit(start).cast(kind), F.lit(end).cast(kind)

    def edge_before(x: Column) -> Column:
        """Number of the last edge up to ``x``. An edge a month after the 31st is the
        month's last day, which the difference in months does not count yet."""
        low = F.floor(F.timestamp_diff(unit, first, x) / gap)
        next_edge = F.timestamp_add(unit, ((low + 1) * gap).cast("int"), first)
        return low + F.when(next_edge <= x, 1).otherwise(0)

    # constants of one row without a table: no job is run for them
    whole = edge_before(until).cast("int")
    full, exact = (
        df.sparkSession.sql("SELECT 1 AS one")
        .select(whole.alias("whole"), F.timestamp_add(unit, whole * gap, first) == until)
        .first()
    )
    n_buckets = max(1, full + (0 if exact else 1))
    stop = until if hardend else F.timestamp_add(unit, F.lit(n_buckets * gap), first)
    x = F.col(field) if ntz else F.col(field).cast(kind)
    low = edge_before(x)
    counts = _bucket_counts(
        _reached(df, x, first, stop, other),
        low,
        x == F.timestamp_add(unit, (low * gap).cast("int"), first),
        x < first,
        x == first,
        x > stop,
        x == stop,
        n_buckets,
        _others(other),
        include,
    )
    edge = F.timestamp_add(unit, (F.col("bucket") * gap).cast("int"), first)
    upper = F.timestamp_add(unit, ((F.col("bucket") + 1) * gap).cast("int"), first)
    real = F.col("bucket") >= 0
    return counts.select(
        _label().alias("kind"),
        F.when(real, edge).alias("low"),
        F.when(real, F.least(upper, stop)).alias("high"),
        "n",
    )
