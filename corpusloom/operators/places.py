"""Places around many centres at once, by an equi-join on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.geo import EARTH, haversine

# Narrower bands than this many degrees would only make more cells.
LEAST_BAND = 0.01


def _cells_around(band: Column, height: float) -> Column:
    """Into how many cells a band of latitude is cut: a cell is about as wide as high
    where the band is nearest to its pole, and the polar bands have few."""
    low = F.abs(band * height - 90)
    high = F.abs((band + 1) * height - 90)
    outer = F.least(F.greatest(low, high), F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(outer)) * 360 / height), F.lit(1)).cast("bigint")


def _on_earth(df: DataFrame, key: str) -> DataFrame:
    """Key and position of rows that have one; a longitude outside -180 to 180 goes round."""
    lng = F.pmod(F.col("lng") + 180, F.lit(360.0)) - 180
    whole = F.col("lat").between(-90, 90) & (F.abs("lng") < math.inf)
    return df.where(whole).select(F.col(key), F.col("lat").cast("double").alias("lat"), lng.cast("double").alias("lng"))


def within_radius(
    places: DataFrame, centres: DataFrame, place: str, centre: str, radius: float, unit: str = "km"
) -> DataFrame:
    """``(centre, place, distance)`` of every place within ``radius`` of a centre.

    Both tables have ``lat`` and ``lng`` in degrees; ``place`` and ``centre`` name their
    keys. Latitude is cut into bands as high as the radius, each band into cells. A place
    lies in one cell, a centre asks for the cells its circle can reach, round the date line
    and over a pole too, so a pair meets exactly once; its distance decides. Rows
    without a position (null or not a number) have no partner, repeated rows count each.
    Centres are dealt over the session's shuffle partitions; no task holds its pairs.
    """
    angle = radius / EARTH[unit]
    height = min(180.0, max(math.degrees(angle) * (1 + 1e-9) + 1e-9, LEAST_BAND))
    spots = _on_earth(places, place).select(F.col(place).alias("_place"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    spots = spots.withColumn("_band", F.floor((F.col("_lat") + 90) / height))
    around = _cells_around(F.col("_band"), height)
    spots = spots.withColumn("_cell", F.pmod(F.floor((F.col("_lng") + 180) / 360 * around), around))

    asked = _on_earth(centres, centre).select(F.col(centre).alias("_centre"), F.col("lat").alias("_lat0"), F.col("lng").alias("_lng0"))
    # a centre makes far more pairs than it has bytes: dealt out evenly, however its table is stored
    asked = asked.repartition(int(centres.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.floor((F.col("_lat0") + 90) / height)
    asked = asked.withColumn("_band", F.explode(F.sequence(own - 1, own + 1)))
    # how far the circle reaches east and west; all round where it holds a pole
    reach = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(angle, math.pi / 2)) / F.cos(F.radians("_lat0"))))) + 1e-9
    wide = F.when(F.abs("_lat0") + height >= 90, F.lit(180.0)).otherwise(reach)
    around = _cells_around(F.col("_band"), height)
    west = F.floor((F.col("_lng0") - wide + 180) / 360 * around)
    east = F.floor((F.col("_lng0") + wide + 180) / 360 * around)
    every = F.sequence(F.lit(0).cast("bigint"), around - 1)
    some = F.transform(F.sequence(west, east), lambda cell: F.pmod(cell, around))
    asked = asked.withColumn("_cell", F.explode(F.when(east - west + 1 >= around, every).otherwise(some)))

    met = spots.join(asked, ["_band", "_cell"])
    distance = haversine(F.col("_lat"), F.col("_lng"), F.col("_lat0"), F.col("_lng0"), unit)
    found = met.withColumn("_distance", distance).where(F.col("_distance") <= radius)
    return found.select(F.col("_centre").alias(centre), F.col("_place").alias(place), F.col("_distance").alias("distance"))
