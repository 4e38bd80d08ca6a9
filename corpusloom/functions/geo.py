"""Distance filters on latitude and longitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius by unit, and the length of one degree of latitude.
EARTH = {"km": 6371.0, "miles": 3958.8}


def arc_distance(lat: Column, lng: Column, lat0: float, lng0: float, unit: str = "km") -> Column:
    """Great-circle distance (haversine)."""
    half_lat = F.radians(lat - lat0) / 2
    half_lng = F.radians(lng - lng0) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(
        F.sin(half_lng), 2
    )
    return 2 * EARTH[unit] * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine(lat: Column, lng: Column, lat0: Column, lng0: Column, unit: str = "km") -> Column:
    """Great-circle distance between two places that are both columns."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * F.pow(
        F.sin(F.radians(lng - lng0) / 2), 2
    )
    return 2 * EARTH[unit] * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def degrees_east(lng: Column, lng0: float) -> Column:
    """Longitude difference between -180 and 180."""
    return F.pmod(lng - lng0 + 180, F.lit(360.0)) - 180


def plane_distance(lat: Column, lng: Column, lat0: float, lng0: float, unit: str = "km") -> Column:
    """Distance on the plane that touches at the centre's latitude; the way round the
    date line counts where it is shorter."""
    dx = F.radians(degrees_east(lng, lng0)) * math.cos(math.radians(lat0))
    dy = F.radians(lat - lat0)
    return EARTH[unit] * F.sqrt(dx * dx + dy * dy)


def within(
    lat: Column,
    lng: Column,
    lat0: float,
    lng0: float,
    radius: float,
    unit: str = "km",
    calc: str = "arc",
) -> Column:
    """Rows inside the radius. Bands of latitude and longitude, which hold every such row
    and can be pushed to the scan, go first; longitudes run from -180 to 180."""
    angle = radius / EARTH[unit]
    band = math.degrees(angle) + 1e-9
    distance = {"arc": arc_distance, "plane": plane_distance}[calc]
    near = lat.between(lat0 - band, lat0 + band)
    cosine = math.cos(math.radians(lat0))
    if calc == "plane":
        wide = math.degrees(angle / cosine) if cosine > 1e-9 else 180.0
    else:
        pole = abs(lat0) + band >= 90
        wide = 180.0 if pole else math.degrees(math.asin(min(1.0, math.sin(angle) / cosine)))
    wide += 1e-9
    if wide < 180:
        west, east = lng0 - wide, lng0 + wide
        side = lng.between(west, east)
        if west < -180:
            side = side | (lng >= west + 360)
        if east > 180:
            side = side | (lng <= east - 360)
        near = near & side
    return near & (distance(lat, lng, lat0, lng0, unit) <= radius)
