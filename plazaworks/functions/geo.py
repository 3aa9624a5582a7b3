"""Distances and places on the map."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Ground metres a pixel at the equator and zoom 0, pixels from the middle to the edge of a view, and bounds of its radius.
PIXEL_M, HALF_VIEW, LEAST_M, MOST_M = 156_543.03, 600.0, 400.0, 30_000.0
#: The region that is served: south, north, west, east.
REGION = (49.15, 50.52, 19.05, 21.50)
#: Metres a degree of latitude spans at least; for boxes that safely hold a circle.
DEGREE_M = 111_000.0


class Box(NamedTuple):
    """Degrees; west > east wraps around the antimeridian."""

    south: float
    west: float
    north: float
    east: float


def finite(*values: Column) -> Column:
    """None of the values is null, NaN or infinite."""
    found = F.lit(True)
    for v in values:
        found = found & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return found


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def viewport_radius_m(lat: Column, zoom: Column) -> Column:
    """Radius that a map view at a zoom level shows."""
    return F.greatest(F.lit(LEAST_M), F.least(F.lit(MOST_M), PIXEL_M * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom) * HALF_VIEW))


def within_radius(lat: Column, lon: Column, center_lat: float, center_lon: float, radius_m: float) -> Column:
    """Within the radius, its edge included; coordinates that aren't finite never are.

    A box around the circle comes first: Parquet's statistics can rule out row
    groups by it, as they can't by the distance. Near a pole or the
    antimeridian it is one of latitudes only.
    """
    reach = radius_m / DEGREE_M
    box = lat.between(center_lat - reach, center_lat + reach)
    if abs(center_lat) + reach < 89:
        wide = reach / math.cos(math.radians(abs(center_lat) + reach))
        if abs(center_lon) + wide < 180:
            box = box & lon.between(center_lon - wide, center_lon + wide)
    return box & finite(lat, lon) & (haversine_m(lat, lon, F.lit(center_lat), F.lit(center_lon)) <= radius_m)


def within_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Within the box, edges included; west > east wraps around the antimeridian."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return finite(lat, lon) & lat.between(south, north) & across


def in_region(lat: Column, lon: Column) -> Column:
    south, north, west, east = REGION
    return lat.between(south, north) & lon.between(west, east)


def distance_band(meters: Column) -> Column:
    return F.when(meters < 500, "within_500m").when(meters < 2000, "within_2km").when(meters < 5000, "within_5km").otherwise("farther")


def box_of(text: Column) -> Column:
    """A struct (south, west, north, east) of "west,south,east,north"; null unless it is four finite numbers."""
    parts = F.transform(F.split(text, ",", -1), lambda x: F.trim(x).try_cast("double"))
    sound = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.struct(*[F.get(parts, F.lit(k)).alias(name) for name, k in (("south", 1), ("west", 0), ("north", 3), ("east", 2))]))


def same_coordinates(lat1: Column, lon1: Column, lat2: Column, lon2: Column, tolerance: float = 0.002) -> Column:
    return (F.abs(lat1 - lat2) <= tolerance) & (F.abs(lon1 - lon2) <= tolerance)
