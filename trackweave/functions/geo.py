"""Distances and directions on longitude and latitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
#: Radius of the sphere that web maps project.
MERCATOR_RADIUS = 6_378_137.0
#: Edge of a grid cell in degrees.
CELL = 0.01


def metres(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Flat distance; longitude shrinks as at the first point."""
    dx = (lon_b - lon_a) * METRES_PER_DEGREE * F.cos(F.radians(lat_a))
    dy = (lat_b - lat_a) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def cell(degrees: Column, edge: float = CELL) -> Column:
    return F.floor(degrees / edge).cast("int")


def mercator_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    lon = F.degrees(x / MERCATOR_RADIUS)
    lat = F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.pi() / 2)
    return lon, lat


def bearing(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Degrees clockwise from north, 0 to 360, on the flat plane."""
    dx = (lon_b - lon_a) * F.cos(F.radians(lat_a))
    return F.pmod(F.degrees(F.atan2(dx, lat_b - lat_a)), F.lit(360.0))


def heading_gap(a: Column, b: Column) -> Column:
    """Smallest angle between two lines, whichever way they run: 0 to 90."""
    turn = F.pmod(a - b, F.lit(180.0))
    return F.least(turn, 180.0 - turn)


def end_direction(coords: Column, at_start: bool, span: float = 25.0) -> Column:
    """x, y of the unit step of a polyline at one of its ends, forwards along it, taken over its first 25 metres or so; zero where it has no length."""
    ordered = coords if at_start else F.reverse(coords)
    near = ordered[0]
    gaps = F.zip_with(F.slice(ordered, 1, F.size(ordered) - 1), F.slice(ordered, 2, F.size(ordered)), lambda p, q: metres(p["lon"], p["lat"], q["lon"], q["lat"]))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(1).alias("i"), F.lit(False).alias("done"))
    walked = F.aggregate(gaps, start, lambda s, g: F.when(s["done"], s).otherwise(F.struct((s["at"] + g).alias("at"), (s["i"] + 1).alias("i"), (s["at"] + g >= span).alias("done"))))
    far = F.element_at(ordered, walked["i"])
    sign = 1.0 if at_start else -1.0
    x, y = (far["lon"] - near["lon"]) * F.cos(F.radians(near["lat"])) * sign, (far["lat"] - near["lat"]) * sign
    size = F.hypot(x, y)
    return F.struct(F.when(size > 0, x / size).otherwise(0.0).alias("x"), F.when(size > 0, y / size).otherwise(0.0).alias("y"))


def across(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, heading: Column) -> Column:
    """Metres that b lies from a across a corridor of that heading."""
    theta = F.radians(90 - heading)
    east, north = (lon_b - lon_a) * METRES_PER_DEGREE * F.cos(F.radians(lat_a)), (lat_b - lat_a) * METRES_PER_DEGREE
    return F.abs(north * F.cos(theta) - east * F.sin(theta))


def opposed(a: Column, b: Column) -> Column:
    turn = F.pmod(a - b, F.lit(360.0))
    return F.least(turn, 360.0 - turn) > 90


def interpolated(stops: list[tuple[float, float]], at: Column) -> Column:
    """A table of (place, value) read with straight lines between, constant beyond its ends."""
    out = F.when(at <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:]):
        out = out.when(at <= x1, y0 + (y1 - y0) * (at - x0) / (x1 - x0))
    return out.otherwise(F.lit(float(stops[-1][1])))


def half_up(col: Column, digits: int = 0) -> Column:
    """Rounded with halves going up, as on doubles."""
    f = 10.0**digits
    return F.floor(col * f + 0.5) / f
