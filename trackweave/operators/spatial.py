"""Spatial joins by grid cell: a cell column turns distance joins into equi joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import CELL, METRES_PER_DEGREE, cell, metres


def near_pairs(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = True, edge: float = CELL, on: list[str] | None = None, spread: str = "left") -> DataFrame:
    """Pairs of rows at most `radius` metres apart, with the distance; columns lon and lat of the right side become r_lon, r_lat.

    One side, better the one with fewer rows, is spread over every cell that its radius can reach, so each pair meets once, in the other row's cell.
    on: further columns that must agree.
    """
    reach_lat = math.ceil(radius / (METRES_PER_DEGREE * edge))
    highest = F.coalesce(F.least(F.lit(89.0), F.abs(F.col("lat")) + radius / METRES_PER_DEGREE), F.lit(0.0))
    reach_lon = F.ceil(radius / (METRES_PER_DEGREE * edge * F.cos(F.radians(highest)))).cast("int")

    def celled(rows: DataFrame, wide: bool) -> DataFrame:
        for name, axis, reach in (("_x", "lon", reach_lon), ("_y", "lat", reach_lat)):
            own = cell(F.col(axis), edge)
            rows = rows.withColumn(name, F.explode(F.sequence(own - reach, own + reach)) if wide else own)
        return rows

    moved, placed = celled(left, spread == "left"), celled(right, spread == "right").withColumnsRenamed({"lon": "r_lon", "lat": "r_lat"})
    joined = moved.join(placed, ["_x", "_y", *(on or [])]).withColumn("distance", metres(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat")))
    return joined.where(F.col("distance") <= radius if inclusive else F.col("distance") < radius).drop("_x", "_y")


def nearest(left: DataFrame, right: DataFrame, key: str, tie: str, radius: float, inclusive: bool = False, edge: float = CELL, on: list[str] | None = None, spread: str = "left") -> DataFrame:
    """For each left row (by key) the nearest right row within the radius, ties to the smaller `tie`; none, no row."""
    pairs = near_pairs(left, right, radius, inclusive, edge, on, spread)
    order = W.partitionBy(key).orderBy("distance", tie)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)
