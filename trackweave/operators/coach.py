"""Coach lines from a timetable feed: modal shapes, gaps, clipping, calling order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import metres

GAP_METRES = 25_000.0


def modal_shape(trips: DataFrame) -> DataFrame:
    """The shape that most trips of a route run, ties to the smaller id, and its first trip."""
    sums = trips.groupBy("route_id", "shape_id").agg(F.count("*").alias("trips"), F.min("trip_id").alias("trip_id"))
    order = W.partitionBy("route_id").orderBy(F.desc("trips"), "shape_id")
    return sums.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def split_gaps(points: DataFrame, gap: float = GAP_METRES) -> DataFrame:
    """Points of shapes (shape_id, seq, lon, lat) with the part they belong to: a new one behind every step longer than the gap."""
    order = W.partitionBy("shape_id").orderBy("seq")
    step = metres(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))
    return points.withColumn("_cut", F.when(step > gap, 1).otherwise(0)).withColumn("part", F.sum("_cut").over(order)).drop("_cut")


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """Where the segment enters and leaves the box, as shares of its length; null if it doesn't pass through."""
    west, south, east, north = box
    dx, dy = x1 - x0, y1 - y0
    enter, leave, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for d, lo, hi in ((dx, west - x0, east - x0), (dy, south - y0, north - y0)):
        a, b = lo / F.nullif(d, F.lit(0.0)), hi / F.nullif(d, F.lit(0.0))
        inside = inside & F.when(d == 0, (lo <= 0) & (hi >= 0)).otherwise(True)
        enter = F.greatest(enter, F.when(d != 0, F.least(a, b)).otherwise(0.0))
        leave = F.least(leave, F.when(d != 0, F.greatest(a, b)).otherwise(1.0))
    return F.when(inside & (enter < leave), F.struct(enter.alias("enter"), leave.alias("leave")))


def clip(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points of each shape part inside the box, by run: what leaves and comes back is two runs; a touched corner is none, an edge is.

    Input: shape_id, part, seq, lon, lat. Output: shape_id, part, run, n, lon, lat.
    """
    order = W.partitionBy("shape_id", "part").orderBy("seq")
    ends = points.select("shape_id", "part", "seq", "lon", "lat", F.lead("lon").over(order).alias("x1"), F.lead("lat").over(order).alias("y1")).where("x1 is not null")
    cut = ends.withColumn("c", clip_segment(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), box)).withColumn("_in", F.col("c").isNotNull())
    begins = F.col("_in") & ~F.coalesce(F.lag("_in").over(order) & (F.lag("c.leave").over(order) == 1.0) & (F.col("c.enter") == 0.0), F.lit(False))
    runs = cut.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(order)).withColumn("_first", begins).where("_in")
    at = lambda t: F.struct((F.col("lon") + (F.col("x1") - F.col("lon")) * t).alias("lon"), (F.col("lat") + (F.col("y1") - F.col("lat")) * t).alias("lat"))
    both = runs.withColumn("p", F.explode(F.when(F.col("_first"), F.array(at(F.col("c.enter")), at(F.col("c.leave")))).otherwise(F.array(at(F.col("c.leave"))))))
    number = W.partitionBy("shape_id", "part", "run").orderBy("seq", F.when(F.col("_first") & (F.col("p") == at(F.col("c.enter"))), 0).otherwise(1))
    return both.withColumn("n", F.row_number().over(number)).select("shape_id", "part", "run", "n", "p.lon", "p.lat")


def calling_order(modal: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Each route's stops in order, along the first trip of its modal shape: route_id, n, stop_id."""
    calls = modal.select("route_id", "trip_id").join(stop_times, "trip_id").select("route_id", "stop_sequence", "stop_id").distinct()
    return calls.withColumn("n", F.row_number().over(W.partitionBy("route_id").orderBy("stop_sequence", "stop_id"))).select("route_id", "n", "stop_id")


def lines_per_stop(lines: DataFrame) -> DataFrame:
    """stop_id and the sorted ids of the coach lines that call there. lines: line_id, stops (array)."""
    return lines.select("line_id", F.explode("stops").alias("stop_id")).groupBy("stop_id").agg(F.sort_array(F.collect_set("line_id")).alias("lines"))


def coach_lines(routes: DataFrame, trips: DataFrame, points: DataFrame, stop_times: DataFrame, agencies: list[str], box: tuple[float, float, float, float], prefix: str = "") -> DataFrame:
    """Lines of the kept agencies: line_id, ref, colour, parts inside the box and stops in order. Routes without a part in the box are dropped.

    routes: agency_id, route_id, route_short_name, route_color.
    """
    own = routes.where(F.col("agency_id").isin(*agencies))
    modal = modal_shape(trips.join(own.select("route_id"), "route_id", "left_semi"))
    shapes = points.join(modal.select("shape_id").distinct(), "shape_id", "left_semi")
    inside = clip(split_gaps(shapes), box).groupBy("shape_id").agg(F.countDistinct("part", "run").alias("parts"), F.count("*").alias("points"))
    stops = calling_order(modal, stop_times).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("n", "stop_id"))).alias("calls"))
    ref = F.trim(F.regexp_replace("route_short_name", f"^{prefix}\\s*" if prefix else "^$", ""))
    colour = F.when(F.col("route_color").rlike("(?i)^[0-9a-f]{6}$"), F.concat(F.lit("#"), F.lower("route_color")))
    lines = own.join(modal.select("route_id", "shape_id"), "route_id").join(inside, "shape_id").join(stops, "route_id", "left")
    return lines.select(F.lower(F.concat_ws("|", F.lit("coach"), "agency_id", ref)).alias("line_id"), "route_id", ref.alias("ref"), colour.alias("colour"), "parts", "points", F.transform("calls", lambda c: c["stop_id"]).alias("stops"))
