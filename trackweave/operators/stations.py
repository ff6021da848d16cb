"""Stations, the stops that belong to them and the lines that call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import style
from trackweave.operators.spatial import nearest

SNAP, COACH_SNAP = 300.0, 400.0
# Words for a town's main station.
MAIN_STATION = r"\b(Hbf|Hauptbahnhof)\b"


def resolve_stops(stops: DataFrame, stations: DataFrame, radius: float = SNAP) -> DataFrame:
    """stop_id, how (exact, nearest, unmatched), station_id: by the id that the stop names, else the nearest station closer than the radius, ties to the smaller id.

    Columns: stop_id, lon, lat, station_ref; station_id, lon, lat.
    """
    places = stations.select("station_id", "lon", "lat")
    named = stops.join(places.select(F.col("station_id").alias("station_ref")), "station_ref", "left_semi").select("stop_id", F.lit("exact").alias("how"), F.col("station_ref").alias("station_id"))
    rest = stops.join(named.select("stop_id"), "stop_id", "left_anti")
    snapped = nearest(rest.select("stop_id", "lon", "lat"), places, "stop_id", "station_id", radius).select("stop_id", F.lit("nearest").alias("how"), "station_id")
    found = named.unionByName(snapped)
    return stops.select("stop_id").join(found, "stop_id", "left").select("stop_id", F.coalesce("how", F.lit("unmatched")).alias("how"), "station_id")


def attach_coach_stops(stops: DataFrame, stations: DataFrame, radius: float = COACH_SNAP) -> DataFrame:
    """stop_id and station_id of the station within the radius (inclusive), or a station of its own, `coach-` and the stop's id."""
    found = nearest(stops.select("stop_id", "lon", "lat"), stations.select("station_id", "lon", "lat"), "stop_id", "station_id", radius, inclusive=True)
    joined = stops.select("stop_id").join(found.select("stop_id", F.col("station_id").cast("string").alias("near")), "stop_id", "left")
    return joined.select("stop_id", F.coalesce("near", F.concat(F.lit("coach-"), F.col("stop_id").cast("string"))).alias("station_id"), F.col("near").isNull().alias("own"))


def rollup(stations: DataFrame, served: DataFrame, lines: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Each station with n_lines, modes (sorted), coach_only and major, and pill (a bar lies across a corridor) where those marks are given; unserved ones stay. served: station_id, line_id."""
    calls = served.select("station_id", "line_id").distinct().join(lines.select("line_id", "mode"), "line_id")
    sums = calls.groupBy("station_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_set("mode")).alias("modes"))
    out = stations.join(sums, "station_id", "left").withColumns({"n_lines": F.coalesce("n_lines", F.lit(0)), "modes": F.coalesce("modes", F.array().cast("array<string>"))})
    coach_only = (F.size("modes") > 0) & F.forall("modes", lambda m: m == "coach")
    out = out.withColumns({"coach_only": coach_only, "major": F.col("name").rlike(MAIN_STATION)})
    if marks is None:
        return out
    drawn = marks.select("station_id", F.lit(True).alias("pill")).distinct()
    return out.join(drawn, "station_id", "left").withColumn("pill", F.coalesce("pill", F.lit(False)))


def ranked(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("rank", style.stop_rank(F.col("modes"), F.col("n_lines"), F.col("major")))


def rank_counts(ranked_: DataFrame) -> DataFrame:
    return ranked_.groupBy("rank").agg(F.count("*").alias("stations"), F.count_if(F.col("n_lines") == 0).alias("orphans"))


def line_station_names(served: DataFrame, stations: DataFrame) -> DataFrame:
    """Sorted distinct names of the stations that each line calls at."""
    return served.join(stations.select("station_id", "name"), "station_id").groupBy("line_id").agg(F.sort_array(F.collect_set("name")).alias("stations"))


def marks_by_tier(ranked_: DataFrame) -> DataFrame:
    """Each station with the lowest zooms of its mark and label, and the tile zoom of its mark."""
    mark = style.lookup(F.col("rank"), {k: v[0] for k, v in style.STOP_TIERS.items()})
    label = style.lookup(F.col("rank"), {k: v[1] for k, v in style.STOP_TIERS.items()})
    return ranked_.withColumns({"mark_zoom": mark, "label_zoom": label, "min_zoom": F.floor(mark).cast("int")})


def valid_place(name: Column, kind: Column, lon: Column, lat: Column) -> Column:
    """A named town or city at a real position."""
    finite = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.coalesce((F.trim(name) != "") & kind.isin("city", "town") & finite, F.lit(False))


def population(col: Column) -> Column:
    """A whole number, or 0."""
    return F.when(col.rlike(r"^\d+$"), F.coalesce(col.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0))


def places(rows: DataFrame) -> DataFrame:
    return rows.where(valid_place(F.col("name"), F.col("kind"), F.col("lon"), F.col("lat"))).withColumn("population", F.coalesce(population(F.col("population")), F.lit(0)))
