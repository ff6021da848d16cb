"""Stored journeys: legs, changes between trains, fares, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.text import badge

# Modes of a leg that are public transport; of cycling; of rail at a place's stop; of fares.
TRANSIT = ("HIGHSPEED_RAIL", "LONG_DISTANCE", "NIGHT_RAIL", "REGIONAL_FAST_RAIL", "REGIONAL_RAIL", "SUBURBAN", "METRO", "SUBWAY", "TRAM", "BUS", "COACH", "FERRY", "AIRPLANE", "RAIL", "TRANSIT")
BIKE = ("BIKE", "RENTAL", "BIKE_RENTAL")
RAIL = ("HIGHSPEED_RAIL", "LONG_DISTANCE", "REGIONAL_RAIL", "SUBURBAN", "NIGHT_RAIL")
FARES = {"regional": ("REGIONAL_RAIL", "SUBURBAN"), "ticket": ("REGIONAL_RAIL", "SUBURBAN", "SUBWAY", "TRAM", "BUS", "FERRY")}
PLACE_HITS = 8


def is_transit(mode: Column) -> Column:
    return F.coalesce(mode.isin(*TRANSIT), F.lit(False))


def itinerary_rollup(legs: DataFrame) -> DataFrame:
    """bike_seconds, seconds, direct (no transit leg) and transfers of each journey."""
    transit = F.count_if(is_transit(F.col("mode")))
    bike = F.coalesce(F.sum(F.when(F.col("mode").isin(*BIKE), F.col("seconds"))), F.lit(0))
    return legs.groupBy("journey_id").agg(bike.alias("bike_seconds"), F.sum("seconds").alias("seconds"), (transit == 0).alias("direct"), F.greatest(transit - 1, F.lit(0)).alias("transfers"), F.min("scheduled").alias("start"))


def interchanges(legs: DataFrame) -> DataFrame:
    """Changes between transit legs that follow one another: number, both leg indices, label, walking seconds and midpoint.

    What lies between are the connecting legs; legs before the first and after the last transit leg are no change.
    """
    order = W.partitionBy("journey_id").orderBy("idx")
    marked = legs.withColumns({"_transit": is_transit(F.col("mode")), "_walk": F.when(F.col("mode") == "WALK", F.col("seconds")).otherwise(0)})
    running = marked.withColumn("_walked", F.sum("_walk").over(order))
    transit = running.where("_transit")
    back = lambda c: F.lag(c).over(order)
    pairs = transit.select(
        "journey_id", F.col("idx").alias("departure_idx"), back("idx").alias("arrival_idx"), (F.col("_walked") - back("_walked")).alias("walking_seconds"),
        back("to_name").alias("_arrival"), F.col("from_name").alias("_departure"), ((back("lon") + F.col("lon")) / 2).alias("lon"), ((back("lat") + F.col("lat")) / 2).alias("lat"), (F.row_number().over(order) - 1).alias("number"),
    )
    label = F.when(F.col("_arrival") == F.col("_departure"), F.col("_arrival")).otherwise(F.concat("_arrival", F.lit(" → "), "_departure"))
    return pairs.where("arrival_idx is not null").withColumn("label", label).drop("_arrival", "_departure")


def journey_order(rolled: DataFrame) -> DataFrame:
    """place from 1 among the journeys of a day: by start, direct rides last."""
    order = W.partitionBy(F.to_date("start")).orderBy("direct", "start", "journey_id")
    return rolled.withColumn("place", F.row_number().over(order))


def fare_filter(legs: DataFrame, fare: str) -> DataFrame:
    """Ids of the journeys whose transit legs all have a mode that the fare covers; any covers all."""
    journeys = legs.select("journey_id").distinct()
    if fare == "any":
        return journeys
    outside = legs.where(is_transit(F.col("mode")) & ~F.col("mode").isin(*FARES[fare])).select("journey_id").distinct()
    return journeys.join(outside, "journey_id", "left_anti")


def normalised_legs(legs: DataFrame) -> DataFrame:
    """Legs with transit flag, label without trip number, actual times that fall back to the scheduled ones, bikes true or null and, where the table has reservation, whether one is compulsory."""
    out = legs.withColumns({"transit": is_transit(F.col("mode")), "label": badge(F.col("line")), "actual": F.coalesce("actual", "scheduled"), "bikes": F.when(F.col("bikes"), True)})
    return out.withColumn("reservation_required", F.coalesce(F.col("reservation") == "COMPULSORY", F.lit(False))) if "reservation" in legs.columns else out


def journey_features(legs: DataFrame) -> DataFrame:
    """Features to draw: legs by kind (transit, bike, walk), one point for each change and one for each end of a journey."""
    kind = F.when(is_transit(F.col("mode")), "transit").when(F.col("mode").isin(*BIKE), "bike").otherwise("walk")
    lines = legs.select("journey_id", kind.alias("kind"), "idx", "lon", "lat")
    changes = interchanges(legs).select("journey_id", F.lit("interchange").alias("kind"), F.col("departure_idx").alias("idx"), "lon", "lat")
    last = legs.groupBy("journey_id").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    ends = legs.join(last, "journey_id")
    start = ends.where("idx = a").select("journey_id", F.lit("start").alias("kind"), "idx", "lon", "lat")
    stop = ends.where("idx = b").select("journey_id", F.lit("end").alias("kind"), "idx", "lon", "lat")
    return lines.unionByName(changes).unionByName(start).unionByName(stop)


def main_station_first(hits: DataFrame, most: int = PLACE_HITS) -> DataFrame:
    """query, place and id: if the first hit is a settlement whose name begins with the query, its preferred rail stop goes to the front.

    Preferred: in the same country and area, one named a main station if there is any. Columns: query, rank, id, type, category, name, country, area, rail.
    """
    per_query = W.partitionBy("query")
    first = F.struct("type", "category", "name", "country", "area")
    rows = hits.withColumn("top", F.min_by(first, "rank").over(per_query))
    settled = (F.col("top.type") == "PLACE") & F.coalesce(F.col("top.category"), F.lit("")).rlike("^(place_|city$|town$|village$|hamlet$)") & F.lower("top.name").startswith(F.lower(F.trim("query")))
    fits = settled & (F.col("type") == "STOP") & F.col("id").isNotNull() & (F.col("country") == F.col("top.country")) & (F.col("area") == F.col("top.area")) & F.col("rail")
    main = F.lower("name").rlike(r"\b(hbf|hauptbahnhof)\b")
    rows = rows.withColumn("_fit", F.when(fits, F.struct(F.when(main, 0).otherwise(1).alias("m"), "rank")))
    best = F.min("_fit").over(per_query)
    rows = rows.withColumn("_front", F.when(F.col("_fit") == best, 0).otherwise(1))
    placed = rows.withColumn("place", F.row_number().over(per_query.orderBy("_front", "rank")))
    return placed.where(F.col("place") <= most).select("query", "place", "id")
