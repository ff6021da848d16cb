"""What a reader of the map sees: filters, counts in view, searches, lists in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions import style
from trackweave.functions.text import normalise_ref, ref_sort_columns
from trackweave.operators.order import numbered
from trackweave.operators.spatial import within_box

LINE_HITS, STATION_HITS, LEAST_QUERY, NEXT = 6, 8, 2, 6
# Modes of a departure that count as rail.
RAIL_RESPONSE = ("HIGHSPEED_RAIL", "LONG_DISTANCE", "REGIONAL_RAIL", "SUBURBAN", "METRO", "TRAM", "SUBWAY")


def operator_filter(lines: DataFrame, names: list[str], allow: bool) -> DataFrame:
    """Lines of the named operators, or of all others; a missing operator has the name ''."""
    among = F.coalesce("operator", F.lit("")).isin(*names) if names else F.lit(False)
    return lines.where(among if allow else ~among)


def served_by_modes(stations: DataFrame, modes: list[str]) -> DataFrame:
    """Stations with a line of one of the modes. modes is an array column."""
    return stations.where(F.exists("modes", lambda m: m.isin(*modes)))


def drawn(mode: Column, zoom: float) -> Column:
    """Whether a line's mode is drawn at a zoom."""
    return style.lookup(mode, {m: v[1] for m, v in style.MODES.items()}) <= zoom


def in_view(lines: DataFrame, points: DataFrame, box: tuple[float, float, float, float], zoom: float) -> DataFrame:
    """Distinct lines with a point in the box whose mode is drawn. points: line_id, lon, lat."""
    seen = points.where(within_box(F.col("lon"), F.col("lat"), box)).select("line_id").distinct()
    return lines.where(drawn(F.col("mode"), zoom)).join(seen, "line_id", "left_semi")


def lines_in_view(seen: DataFrame) -> DataFrame:
    return seen.groupBy("mode").agg(F.countDistinct("line_id").alias("lines"))


def operators_in_view(seen: DataFrame, modes: list[str]) -> DataFrame:
    """Of the modes that are on; lines without an operator aren't counted."""
    return seen.where(F.col("mode").isin(*modes)).where(F.coalesce("operator", F.lit("")) != "").groupBy("operator").agg(F.countDistinct("line_id").alias("lines"))


def index_order(lines: DataFrame) -> DataFrame:
    """place from 1: by mode, then reference prefix, number and rest."""
    return numbered(lines, [F.desc(style.mode_order(F.col("mode"))), *ref_sort_columns(F.col("ref")), "line_id"], "place")


def visible_lines(seen: DataFrame, modes: list[str], names: list[str], allow: bool, selected: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Lines that pass both filters and are in view or selected, in index order. A selection counts while its line passes both."""
    rows = seen
    if selected is not None and lines is not None:
        rows = seen.unionByName(lines.join(selected, "line_id", "left_semi")).dropDuplicates(["line_id"])
    return index_order(operator_filter(rows.where(F.col("mode").isin(*modes)), names, allow))


def search(queries: DataFrame, rows: DataFrame, columns: list[str], key: str, most: int) -> DataFrame:
    """query, rank and row of the first `most` rows (by key) of which a column holds the query; queries of one character find nothing.

    Queries and rows meet by a query's first two characters, so that no query is held against all rows.
    """
    asked = queries.select("query").where(F.length(F.trim("query")) >= LEAST_QUERY).distinct().withColumn("_asked", F.lower(F.trim("query")))
    asked = asked.withColumn("_pair", F.substring("_asked", 1, 2))
    texts = rows.withColumn("_text", F.lower(F.concat_ws("\n", *columns)))
    places = F.sequence(F.lit(1), F.greatest(F.length("_text") - 1, F.lit(1)))
    pairs = texts.withColumn("_pair", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("_text"), i, F.lit(2))))))
    hits = pairs.join(asked, "_pair").where(F.col("_text").contains(F.col("_asked"))).drop("_pair", "_text", "_asked")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(key))).where(F.col("rank") <= most)


def next_departures(board: DataFrame, n: int = NEXT, modes: tuple[str, ...] | None = None) -> DataFrame:
    """The n soonest rows of each stop. Rows without a mode of rail are dropped, if modes are given."""
    rows = board if modes is None else board.where(F.col("mode").isin(*modes))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("stop").orderBy("scheduled", "departure_id"))).where(F.col("rank") <= n)


def departure_colour(board: DataFrame, lines: DataFrame, served: DataFrame) -> DataFrame:
    """Each row with the colour of the line of its reference (the smallest id of several) among those of its stop, else the feed's own."""
    own = served.join(lines.select("line_id", normalise_ref(F.col("ref")).alias("_ref"), "colour"), "line_id").groupBy("stop", "_ref").agg(F.min_by("colour", "line_id").alias("_colour"))
    joined = board.withColumn("_ref", normalise_ref(F.col("ref"))).join(own, ["stop", "_ref"], "left")
    return joined.withColumn("colour", F.coalesce("_colour", "feed_colour")).drop("_ref", "_colour")


def station_records(served: DataFrame, lines: DataFrame) -> DataFrame:
    """station_id, place from 1 and line_id of the lines that call at each station, in index order; ids of no known line are dropped."""
    rows = served.select("station_id", "line_id").distinct().join(lines.select("line_id", "mode", "ref"), "line_id")
    order = W.partitionBy("station_id").orderBy(F.desc(style.mode_order(F.col("mode"))), *ref_sort_columns(F.col("ref")), "line_id")
    return rows.withColumn("place", F.row_number().over(order)).select("station_id", "place", "line_id")


def envelope(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def closures_in_view(closures: DataFrame, box: tuple[float, float, float, float], zoom: float, tiers: dict[str, float]) -> DataFrame:
    """Distinct closures by effect whose point lies in the box, of effects drawn at the zoom."""
    shown = style.lookup(F.col("effect"), tiers) <= zoom
    return closures.where(within_box(F.col("lon"), F.col("lat"), box) & shown).groupBy("effect").agg(F.countDistinct("id").alias("closures"))
