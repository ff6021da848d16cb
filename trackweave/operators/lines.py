"""Lines from route relations, and the corridors that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions import style
from trackweave.functions.text import clean_name, natural_columns, pick_ref
from trackweave.operators.order import numbered

# Kinds of train that a long-distance line's reference begins with.
LONG_DISTANCE_REF = r"(?i)^(ICE|IC|EC|ECE|NJ|EN|RJ|TGV|THA|FLX|D|CNL)\s*\d*"


def classify_mode(route: Column, service: Column, ref: Column, metro: Column | None = None) -> Column:
    """The line's mode; null for what isn't passenger rail. The first test that holds decides."""
    ref, service = F.trim(F.coalesce(ref, F.lit(""))), F.coalesce(service, F.lit(""))
    suburban = ref.rlike(r"(?i)^S\s?\d+") | (service == "commuter")
    if metro is not None:
        suburban = suburban | F.coalesce(metro == "s-bahn", F.lit(False))
    none = F.lit(None).cast("string")
    return (
        F.when(route.isin("subway", "tram"), route)
        .when(route == "light_rail", "suburban")
        .when(~F.coalesce(route, F.lit("")).isin("train", "monorail", "funicular"), none)
        .when(service.isin("high_speed", "long_distance"), "longdistance")
        .when(service.isin("car", "car_shuttle", "motorail"), none)
        .when(suburban, "suburban")
        .when(ref.rlike(LONG_DISTANCE_REF), "longdistance")
        .when(service.isin("regional", "night") | (ref != ""), "regional")
    )


def line_key(mode: Column, network: Column, ref: Column, name: Column) -> Column:
    """mode|network|reference, or the name before its colon where there is no reference."""
    own = pick_ref(ref)
    ident = F.when(own != "", own).otherwise(F.trim(F.get(F.split(F.coalesce(name, F.lit("")), ":"), F.lit(0))))
    return F.lower(F.concat_ws("|", mode, F.coalesce(network, F.lit("")), ident))


def keyed(relations: DataFrame) -> DataFrame:
    """Passenger rail relations with mode and line_id. Columns: ord, id, route, service, ref, network, network_short, name, colour, operator."""
    mode = classify_mode(F.col("route"), F.col("service"), F.col("ref"), F.col("metro") if "metro" in relations.columns else None)
    rows = relations.withColumn("mode", mode).where("mode is not null")
    return rows.withColumn("line_id", line_key(F.col("mode"), F.coalesce("network_short", "network"), F.col("ref"), F.col("name")))


def collapse_lines(relations: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row for each line: what its first relation says, the first usable colour, and how many relations it has.

    colour_source: override (a small table line_id, override and, if it names lines too, name), osm, fallback (by a hash of
    network and reference). Relations without ways count for nothing, where the table has way_ids.
    """
    rows = keyed(relations.where(F.size("way_ids") > 0) if "way_ids" in relations.columns else relations).withColumn("own", style.normalise_colour(F.col("colour")))
    first = lambda col: F.min_by(col, "ord")
    network = F.coalesce("network_short", "network", F.lit(""))
    lines = rows.groupBy("line_id").agg(
        first("mode").alias("mode"), first(pick_ref(F.col("ref"))).alias("ref"), first(clean_name(F.col("name"))).alias("name"), first("operator").alias("operator"),
        first(network).alias("network"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("ord"))).alias("own"), F.count("*").alias("relations"),
    )
    if overrides is not None:
        named = overrides.withColumnRenamed("name", "other_name") if "name" in overrides.columns else overrides.withColumn("other_name", F.lit(None).cast("string"))
        lines = lines.join(F.broadcast(named), "line_id", "left").withColumn("name", F.coalesce("other_name", "name")).drop("other_name")
    else:
        lines = lines.withColumn("override", F.lit(None).cast("string"))
    key = F.when((F.col("network") == "") & (F.col("ref") == ""), "").otherwise(F.concat_ws("|", "network", "ref"))
    source = F.when(F.col("override").isNotNull(), "override").when(F.col("own").isNotNull(), "osm").otherwise("fallback")
    colour = F.coalesce("override", "own", style.fallback_colour(key, F.col("mode")))
    return lines.withColumns({"colour": colour, "colour_source": source}).drop("own", "override")


def line_members(relations: DataFrame, column: str, member: str) -> DataFrame:
    """Distinct members (ways or stops) of each line, over its relations of both directions; relations without ways belong to no line. column: an array of ids."""
    rows = keyed(relations.where(F.size("way_ids") > 0))
    return rows.select("line_id", F.explode(column).alias(member)).distinct()


def lines_per_way(line_ways: DataFrame) -> DataFrame:
    return line_ways.select("line_id", "way_id").distinct().groupBy("way_id").agg(F.count("*").alias("lines"))


def bundle_segments(line_ways: DataFrame) -> DataFrame:
    """Ways that carry the same set of lines: line_ids (sorted) and way_ids (sorted) of each corridor."""
    sets = line_ways.select("line_id", "way_id").distinct().groupBy("way_id").agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"))
    return sets.groupBy("line_ids").agg(F.array_sort(F.collect_list("way_id")).alias("way_ids"))


def slot_ordinals(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """seg_id, line_id, ordinal and slot (places to the side of the middle) in a bundle: by mode, then by reference as people read it."""
    rows = segments.select("seg_id", F.explode("line_ids").alias("line_id")).join(lines.select("line_id", "mode", "ref"), "line_id")
    order = W.partitionBy("seg_id").orderBy(F.desc(style.mode_order(F.col("mode"))), *natural_columns(F.col("ref")), "line_id")
    ranked = rows.withColumn("ordinal", F.row_number().over(order) - 1)
    return ranked.withColumn("slot", F.col("ordinal") - (F.count("*").over(W.partitionBy("seg_id")) - 1) / 2).select("seg_id", "line_id", "ordinal", "slot")


def slot_diagnostics(slots: DataFrame) -> DataFrame:
    """One row: most places that a bundle leaves empty, lines whose slot changes, mean number of slots of a line."""
    gaps = slots.groupBy("seg_id").agg((F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("gap")).agg(F.max("gap").alias("widest_gap"))
    per_line = slots.groupBy("line_id").agg(F.countDistinct("slot").alias("n")).agg(F.count_if(F.col("n") > 1).alias("moving_lines"), F.avg("n").alias("mean_slots"))
    return per_line.join(F.broadcast(gaps), how="inner")


def tile_margin(slots: DataFrame) -> DataFrame:
    widest = slots.agg(F.max(F.abs("slot")).alias("widest"))
    return widest.select("widest", style.band_reach(F.lit(14.0), F.col("widest")).alias("reach"), style.tile_margin(F.col("widest")).cast("long").alias("margin"))


def registry_counts(lines: DataFrame) -> DataFrame:
    """Lines of each mode, and how many have a colour of their own; coach lines don't count for colour."""
    coloured = F.count_if((F.col("colour_source") != "fallback") & (F.col("mode") != "coach"))
    return lines.groupBy("mode").agg(F.count("*").alias("lines"), coloured.alias("coloured"))


def coach_colours(coach: DataFrame) -> DataFrame:
    """Coach lines (line_id, ref, network, mode, colour as the feed gives it) with colour and colour_source: feed, or fallback where it gives none that can be used."""
    own = style.normalise_colour(F.col("colour"))
    source = F.when(own.isNotNull(), "feed").otherwise("fallback")
    return coach.withColumns({"colour_source": source, "colour": F.coalesce(own, style.fallback_colour(F.concat_ws("|", F.coalesce("network", F.lit("")), F.coalesce("ref", F.lit(""))), F.col("mode")))})


def with_coach(rail: DataFrame, coach: DataFrame) -> DataFrame:
    """Rail and coach lines; of equal ids the coach line stays."""
    return rail.join(coach.select("line_id"), "line_id", "left_anti").unionByName(coach, allowMissingColumns=True)


def known_ways(line_ways: DataFrame, ways: DataFrame) -> DataFrame:
    """Members whose way has a geometry."""
    return line_ways.join(ways.select("way_id"), "way_id", "left_semi")


def way_priority(ways: DataFrame) -> DataFrame:
    """The order in which parallel ways are kept: most lines, longest, smallest id."""
    return numbered(ways, [F.desc("lines"), F.desc("metres"), "way_id"], "priority")
