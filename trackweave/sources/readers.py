"""Scans: route relations, features, delays by month, register readings, event logs, timetable feeds, small tables."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators.graph import settled

DELAY_COLUMNS = ("station_name", "line_number", "train_type", "departure_is_canceled", "departure_planned_time", "departure_change_time", "train_line_ride_id")
FEATURE = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
EVENT = "t date, e string, id string, seq bigint, begin_day date, end_day date, effect string"
READING = "id string, effect string, begin_day date, end_day date, refs array<int>"
# What is kept of map elements, by key and value.
KEPT = {
    "relation": {"type": ("route", "route_master")},
    "way": {"railway": ("rail", "light_rail", "subway", "tram", "narrow_gauge", "funicular", "monorail")},
    "station": {"railway": ("station", "halt", "tram_stop"), "public_transport": ("station",)},
    "stop": {"public_transport": ("stop_position",)},
    "place": {"place": ("city", "town")},
}
FEEDS = {
    "routes": "agency_id string, route_id string, route_short_name string, route_long_name string, route_type int, route_color string",
    "trips": "route_id string, trip_id string, shape_id string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, stop_code string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def unescaped(col: Column) -> Column:
    """%hex% stands for a code point; every second part of the text between percent signs is one, if it is hex."""
    parts = F.split(col, "%", -1)
    char = lambda x: F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & x.rlike("^[0-9a-fA-F]{1,8}$"), char(x)).otherwise(x)), "")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, tags, way_ids and stop_ids of the route relations of a line-oriented extract.

    A line beginning with r is a relation; its field T holds tags, M members. Ways count with role empty, forward or
    backward, nodes with a role that begins with stop. Relations without a type are dropped. Members keep their order.
    """
    lines = spark.read.text(path).where(F.col("value").startswith("r")).withColumn("ord", F.monotonically_increasing_id())
    fields = F.split("value", " ")
    field = lambda kind: F.coalesce(F.get(F.filter(F.slice(fields, 2, F.size(fields)), lambda x: x.startswith(kind)), F.lit(0)), F.lit(kind))
    pairs = F.filter(F.split(F.substring(field("T"), 2, 1 << 30), ","), lambda x: F.instr(x, "=") > 0)
    tags = F.map_from_entries(F.transform(pairs, lambda x: F.struct(unescaped(F.substring_index(x, "=", 1)).alias("key"), unescaped(F.regexp_replace(x, "^[^=]*=", "")).alias("value"))))
    members = F.transform(F.filter(F.split(F.substring(field("M"), 2, 1 << 30), ","), lambda x: x != ""), lambda x: F.struct(F.when(F.instr(x, "@") > 0, F.regexp_extract(x, "^(.*)@", 1)).otherwise(x).alias("ref"), F.when(F.instr(x, "@") > 0, unescaped(F.substring_index(x, "@", -1))).otherwise("").alias("role")))
    ids = lambda test: F.transform(F.filter("members", test), lambda m: F.substring(m["ref"], 2, 1 << 30))
    rows = lines.select("ord", F.substring(fields[0], 2, 1 << 30).alias("id"), tags.alias("tags"), members.alias("members"))
    ways = ids(lambda m: m["ref"].startswith("w") & m["role"].isin("", "forward", "backward"))
    stops = ids(lambda m: m["ref"].startswith("n") & m["role"].startswith("stop"))
    return rows.where(F.coalesce(F.col("tags")["type"], F.lit("")) != "").select("ord", "id", "tags", ways.alias("way_ids"), stops.alias("stop_ids"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a file of one JSON object a line, with or without record separators; blank and broken lines are passed over."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\u001e", "")).alias("v")).where("v <> ''")
    return lines.select(F.from_json("v", FEATURE).alias("f")).select("f.*").where("type = 'Feature'")


def line_features(features: DataFrame) -> DataFrame:
    """way_id, coords and tags of the features that are ways drawn as lines."""
    coords = F.transform(F.from_json("geometry.coordinates", "array<array<double>>"), lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
    return features.where("geometry.type = 'LineString' and id like 'w%'").select(F.substring("id", 2, 40).alias("way_id"), coords.alias("coords"), F.col("properties").alias("tags"))


def point_features(features: DataFrame, named: bool = True) -> DataFrame:
    """id, lon, lat, name and tags of point features; only those with a name, if asked."""
    c = F.from_json("geometry.coordinates", "array<double>")
    rows = features.where("geometry.type = 'Point'").select("id", c[0].alias("lon"), c[1].alias("lat"), F.col("properties")["name"].alias("name"), F.col("properties").alias("tags"))
    return rows.where("name is not null and name <> ''") if named else rows


def select_elements(elements: DataFrame, kind: str) -> DataFrame:
    """Elements (tags) of a kind: relation, way, station, stop, place."""
    keep = F.lit(False)
    for key, values in KEPT[kind].items():
        keep = keep | F.coalesce(F.col("tags")[key].isin(*values), F.lit(False))
    return elements.where(keep)


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and coords in order, of way_id and node_refs; nodes (node_id, lon, lat) that aren't there are left out."""
    refs = ways.select("way_id", F.posexplode("node_refs").alias("pos", "node_id"))
    placed = refs.join(nodes, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    return placed.select("way_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coords"))


def read_delays(spark: SparkSession, path: str, months: int = 12) -> DataFrame:
    """The seven columns that are used, of the last months, from a folder partitioned by month."""
    rows = spark.read.parquet(path).select("month", *DELAY_COLUMNS)
    last = rows.select("month").distinct().orderBy(F.desc("month")).limit(months)
    return rows.join(F.broadcast(last), "month", "left_semi")


def read_register(spark: SparkSession, path: str, schema: str = READING) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_readings(spark: SparkSession, path: str, days: DataFrame | None = None, horizon: int | None = None, schema: str = READING) -> DataFrame:
    """Readings of the register from a folder with a part for each reading_day (as sinks.write_reading leaves it).

    days: a table with column reading_day; only those parts are read, as the join prunes partitions. horizon: only
    records whose envelope overlaps the reading's day and so many days after it.
    """
    rows = spark.read.schema(f"{schema}, reading_day date").parquet(path)
    if days is not None:
        rows = rows.join(F.broadcast(days.select("reading_day").distinct()), "reading_day")
    if horizon is not None:
        rows = rows.where((F.col("begin_day") <= F.date_add("reading_day", horizon)) & (F.col("end_day") >= F.col("reading_day")))
    return rows


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log of one JSON object a line; blank lines are passed over."""
    return spark.read.schema(EVENT).json(path).where("id is not null")


def read_feed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a timetable feed: quoted commas, doubled quotes, empty fields at the ends. Columns are found by name."""
    path = f"{folder}/{table}.txt"
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    schema = T.StructType.fromDDL(FEEDS[table])
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: What Spark calls a source that isn't there or can't be read.
UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "MALFORMED_RECORD_IN_PARSING")


def optional(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The source, or an empty table where it isn't there or can't be read.

    A broken file shows when it is read, not when the query is planned: so the source is read here, once, and
    what it holds is written to the shared folder. Errors of any other kind are raised. For sources of a layer of their own, not for facts.
    """
    try:
        return settled(read())
    except (PySparkException, Py4JJavaError) as e:
        if not isinstance(e, AnalysisException) and not any(x in str(e) for x in UNREADABLE):
            raise
        return spark.createDataFrame([], schema)


def strict_register(spark: SparkSession, path: str, schema: str = READING) -> DataFrame:
    """read_register, of which a truncated or malformed document is an error and not a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def region(regions: dict[str, dict], name: str) -> tuple[float, float, float, float]:
    """The box of a region; an unknown one is an error."""
    if name not in regions:
        raise KeyError(f"unknown region {name}; there are {', '.join(sorted(regions))}")
    return tuple(regions[name]["bbox"])
