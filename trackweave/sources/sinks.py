"""Outputs: feature lines, tiers, registries, scores, states, logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators.graph import settled
from trackweave.operators.order import numbered


def feature(geometry: str, coordinates: Column, *properties: str) -> Column:
    """One feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_features(rows: DataFrame, path: str, geometry: str, coordinates: Column, *properties: str) -> None:
    rows.select(feature(geometry, coordinates, *properties).alias("value")).write.mode("overwrite").text(path)


def write_tiers(rows: DataFrame, path: str) -> None:
    """One folder for each lowest zoom (column min_zoom)."""
    rows.write.mode("overwrite").partitionBy("min_zoom").parquet(path)


def write_registry(lines: DataFrame, path: str) -> None:
    """Lines sorted by id, as JSON lines."""
    lines.orderBy("line_id").write.mode("overwrite").json(path)


def write_line_stations(names: DataFrame, path: str) -> None:
    """One row for each line with its sorted station names."""
    names.select("line_id", F.array_sort("stations").alias("stations")).write.mode("overwrite").json(path)


def publish(rows: DataFrame, folder: str) -> str:
    """All or nothing: a new run is written beside the others, then named in the pointer, which readers follow."""
    spark, run = rows.sparkSession, f"run-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{run}")
    order = spark.read.parquet(f"{folder}/pointer").count() if exists(spark, f"{folder}/pointer") else 0
    spark.createDataFrame([(order, run)], "n long, run string").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return run


def published(spark: SparkSession, folder: str) -> DataFrame:
    run = spark.read.parquet(f"{folder}/pointer").orderBy(F.desc("n")).first()["run"]
    return spark.read.parquet(f"{folder}/{run}")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def carry_state(old: DataFrame, new: DataFrame, folder: str) -> DataFrame:
    """A new version of a state table, beside the old one: new rows, and old ones of other stations."""
    kept = old.join(new.select("station_id"), "station_id", "left_anti").unionByName(new)
    publish(kept.orderBy("station_id"), folder)
    return published(old.sparkSession, folder)


def append_log(events: DataFrame, path: str) -> int:
    """Adds events to the log in order of ranges, so that files and rows in them follow t, id and e; none, and nothing is written. The plan runs once."""
    held = settled(events)
    count = held.count()
    if count:
        held.orderBy("t", "id", "e").write.mode("append").json(path)
    return count


def write_reading(rows: DataFrame, path: str) -> None:
    """Readings of the register, a part for each reading_day; a day that is written again replaces its part and no other."""
    rows.repartition("reading_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reading_day").parquet(path)


def in_chunks(work: DataFrame, key: str, resolve: Callable[[DataFrame], DataFrame], folder: str, rows: int = 100) -> DataFrame:
    """resolve over a work list, so many rows at a time; a run that is broken off goes on after the last whole chunk.

    The list is numbered by its key and written first; every run of one folder works on that list. A chunk's results
    are there when its part is whole, and they alone say what has been done. resolve gets rows of the list and must give
    the same for a chunk that is tried again.
    """
    spark, plan, done = work.sparkSession, f"{folder}/work", f"{folder}/done"
    if not exists(spark, f"{plan}/_SUCCESS"):
        listed = numbered(work, [key], "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / rows)).drop("_place")
        listed.write.mode("overwrite").partitionBy("chunk").parquet(plan)
    listed = spark.read.schema(T.StructType([*work.schema.fields, T.StructField("chunk", T.LongType())])).parquet(plan)
    last = listed.agg(F.max("chunk")).first()[0]
    for n in range(0 if last is None else last + 1):
        if not exists(spark, f"{done}/chunk={n}/_SUCCESS"):
            resolve(listed.where(F.col("chunk") == n).drop("chunk")).write.mode("overwrite").parquet(f"{done}/chunk={n}")
    return resolve(listed.drop("chunk").limit(0)) if last is None else spark.read.parquet(done).drop("chunk")


def write_summary(lines: DataFrame, stations: DataFrame, path: str) -> None:
    """One row beside the registry: lines by mode, stations, and the share of lines (coaches aside) whose colour the source gives."""
    told = F.count_if((F.col("mode") != "coach") & (F.col("colour_source") == "osm"))
    counts = lines.groupBy("mode").agg(F.count("*").alias("n"), told.alias("told"))
    whole = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("lines"), F.sum(F.when(F.col("mode") != "coach", F.col("n"))).alias("rail"), F.sum("told").alias("told"))
    row = whole.join(stations.agg(F.count("*").alias("stations"))).select("lines", "stations", F.when(F.col("rail") > 0, F.col("told") / F.col("rail")).alias("colour_coverage"))
    row.write.mode("overwrite").json(path)


def write_places(places: DataFrame, path: str) -> None:
    write_features(places, path, "Point", F.array("lon", "lat"), "name", "kind", "population")
