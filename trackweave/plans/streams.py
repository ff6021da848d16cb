"""The streaming jobs over derived tables; each must give what its batch form gives."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import punctuality as p
from trackweave.operators.graph import settled
from trackweave.plans import closures as c
from trackweave.plans import punctuality as q
from trackweave.plans.views import ctes, frame
from trackweave.streaming import jobs


def _stream(rows: DataFrame, batches: int) -> DataFrame:
    """rows written as files of bounded size and read as a stream, about so many micro-batches of them; one is always whole."""
    spark, path = rows.sparkSession, jobs.folder(rows.sparkSession)
    rows.hint("rebalance").write.parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    if files < batches:  # few rows
        path, files = jobs.folder(spark), batches
        rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, math.ceil(files / batches))).parquet(path)


def stream_log_replay(spark, sf_dir):
    return jobs.log_replay(_stream(frame(spark, sf_dir, "v_log"), 4)).withColumn("n_moves", F.size("moves")).drop("moves")


def stream_plan_diff(spark, sf_dir):
    return jobs.plan_changes(_stream(frame(spark, sf_dir, "v_reading_2"), 1), c._state(spark, sf_dir), F.lit(c.FIRST).cast("date"), F.lit(c.LAST).cast("date"))


#: Days of the readings of stream_plan_log: the second reading, the first one without every seventh closure, and the second again, twice.
DAYS = ("1996-03-01", "1996-03-02", "1996-03-03", "1996-03-04")
HORIZON = 400


def stream_plan_log(spark, sf_dir):
    first, second = (frame(spark, sf_dir, v).select("id", "begin_day", "end_day", "effect") for v in ("v_reading_1", "v_reading_2"))
    readings = [second, first.where("id % 7 <> 0"), second, second]
    path = jobs.folder(spark)
    for day, rows in zip(DAYS, readings, strict=True):
        rows.withColumn("reading_day", F.lit(day).cast("date")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    events, _ = jobs.plan_log(stream, c._state(spark, sf_dir), jobs.folder(spark), HORIZON)
    return events


def stream_counters(spark, sf_dir):
    departures = frame(spark, sf_dir, "v_departures")
    told = p.told_refs(p.by_product(departures)[1])
    matches = p.ref_station_matches(told, frame(spark, sf_dir, "v_lines"), frame(spark, sf_dir, "v_line_stations"), "full").where("outcome = 'matched'")
    claims = settled(told.join(matches.select("ref", "station", "line_id"), ["ref", "station"]))
    counts = jobs.counters(_stream(departures, 4), claims)
    return counts.select("line_id", "station", "n", "cancelled", F.posexplode("hist").alias("bucket", "departures")).where("departures > 0")


QUERIES = {f.__name__: f for f in (stream_log_replay, stream_plan_diff, stream_plan_log, stream_counters)}


def _fold_sql():
    """The readings one after another: events of each against the state before it, and the state after them."""
    fields = (("b", "begin_day"), ("e", "end_day"), ("f", "effect"))
    steps, told = [], []
    for n, (day, reading) in enumerate(zip(DAYS, ("v_reading_2", "(SELECT * FROM v_reading_1 WHERE id % 7 <> 0)", "v_reading_2", "v_reading_2"), strict=True)):
        changed = " OR ".join(f"a.{f} IS DISTINCT FROM r.{f}" for _, f in fields)
        columns = ", ".join(f"CASE WHEN e = 'revised' AND a_{f} IS DISTINCT FROM r_{f} THEN a_{f} END AS was_{f}, CASE WHEN e = 'planned' OR e = 'revised' AND a_{f} IS DISTINCT FROM r_{f} THEN r_{f} END AS now_{f}" for _, f in fields)
        both = ", ".join(f"a.{f} AS a_{f}, r.{f} AS r_{f}" for _, f in fields)
        steps.append(f"""j{n} AS (SELECT coalesce(a.id, r.id) AS id, a.withdrawn, {both}, CASE WHEN a.id IS NULL THEN 'planned' WHEN r.id IS NOT NULL AND ({changed} OR a.withdrawn) THEN 'revised'
            WHEN r.id IS NULL AND NOT a.withdrawn AND a.begin_day <= DATE '{day}' + {HORIZON} AND a.end_day >= DATE '{day}' THEN 'withdrawn' END AS e FROM s{n} a FULL JOIN {reading} r ON a.id = r.id),
            s{n + 1} AS (SELECT id, {", ".join(f"CASE WHEN e IN ('planned', 'revised') THEN r_{f} ELSE a_{f} END AS {f}" for _, f in fields)}, CASE WHEN e IS NULL THEN withdrawn ELSE e = 'withdrawn' END AS withdrawn FROM j{n})""")
        told.append(f"SELECT id, e, {columns}, DATE '{day}' AS reading_day FROM j{n} WHERE e IS NOT NULL")
    return f"{ctes('v_reading_1', 'v_reading_2')}, s0 AS (SELECT id, begin_day, end_day, effect, id % 9 = 0 AS withdrawn FROM v_reading_1), {', '.join(steps)} {' UNION ALL '.join(told)}"


SQL = {"stream_plan_log": _fold_sql(), "stream_log_replay": c.SQL["log_replay"], "stream_plan_diff": c.SQL["plan_diff"], "stream_counters": f"SELECT * FROM ({q.SQL['delay_histogram']}) WHERE line_id NOT LIKE 'ld%'"}
