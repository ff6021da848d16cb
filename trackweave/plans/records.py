"""Queries on what stations, stops and lines are made of, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions import style
from trackweave.operators import coach as k
from trackweave.operators import journeys as j
from trackweave.operators import lines as n
from trackweave.operators import resolve as r
from trackweave.operators import view as v
from trackweave.plans import lines
from trackweave.plans.views import ctes, frame

BOX = (9.7, 52.3, 9.75, 52.36)


def station_records(spark, sf_dir):
    stops = frame(spark, sf_dir, "v_stops")
    served = stops.select(F.coalesce("station_ref", "stop_id").alias("station_id"), "line_id").unionByName(stops.select("stop_id", F.col("stop_id") * 3).toDF("station_id", "line_id"))
    return v.station_records(served, frame(spark, sf_dir, "v_lines"))


def search_stations(spark, sf_dir):
    asked = frame(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit(" "), "n_nationkey", F.lit(" hbf")), F.concat(F.lit("ING "), "n_nationkey"), F.lit("x"))).alias("query"))
    names = frame(spark, sf_dir, "v_stations").select("name").distinct()
    return v.search(asked, names, ["name"], "name", v.STATION_HITS).select("query", "rank", "name")


def closures_in_view(spark, sf_dir):
    placed = frame(spark, sf_dir, "v_reading_1").join(frame(spark, sf_dir, "v_stations").select(F.col("station_id").alias("id"), "lon", "lat"), "id")
    near, far = (v.closures_in_view(placed, BOX, zoom, style.CLOSURE_ZOOM).withColumn("zoom", F.lit(zoom)) for zoom in (12.0, 7.0))
    return near.unionByName(far)


def coach_stop_lines(spark, sf_dir):
    calls = k.calling_order(k.modal_shape(frame(spark, sf_dir, "v_trips")), frame(spark, sf_dir, "v_stop_times"))
    routes = calls.groupBy("route_id").agg(F.collect_list("stop_id").alias("stops")).select(F.concat(F.lit("coach|"), "route_id").alias("line_id"), "stops")
    return k.lines_per_stop(routes).select("stop_id", F.array_join("lines", ",").alias("lines"))


def candidate_union(spark, sf_dir):
    c = frame(spark, sf_dir, "v_candidates").select("station_id", "id", "name", "mode")
    unnamed = c.withColumn("id", F.when(F.col("mode") != "BUS", F.concat(F.lit("x"), F.substring("id", 2, 9))))
    return r.candidate_union(c, c.withColumn("mode", F.lit("TRAM")), unnamed)


def _relations(spark, sf_dir):
    ways = F.when(F.col("ord") % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("ord"), F.col("ord") + 1, F.col("ord") % 100))
    return frame(spark, sf_dir, "v_relations").withColumns({"way_ids": ways, "stop_ids": F.array(F.col("ord") % 40, F.col("ord") % 30)})


def line_members(spark, sf_dir):
    relations = _relations(spark, sf_dir)
    ways, stops = n.line_members(relations, "way_ids", "member"), n.line_members(relations, "stop_ids", "member")
    return ways.withColumn("kind", F.lit("way")).unionByName(stops.withColumn("kind", F.lit("stop")))


def known_ways(spark, sf_dir):
    geometry = frame(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("way_id"))
    return n.known_ways(frame(spark, sf_dir, "v_line_ways"), geometry)


def way_priority(spark, sf_dir):
    ways = n.lines_per_way(frame(spark, sf_dir, "v_line_ways")).join(frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("way_id"), F.col("p_size").alias("metres")), "way_id")
    return n.way_priority(ways).select("way_id", "priority")


def with_coach(spark, sf_dir):
    rail = frame(spark, sf_dir, "v_lines").select(F.col("line_id").cast("string").alias("line_id"), "mode")
    trips = frame(spark, sf_dir, "v_trips")
    coach = trips.select(F.col("route_id").cast("string").alias("line_id"), F.lit("coach").alias("mode")).distinct()
    return n.with_coach(rail, coach)


def leg_normalise(spark, sf_dir):
    legs = frame(spark, sf_dir, "v_legs").withColumns({"line": F.concat(F.lit("RE "), (F.col("idx") % 9).cast("string"), F.when(F.col("idx") % 2 == 0, F.concat(F.lit(" ("), F.col("idx").cast("string"), F.lit(")"))).otherwise("")), "actual": F.when(F.col("idx") % 3 == 0, F.col("scheduled")), "bikes": F.col("idx") % 5 == 0})
    return j.normalised_legs(legs).select("journey_id", "idx", "transit", "label", "actual", "bikes")


QUERIES = {f.__name__: f for f in (station_records, search_stations, closures_in_view, coach_stop_lines, candidate_union, line_members, known_ways, way_priority, with_coach, leg_normalise)}

_ORDER = "CASE mode WHEN 'regional' THEN 40 ELSE 30 END DESC, CASE regexp_extract(ref, '^[A-Z]*') WHEN 'RE' THEN 9 WHEN 'RB' THEN 10 WHEN 'S' THEN 11 ELSE 14 END, CAST(regexp_extract(ref, '\\d+') AS INTEGER), l.line_id"
_INSIDE = f"lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}"

SQL = {
    "station_records": f"""{ctes("v_stops", "v_lines")}, served AS (SELECT coalesce(station_ref, stop_id) AS station_id, line_id FROM v_stops UNION SELECT stop_id, stop_id * 3 FROM v_stops)
        SELECT station_id, CAST(row_number() OVER (PARTITION BY station_id ORDER BY {_ORDER}) AS INTEGER) AS place, l.line_id FROM served s JOIN v_lines l ON s.line_id = l.line_id""",
    "search_stations": f"""{ctes("v_stations")}, asked AS (SELECT DISTINCT unnest([' ' || CAST(n_nationkey AS VARCHAR) || ' hbf', 'ING ' || CAST(n_nationkey AS VARCHAR), 'x']) AS query FROM nation), names AS (SELECT DISTINCT name FROM v_stations)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY name) AS INTEGER) AS rank, name FROM names JOIN asked ON length(trim(query)) >= 2 AND contains(lower(name), lower(trim(query)))
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY name) <= 8""",
    "closures_in_view": f"""{ctes("v_reading_1", "v_stations")}, placed AS (SELECT r.id, effect, lon, lat FROM v_reading_1 r JOIN v_stations s ON r.id = s.station_id WHERE {_INSIDE})
        SELECT effect, count(DISTINCT id) AS closures, 12.0e0 AS zoom FROM placed GROUP BY effect UNION ALL SELECT effect, count(DISTINCT id), 7.0e0 FROM placed WHERE effect IN ('closed', 'single-track') GROUP BY effect""",
    "coach_stop_lines": f"""{ctes("v_trips", "v_stop_times")}, sums AS (SELECT route_id, shape_id, count(*) AS trips, min(trip_id) AS trip_id FROM v_trips GROUP BY 1, 2),
        modal AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY trips DESC, shape_id) = 1)
        SELECT stop_id, string_agg(DISTINCT 'coach|' || CAST(route_id AS VARCHAR), ',' ORDER BY 'coach|' || CAST(route_id AS VARCHAR)) AS lines FROM modal m JOIN v_stop_times t ON m.trip_id = t.trip_id GROUP BY stop_id""",
    "candidate_union": f"""{ctes("v_candidates")} SELECT station_id, id, name, mode FROM v_candidates UNION ALL SELECT station_id, CASE WHEN mode <> 'BUS' THEN 'x' || substr(id, 2, 9) END, name, mode FROM v_candidates""",
    "line_members": f"""{lines._LINES}, told AS (SELECT k.line_id, r.ord FROM keyed k JOIN v_relations r ON k.id = r.id WHERE r.ord % 6 <> 0)
        SELECT DISTINCT line_id, unnest([ord, ord + 1, ord % 100]) AS member, 'way' AS kind FROM told UNION ALL SELECT DISTINCT line_id, unnest([ord % 40, ord % 30]), 'stop' FROM told""",
    "known_ways": f"{ctes('v_line_ways')} SELECT line_id, way_id FROM v_line_ways WHERE way_id IN (SELECT p_partkey FROM part WHERE p_size > 5)",
    "way_priority": f"{ctes('v_line_ways')}, w AS (SELECT way_id, count(*) AS lines FROM v_line_ways GROUP BY way_id) SELECT way_id, row_number() OVER (ORDER BY lines DESC, p_size DESC, way_id) AS priority FROM w JOIN part ON way_id = p_partkey",
    "with_coach": f"""{ctes("v_lines", "v_trips")}, coach AS (SELECT DISTINCT CAST(route_id AS VARCHAR) AS line_id FROM v_trips)
        SELECT CAST(line_id AS VARCHAR) AS line_id, mode FROM v_lines WHERE CAST(line_id AS VARCHAR) NOT IN (SELECT line_id FROM coach) UNION ALL SELECT line_id, 'coach' FROM coach""",
    "leg_normalise": f"""{ctes("v_legs")} SELECT journey_id, idx, mode NOT IN ('WALK', 'BIKE') AS transit, 'RE ' || CAST(idx % 9 AS VARCHAR) AS label, scheduled AS actual, CASE WHEN idx % 5 = 0 THEN TRUE END AS bikes FROM v_legs""",
}
