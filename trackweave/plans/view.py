"""Queries on views and journeys, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions import style
from trackweave.functions.geo import half_up
from trackweave.operators import journeys as j
from trackweave.operators import view as v
from trackweave.plans import dialect as d
from trackweave.plans.views import ctes, frame

NAMES = ["FRANCE", "GERMANY", "NATION_3", "NATION_7"]
BOX = (9.72, 52.32, 9.78, 52.37)


def operator_allow(spark, sf_dir):
    return v.operator_filter(frame(spark, sf_dir, "v_lines"), NAMES, True)


def operator_deny(spark, sf_dir):
    return v.operator_filter(frame(spark, sf_dir, "v_lines"), NAMES, False)


def _stations(spark, sf_dir):
    modes = F.expr("array_distinct(array(CASE WHEN station_id % 3 = 0 THEN 'tram' ELSE 'regional' END, CASE WHEN station_id % 5 = 0 THEN 'suburban' ELSE 'tram' END))")
    return frame(spark, sf_dir, "v_stations").withColumn("modes", modes)


def served_by_modes(spark, sf_dir):
    return v.served_by_modes(_stations(spark, sf_dir), ["regional", "suburban"]).select("station_id", "name")


def _seen(spark, sf_dir):
    points = frame(spark, sf_dir, "v_stops").select(F.col("stop_id").alias("line_id"), "lon", "lat")
    return v.in_view(frame(spark, sf_dir, "v_lines"), points, BOX, 6.5)


def lines_in_view(spark, sf_dir):
    return v.lines_in_view(_seen(spark, sf_dir))


def operators_in_view(spark, sf_dir):
    return v.operators_in_view(_seen(spark, sf_dir), ["regional"])


def search_lines(spark, sf_dir):
    asked = frame(spark, sf_dir, "region").select(F.explode(F.array(F.lit("RE1"), F.lit("s"), F.lit("rb"), F.lit(" b3 "))).alias("query")).distinct()
    return v.search(asked, frame(spark, sf_dir, "v_lines"), ["ref"], "line_id", v.LINE_HITS).select("query", "rank", "line_id")


def line_index_order(spark, sf_dir):
    return v.index_order(frame(spark, sf_dir, "v_lines")).select("line_id", "place")


def _board(spark, sf_dir):
    return frame(spark, sf_dir, "v_legs").select(F.col("from_name").alias("stop"), "scheduled", F.col("idx").alias("departure_id"), "mode", F.concat(F.lit("RE "), (F.col("idx") % 7).cast("string")).alias("ref"), F.when(F.col("idx") % 2 == 0, "#00ff00").alias("feed_colour"))


def next_departures(spark, sf_dir):
    return v.next_departures(_board(spark, sf_dir), modes=v.RAIL_RESPONSE).select("stop", "rank", "departure_id")


def departure_colour(spark, sf_dir):
    lines = frame(spark, sf_dir, "v_lines").withColumn("colour", style.lookup(F.col("mode"), {m: x[2] for m, x in style.MODES.items()}))
    served = frame(spark, sf_dir, "v_stops").select(F.concat(F.lit("Stop "), (F.col("stop_id") % 90).cast("string")).alias("stop"), F.col("stop_id").alias("line_id"))
    return v.departure_colour(_board(spark, sf_dir), lines, served).select("departure_id", "colour")


def visible_lines(spark, sf_dir):
    lines = frame(spark, sf_dir, "v_lines")
    chosen = lines.where("line_id in (1, 2, 3)").select("line_id")
    return v.visible_lines(_seen(spark, sf_dir), ["regional"], NAMES, False, chosen, lines).select("line_id", "place")


def feature_envelope(spark, sf_dir):
    return v.envelope(frame(spark, sf_dir, "v_shapes"), "shape_id")


def journey_features(spark, sf_dir):
    rows = j.journey_features(frame(spark, sf_dir, "v_legs"))
    return rows.select("journey_id", "kind", "idx", half_up(F.col("lon"), 6).alias("lon"), half_up(F.col("lat"), 6).alias("lat"))


def itinerary_rollup(spark, sf_dir):
    return j.itinerary_rollup(frame(spark, sf_dir, "v_legs")).drop("start")


def interchanges(spark, sf_dir):
    rows = j.interchanges(frame(spark, sf_dir, "v_legs"))
    return rows.select("journey_id", "number", "arrival_idx", "departure_idx", "label", "walking_seconds", half_up(F.col("lon"), 6).alias("lon"))


def journey_order(spark, sf_dir):
    return j.journey_order(j.itinerary_rollup(frame(spark, sf_dir, "v_legs"))).select("journey_id", "place")


def fare_filter(spark, sf_dir):
    return j.fare_filter(frame(spark, sf_dir, "v_legs"), "regional")


def _hits(spark, sf_dir):
    c = frame(spark, sf_dir, "customer")
    return c.selectExpr("'ort ' || CAST(c_custkey % 60 AS STRING) AS query", "c_custkey AS rank", "CAST(c_custkey AS STRING) AS id", "CASE WHEN c_custkey < 60 AND c_custkey % 4 <> 0 THEN 'PLACE' ELSE 'STOP' END AS type", "'city' AS category",
        "CASE WHEN c_custkey % 7 = 3 THEN 'Ort ' || CAST(c_custkey % 60 AS STRING) || ' Hbf' ELSE 'Ort ' || CAST(c_custkey % 60 AS STRING) END AS name", "CAST(c_custkey % 2 AS STRING) AS country", "CAST(c_custkey % 3 AS STRING) AS area", "c_nationkey % 2 = 0 AS rail")


def main_station_promotion(spark, sf_dir):
    return j.main_station_first(_hits(spark, sf_dir))


QUERIES = {f.__name__: f for f in (operator_allow, operator_deny, served_by_modes, lines_in_view, operators_in_view, search_lines, line_index_order, next_departures, departure_colour, visible_lines, feature_envelope, journey_features, itinerary_rollup, interchanges, journey_order, fare_filter, main_station_promotion)}

_NAMES = ", ".join(f"'{x}'" for x in NAMES)
_LINES = ctes("v_lines")
_ORDER = r"""CASE mode WHEN 'regional' THEN 40 ELSE 30 END DESC, CASE regexp_extract(ref, '^[A-Z]*') WHEN 'RE' THEN 9 WHEN 'RB' THEN 10 WHEN 'S' THEN 11 ELSE 14 END, CAST(regexp_extract(ref, '\d+') AS INTEGER), line_id"""
_SEEN = f"""{ctes("v_lines", "v_stops")}, seen AS (SELECT * FROM v_lines WHERE mode = 'regional' AND line_id IN (SELECT stop_id FROM v_stops WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}))"""
_BOARD = f"""{ctes("v_legs", "v_lines", "v_stops")}, board AS (SELECT from_name AS stop, scheduled, idx AS departure_id, mode, 're' || CAST(idx % 7 AS VARCHAR) AS ref, CASE WHEN idx % 2 = 0 THEN '#00ff00' END AS feed_colour FROM v_legs)"""
_TRANSIT = "mode IN ('REGIONAL_RAIL', 'HIGHSPEED_RAIL', 'BUS')"
_CHANGES = f"""{ctes("v_legs")}, walked AS (SELECT *, sum(CASE WHEN mode = 'WALK' THEN seconds ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY idx) AS w FROM v_legs),
    transit AS (SELECT *, lag(idx) OVER p AS a_idx, lag(w) OVER p AS a_w, lag(to_name) OVER p AS a_name, lag(lon) OVER p AS a_lon, lag(lat) OVER p AS a_lat, row_number() OVER p - 1 AS number FROM walked WHERE {_TRANSIT} WINDOW p AS (PARTITION BY journey_id ORDER BY idx)),
    changes AS (SELECT journey_id, CAST(number AS INTEGER) AS number, a_idx AS arrival_idx, idx AS departure_idx, CASE WHEN a_name = from_name THEN a_name ELSE a_name || ' → ' || from_name END AS label, CAST(w - a_w AS BIGINT) AS walking_seconds, (a_lon + lon) / 2 AS lon, (a_lat + lat) / 2 AS lat FROM transit WHERE a_idx IS NOT NULL)"""
_ROLLED = f"""{ctes("v_legs")}, rolled AS (SELECT journey_id, CAST(coalesce(sum(seconds) FILTER (mode = 'BIKE'), 0) AS BIGINT) AS bike_seconds, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) FILTER ({_TRANSIT}) = 0 AS direct, greatest(count(*) FILTER ({_TRANSIT}) - 1, 0) AS transfers, min(scheduled) AS start FROM v_legs GROUP BY journey_id)"""

SQL = {
    "operator_allow": f"{_LINES} SELECT * FROM v_lines WHERE coalesce(operator, '') IN ({_NAMES})",
    "operator_deny": f"{_LINES} SELECT * FROM v_lines WHERE coalesce(operator, '') NOT IN ({_NAMES})",
    "served_by_modes": f"{ctes('v_stations')} SELECT station_id, name FROM v_stations WHERE station_id % 3 <> 0 OR station_id % 5 = 0",
    "lines_in_view": f"{_SEEN} SELECT mode, count(*) AS lines FROM seen GROUP BY mode",
    "operators_in_view": f"{_SEEN} SELECT operator, count(*) AS lines FROM seen WHERE coalesce(operator, '') <> '' GROUP BY operator",
    "search_lines": f"{_LINES}, asked AS (SELECT unnest(['RE1', 's', 'rb', ' b3 ']) AS query) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY line_id) AS INTEGER) AS rank, line_id FROM v_lines JOIN asked ON length(trim(query)) >= 2 AND contains(lower(ref), lower(trim(query))) QUALIFY row_number() OVER (PARTITION BY query ORDER BY line_id) <= 6",
    "line_index_order": f"{_LINES} SELECT line_id, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS place FROM v_lines",
    "next_departures": f"{_BOARD}, r AS (SELECT stop, departure_id, row_number() OVER (PARTITION BY stop ORDER BY scheduled, departure_id) AS n FROM board WHERE mode IN ('REGIONAL_RAIL', 'HIGHSPEED_RAIL')) SELECT stop, CAST(n AS INTEGER) AS rank, departure_id FROM r WHERE n <= 6",
    "departure_colour": f"""{_BOARD}, own AS (SELECT 'Stop ' || CAST(s.stop_id % 90 AS VARCHAR) AS stop, lower(l.ref) AS ref, arg_min(CASE l.mode WHEN 'regional' THEN '#014895' ELSE '#4b8f46' END, l.line_id) AS colour FROM v_stops s JOIN v_lines l ON s.stop_id = l.line_id GROUP BY 1, 2)
        SELECT b.departure_id, coalesce(o.colour, b.feed_colour) AS colour FROM board b LEFT JOIN own o ON b.stop = o.stop AND b.ref = o.ref""",
    "visible_lines": f"{_SEEN}, rows AS (SELECT * FROM v_lines WHERE (line_id IN (1, 2, 3) OR line_id IN (SELECT line_id FROM seen)) AND mode = 'regional' AND coalesce(operator, '') NOT IN ({_NAMES})) SELECT line_id, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS place FROM rows",
    "feature_envelope": f"{ctes('v_shapes')} SELECT shape_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM v_shapes GROUP BY shape_id",
    "journey_features": f"""{_CHANGES}, ends AS (SELECT journey_id, min(idx) AS a, max(idx) AS b FROM v_legs GROUP BY journey_id),
        f AS (SELECT journey_id, CASE WHEN {_TRANSIT} THEN 'transit' WHEN mode = 'BIKE' THEN 'bike' ELSE 'walk' END AS kind, idx, lon, lat FROM v_legs
            UNION ALL SELECT journey_id, 'interchange', departure_idx, lon, lat FROM changes
            UNION ALL SELECT l.journey_id, 'start', idx, lon, lat FROM v_legs l JOIN ends e ON l.journey_id = e.journey_id AND l.idx = e.a
            UNION ALL SELECT l.journey_id, 'end', idx, lon, lat FROM v_legs l JOIN ends e ON l.journey_id = e.journey_id AND l.idx = e.b)
        SELECT journey_id, kind, idx, {d.half_up("lon", 6)} AS lon, {d.half_up("lat", 6)} AS lat FROM f""",
    "itinerary_rollup": f"{_ROLLED} SELECT journey_id, bike_seconds, seconds, direct, transfers FROM rolled",
    "interchanges": f"{_CHANGES} SELECT journey_id, number, arrival_idx, departure_idx, label, walking_seconds, {d.half_up('lon', 6)} AS lon FROM changes",
    "journey_order": f"{_ROLLED} SELECT journey_id, CAST(row_number() OVER (PARTITION BY CAST(start AS DATE) ORDER BY direct, start, journey_id) AS INTEGER) AS place FROM rolled",
    "fare_filter": f"{ctes('v_legs')} SELECT DISTINCT journey_id FROM v_legs WHERE journey_id NOT IN (SELECT journey_id FROM v_legs WHERE mode IN ('HIGHSPEED_RAIL', 'BUS'))",
    "main_station_promotion": """WITH hits AS (SELECT 'ort ' || CAST(c_custkey % 60 AS VARCHAR) AS query, c_custkey AS rank, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey < 60 AND c_custkey % 4 <> 0 THEN 'PLACE' ELSE 'STOP' END AS type,
            CASE WHEN c_custkey % 7 = 3 THEN 'Ort ' || CAST(c_custkey % 60 AS VARCHAR) || ' Hbf' ELSE 'Ort ' || CAST(c_custkey % 60 AS VARCHAR) END AS name, c_custkey % 2 AS country, c_custkey % 3 AS area, c_nationkey % 2 = 0 AS rail FROM customer),
        tops AS (SELECT query, arg_min(type, rank) AS type, arg_min(country, rank) AS country, arg_min(area, rank) AS area FROM hits GROUP BY query),
        best AS (SELECT h.query, arg_min(h.id, CASE WHEN contains(h.name, 'Hbf') THEN 0 ELSE 1000000000 END + h.rank) AS id FROM hits h JOIN tops t ON h.query = t.query WHERE t.type = 'PLACE' AND h.type = 'STOP' AND h.country = t.country AND h.area = t.area AND h.rail GROUP BY h.query),
        placed AS (SELECT h.query, h.id, row_number() OVER (PARTITION BY h.query ORDER BY CASE WHEN b.id = h.id THEN 0 ELSE 1 END, h.rank) AS place FROM hits h LEFT JOIN best b ON h.query = b.query)
        SELECT query, CAST(place AS INTEGER) AS place, id FROM placed WHERE place <= 8""",
}
