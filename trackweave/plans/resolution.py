"""Queries on stop ids, operator marks and coach feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions.geo import half_up
from trackweave.functions.text import search_variants
from trackweave.operators import coach as k
from trackweave.operators import resolve as r
from trackweave.plans import dialect as d
from trackweave.plans.views import ctes, frame

BOX = (9.1, 52.05, 9.3, 52.2)


def _candidates(spark, sf_dir):
    return frame(spark, sf_dir, "v_candidates").withColumn("modes", F.when(F.col("mode") == "", F.array().cast("array<string>")).otherwise(F.array("mode"))).drop("mode", "station_id")


def _valid(spark, sf_dir):
    return r.valid_candidates(frame(spark, sf_dir, "v_wanted"), _candidates(spark, sf_dir))


def candidate_validation(spark, sf_dir):
    return _valid(spark, sf_dir).select("station_id", "id", half_up(F.col("distance"), 3).alias("distance"), "exact", "serves")


def collapse_duplicates(spark, sf_dir):
    return r.collapsed(r.tiered(_valid(spark, sf_dir))).select("station_id", "id", "serves")


def best_match(spark, sf_dir):
    return r.best_match(_valid(spark, sf_dir))


def resolution_cascade(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    stations = frame(spark, sf_dir, "v_wanted")
    tagged = stations.where("station_id % 17 = 0").select("station_id", F.concat(F.lit("tag"), F.col("station_id").cast("string")).alias("id"), F.array(F.lit("REGIONAL_RAIL")).alias("modes"))
    stations = stations.withColumn("town", F.when(F.col("station_id") % 3 == 0, "Halt").otherwise("Ort"))
    around, named, town = (candidates.where(c) for c in ("id like '%-0' and id < 'c5'", "id like '%-1' and mod(length(id), 2) = 0", "name like 'Ort%' or name like 'Halt%'"))
    both = r.candidate_union(named, around, keys=("id",))
    stages = [("spatial", around), ("name", named), ("name and nearby", both), ("town", r.candidate_union(both, town, keys=("id",)), r.town_missing(F.col("name"), F.col("town")))]
    return r.cascade(stations, tagged, stages)


def _state(spark, sf_dir):
    c = frame(spark, sf_dir, "customer")
    return c.selectExpr("c_custkey AS station_id", "CASE c_custkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'none' ELSE 'ambiguous' END AS state", "CAST(c_custkey % 6 AS INT) AS resolver_version").where("c_custkey % 3 <> 0")


def drop_stale(spark, sf_dir):
    return r.drop_stale(_state(spark, sf_dir), 4)


def work_budget(spark, sf_dir):
    return r.work_budget(frame(spark, sf_dir, "v_stations"), _state(spark, sf_dir), 540)


def operator_variants(spark, sf_dir):
    return frame(spark, sf_dir, "v_operator_names").select("operator_id", F.explode(search_variants(F.col("name"))).alias("variant"))


def _marks(spark, sf_dir):
    p = frame(spark, sf_dir, "part")
    operators = frame(spark, sf_dir, "v_operator_names")
    hits = p.selectExpr("p_partkey % 100 AS operator_id", "p_partkey % 7 AS hit_rank", "p_partkey % 400 AS entity").distinct()
    files = p.selectExpr(
        "p_partkey % 400 AS entity", "CAST(p_size % 2 AS INT) AS property", "p_partkey % 3 = 0 AS preferred", "p_partkey AS place", "concat('f', CAST(p_partkey AS STRING)) AS file",
        "CASE p_partkey % 5 WHEN 0 THEN '<b>Public domain</b>' WHEN 1 THEN 'CC0' ELSE 'CC BY-SA 4.0' END AS licence", "CASE p_partkey % 11 WHEN 0 THEN 'application/pdf' ELSE 'image/png' END AS kind", "CAST(p_retailprice * 200 AS INT) AS size",
    )
    return operators, hits, files, r.choose_marks(operators, hits, files)


def operator_logo_choice(spark, sf_dir):
    return _marks(spark, sf_dir)[3]


def logo_refusals(spark, sf_dir):
    return r.refusals(*_marks(spark, sf_dir)).select("operator_id", F.array_join("reasons", ",").alias("reasons"))


def modal_shape(spark, sf_dir):
    return k.modal_shape(frame(spark, sf_dir, "v_trips"))


def split_gaps(spark, sf_dir):
    return k.split_gaps(frame(spark, sf_dir, "v_shapes")).groupBy("shape_id", "part").agg(F.count("*").alias("points"), F.min("seq").alias("first_seq"))


def clip_bbox(spark, sf_dir):
    runs = k.clip(k.split_gaps(frame(spark, sf_dir, "v_shapes")), BOX)
    return runs.select("shape_id", "part", "run", "n", half_up(F.col("lon"), 6).alias("lon"), half_up(F.col("lat"), 6).alias("lat"))


def calling_order(spark, sf_dir):
    return k.calling_order(k.modal_shape(frame(spark, sf_dir, "v_trips")), frame(spark, sf_dir, "v_stop_times"))


def coach_lines(spark, sf_dir):
    trips = frame(spark, sf_dir, "v_trips")
    routes = trips.select("route_id").distinct().selectExpr("CASE WHEN route_id % 4 = 0 THEN 'rail' ELSE 'bus' END AS agency_id", "route_id", "concat('FLX ', CAST(route_id AS STRING)) AS route_short_name", "'73D700' AS route_color")
    points = frame(spark, sf_dir, "v_shapes").withColumn("shape_id", F.col("shape_id") % 350)
    return k.coach_lines(routes, trips, points, frame(spark, sf_dir, "v_stop_times"), ["bus"], BOX, "FLX").select("line_id", "route_id", "ref", "colour", "parts", "points", F.array_join("stops", ",").alias("stops"))


QUERIES = {f.__name__: f for f in (candidate_validation, collapse_duplicates, best_match, resolution_cascade, drop_stale, work_budget, operator_variants, operator_logo_choice, logo_refusals, modal_shape, split_gaps, clip_bbox, calling_order, coach_lines)}

_RAIL = "('HIGHSPEED_RAIL', 'LONG_DISTANCE', 'REGIONAL_RAIL', 'SUBURBAN', 'METRO', 'SUBWAY')"


def _valid_sql(where: str = "TRUE", prefix: str = "", candidates: str = "v_candidates") -> str:
    """Candidates as pairs; then exact tier, groups, best match, of the stations that `where` keeps."""
    own = f"*, {d.name('name')} AS bare, {d.name('name', True)} AS whole"
    return f"""{prefix}valid AS (SELECT station_id, mode, id, lon, lat, distance, c_bare = bare AS exact, c_bare AS stop, serves FROM (SELECT w.station_id, w.mode, w.bare, w.whole, c.id, c.lon, c.lat, {d.metres("w.lon", "w.lat", "c.lon", "c.lat")} AS distance, c.bare AS c_bare, c.whole AS c_whole,
            CASE WHEN w.mode = 'tram' THEN c.mode = 'TRAM' ELSE c.mode IN {_RAIL} END AS serves
        FROM (SELECT {own} FROM v_wanted WHERE {where}) w JOIN (SELECT {own} FROM {candidates} WHERE type = 'STOP' AND mode <> '') c
            ON abs(c.lat - w.lat) < 0.0046 AND abs(c.lon - w.lon) < 0.0092) WHERE distance <= 500 AND {d.names_match("bare", "whole", "c_bare", "c_whole")}),
    {prefix}tier AS (SELECT * FROM {prefix}valid v WHERE exact OR NOT EXISTS (SELECT 1 FROM {prefix}valid e WHERE e.station_id = v.station_id AND e.exact)),
    {prefix}near AS (SELECT a.station_id, a.id AS a, b.id AS b FROM {prefix}tier a JOIN {prefix}tier b ON a.station_id = b.station_id AND a.id <> b.id AND (a.stop = b.stop OR {d.tokens_match("string_split(a.stop, ' ')", "string_split(b.stop, ' ')")} OR {d.tokens_match("string_split(b.stop, ' ')", "string_split(a.stop, ' ')")}) WHERE least({d.metres("a.lon", "a.lat", "b.lon", "b.lat")}, {d.metres("b.lon", "b.lat", "a.lon", "a.lat")}) <= 20),
    {prefix}reach AS (SELECT station_id, id AS a, id AS b FROM {prefix}tier UNION SELECT r.station_id, r.a, n.b FROM {prefix}reach r JOIN {prefix}near n ON r.station_id = n.station_id AND r.b = n.a),
    {prefix}comp AS (SELECT station_id, a AS id, min(b) AS component FROM {prefix}reach GROUP BY 1, 2),
    {prefix}reps AS (SELECT t.station_id, t.id, t.distance, t.serves FROM {prefix}tier t JOIN {prefix}comp c ON t.station_id = c.station_id AND t.id = c.id
        QUALIFY row_number() OVER (PARTITION BY t.station_id, c.component ORDER BY t.serves DESC, t.id) = 1),
    {prefix}tied AS (SELECT * FROM (SELECT *, min(distance) OVER (PARTITION BY station_id) AS least FROM {prefix}reps) WHERE distance - least < 150),
    {prefix}best AS (SELECT station_id, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (serves) = 1 THEN min(id) FILTER (serves) END AS stop_id FROM {prefix}tied GROUP BY station_id)"""


_VALID = f"{ctes('v_wanted', 'v_candidates')}, {_valid_sql()}"
_FREE = r"regexp_matches(lower(trim(regexp_replace(licence, '<[^>]*>', '', 'g'))), '^(public domain|cc0)')"
_MARKS = f"""WITH hits AS (SELECT DISTINCT p_partkey % 100 AS operator_id, p_partkey % 7 AS hit_rank, p_partkey % 400 AS entity FROM part),
    files AS (SELECT p_partkey % 400 AS entity, p_size % 2 AS property, p_partkey % 3 = 0 AS preferred, p_partkey AS place, 'f' || CAST(p_partkey AS VARCHAR) AS file,
        CASE p_partkey % 5 WHEN 0 THEN '<b>Public domain</b>' WHEN 1 THEN 'CC0' ELSE 'CC BY-SA 4.0' END AS licence, p_partkey % 11 = 0 AS pdf, CAST(trunc(p_retailprice * 200) AS INTEGER) AS size FROM part),
    judged AS (SELECT *, CASE WHEN NOT {_FREE} THEN 'licence' WHEN pdf THEN 'type' WHEN size > 250000 THEN 'size' END AS reason FROM files),
    pairs AS (SELECT h.operator_id, h.hit_rank, j.* FROM hits h JOIN judged j ON h.entity = j.entity),
    chosen AS (SELECT operator_id, file FROM pairs WHERE reason IS NULL AND operator_id IN (SELECT s_suppkey FROM supplier) QUALIFY row_number() OVER (PARTITION BY operator_id ORDER BY hit_rank, property, preferred DESC, place, file) = 1)"""
_MODAL = f"""{ctes("v_trips", "v_stop_times")}, sums AS (SELECT route_id, shape_id, count(*) AS trips, min(trip_id) AS trip_id FROM v_trips GROUP BY 1, 2),
    modal AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY trips DESC, shape_id) = 1)"""

SQL = {
    "candidate_validation": f"{_VALID} SELECT station_id, id, {d.half_up('distance', 3)} AS distance, exact, serves FROM valid",
    "collapse_duplicates": f"{_VALID} SELECT station_id, id, serves FROM reps",
    "best_match": f"{_VALID} SELECT station_id, CASE WHEN stop_id IS NULL THEN 'ambiguous' ELSE 'resolved' END AS state, stop_id FROM best",
    "resolution_cascade": f"""{ctes("v_wanted", "v_candidates")},
        tags AS (SELECT station_id, 'tag' || CAST(station_id AS VARCHAR) AS stop_id FROM v_wanted WHERE station_id % 17 = 0 AND mode = 'rail'),
        around AS (SELECT * FROM v_candidates WHERE id LIKE '%-0' AND id < 'c5'), named AS (SELECT * FROM v_candidates WHERE id LIKE '%-1' AND length(id) % 2 = 0),
        joint AS (SELECT * FROM named UNION SELECT * FROM around), wide AS (SELECT * FROM joint UNION SELECT * FROM v_candidates WHERE name LIKE 'Ort%' OR name LIKE 'Halt%'),
        {_valid_sql("station_id NOT IN (SELECT station_id FROM tags)", "a_", "around")},
        b_open AS (SELECT station_id, name FROM v_wanted WHERE station_id NOT IN (SELECT station_id FROM tags) AND station_id NOT IN (SELECT station_id FROM a_best)),
        {_valid_sql("station_id IN (SELECT station_id FROM b_open)", "b_", "named")},
        c_open AS (SELECT station_id, name FROM b_open WHERE station_id NOT IN (SELECT station_id FROM b_best WHERE stop_id IS NOT NULL)),
        {_valid_sql("station_id IN (SELECT station_id FROM c_open)", "c_", "joint")},
        d_open AS (SELECT station_id, name FROM c_open WHERE station_id NOT IN (SELECT station_id FROM c_best WHERE stop_id IS NOT NULL)),
        {_valid_sql("station_id IN (SELECT station_id FROM d_open WHERE station_id % 3 <> 0)", "d_", "wide")}
        SELECT station_id, 'tag' AS source, 'resolved' AS state, stop_id FROM tags
        UNION ALL SELECT station_id, 'spatial', CASE WHEN stop_id IS NULL THEN 'ambiguous' ELSE 'resolved' END, stop_id FROM a_best
        UNION ALL SELECT station_id, 'name', 'resolved', stop_id FROM b_best WHERE stop_id IS NOT NULL
        UNION ALL SELECT station_id, 'name and nearby', 'resolved', stop_id FROM c_best WHERE stop_id IS NOT NULL
        UNION ALL SELECT o.station_id, CASE WHEN d.station_id IS NOT NULL THEN 'town' WHEN c.station_id IS NOT NULL THEN 'name and nearby' WHEN b.station_id IS NOT NULL THEN 'name' END,
            CASE WHEN d.stop_id IS NOT NULL THEN 'resolved' WHEN coalesce(d.station_id, c.station_id, b.station_id) IS NULL THEN 'none' ELSE 'ambiguous' END, d.stop_id
            FROM d_open o LEFT JOIN d_best d ON o.station_id = d.station_id LEFT JOIN c_best c ON o.station_id = c.station_id LEFT JOIN b_best b ON o.station_id = b.station_id""",
    "drop_stale": "SELECT * FROM (SELECT c_custkey AS station_id, CASE c_custkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'none' ELSE 'ambiguous' END AS state, CAST(c_custkey % 6 AS INTEGER) AS resolver_version FROM customer WHERE c_custkey % 3 <> 0) WHERE state = 'resolved' OR resolver_version >= 4",
    "work_budget": """WITH c AS (SELECT c_custkey AS station_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 4 IN (2, 3) THEN 'backlog' END AS class FROM customer),
        n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY station_id) AS n FROM c WHERE class IS NOT NULL)
        SELECT station_id, class, n FROM n WHERE class = 'new' AND n <= 540 OR class = 'backlog' AND n <= least(100, greatest(0, 540 - (SELECT count(*) FROM c WHERE class = 'new')))""",
    "operator_variants": """WITH o AS (SELECT s_suppkey AS operator_id, s_suppkey % 4 AS k, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        v AS (SELECT operator_id, unnest(CASE k WHEN 0 THEN [n || ' Bahn GmbH', n || ' Bahn'] WHEN 1 THEN [n || ' Verkehr (' || n[1:2] || ') AG', n || ' Verkehr AG', n || ' Verkehr'] ELSE [n] END) AS variant FROM o)
        SELECT operator_id, variant FROM v WHERE length(variant) > 2""",
    "operator_logo_choice": f"{_MARKS} SELECT operator_id, file FROM chosen",
    "logo_refusals": f"""{_MARKS} SELECT s_suppkey AS operator_id, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM supplier LEFT JOIN pairs ON s_suppkey = operator_id
        WHERE s_suppkey NOT IN (SELECT operator_id FROM chosen) GROUP BY s_suppkey""",
    "modal_shape": f"{_MODAL} SELECT route_id, shape_id, trips, trip_id FROM modal",
    "split_gaps": f"""{ctes("v_shapes")}, steps AS (SELECT *, lag(lon) OVER p AS x, lag(lat) OVER p AS y FROM v_shapes WINDOW p AS (PARTITION BY shape_id ORDER BY seq)),
        parts AS (SELECT shape_id, seq, sum(CASE WHEN {d.metres("x", "y", "lon", "lat")} > 25000 THEN 1 ELSE 0 END) OVER (PARTITION BY shape_id ORDER BY seq) AS part FROM steps)
        SELECT shape_id, CAST(part AS BIGINT) AS part, count(*) AS points, min(seq) AS first_seq FROM parts GROUP BY 1, 2""",
    "calling_order": f"{_MODAL}, calls AS (SELECT DISTINCT m.route_id, t.stop_sequence, t.stop_id FROM modal m JOIN v_stop_times t ON m.trip_id = t.trip_id) SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY stop_sequence, stop_id) AS INTEGER) AS n, stop_id FROM calls",
}
