"""Queries on lines, corridors and stations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions import style
from trackweave.functions.geo import half_up
from trackweave.operators import lines as n
from trackweave.operators import stations as s
from trackweave.operators.spatial import nearest
from trackweave.plans import dialect as d
from trackweave.plans.views import ctes, frame


def classify_mode(spark, sf_dir):
    r = frame(spark, sf_dir, "v_relations")
    return r.select("id", n.classify_mode(F.col("route"), F.col("service"), F.col("ref")).alias("mode"))


def line_key(spark, sf_dir):
    return n.keyed(frame(spark, sf_dir, "v_relations")).select("id", "mode", "line_id")


def collapse_lines(spark, sf_dir):
    return n.collapse_lines(frame(spark, sf_dir, "v_relations")).select("line_id", "mode", "ref", "name", "operator", "network", "relations")


def colour_normalise(spark, sf_dir):
    return frame(spark, sf_dir, "v_relations").select("id", style.normalise_colour(F.col("colour")).alias("colour"))


def fallback_colour_fnv(spark, sf_dir):
    key = F.concat_ws("|", "network", "ref")
    return n.collapse_lines(frame(spark, sf_dir, "v_relations")).select("line_id", style.fnv1a(key).alias("hash"), style.fallback_colour(key, F.col("mode")).alias("colour"))


def text_on(spark, sf_dir):
    colour = F.format_string("#%06x", F.pmod(F.col("c_custkey") * 104729, F.lit(16777216)))
    return frame(spark, sf_dir, "customer").select("c_custkey", style.text_on(colour).alias("text"))


def colour_precedence(spark, sf_dir):
    relations = frame(spark, sf_dir, "v_relations")
    overrides = n.keyed(relations).where("ord % 50 = 7").groupBy("line_id").agg(F.lit("#123456").alias("override"))
    return n.collapse_lines(relations, overrides).select("line_id", "colour_source", F.when(F.col("colour_source") != "fallback", F.col("colour")).alias("colour"))


def registry_counts(spark, sf_dir):
    return n.registry_counts(n.collapse_lines(frame(spark, sf_dir, "v_relations")))


def lines_per_way(spark, sf_dir):
    return n.lines_per_way(frame(spark, sf_dir, "v_line_ways"))


def bundle_segments(spark, sf_dir):
    return n.bundle_segments(frame(spark, sf_dir, "v_line_ways")).select(F.array_join("line_ids", ",").alias("line_ids"), F.size("way_ids").alias("ways"), F.array_min("way_ids").alias("first_way"))


def _slots(spark, sf_dir):
    segments = n.bundle_segments(frame(spark, sf_dir, "v_line_ways")).withColumn("seg_id", F.array_min("way_ids"))
    return n.slot_ordinals(segments, frame(spark, sf_dir, "v_lines"))


def slot_ordinals(spark, sf_dir):
    return _slots(spark, sf_dir)


def slot_diagnostics(spark, sf_dir):
    return n.slot_diagnostics(_slots(spark, sf_dir)).withColumn("mean_slots", half_up(F.col("mean_slots"), 6))


def tile_margin(spark, sf_dir):
    return n.tile_margin(_slots(spark, sf_dir)).withColumn("reach", half_up(F.col("reach"), 6))


def resolve_stop_members(spark, sf_dir):
    return s.resolve_stops(frame(spark, sf_dir, "v_stops"), frame(spark, sf_dir, "v_stations"), 100.0)


def nearest_station(spark, sf_dir):
    found = nearest(frame(spark, sf_dir, "v_stops").select("stop_id", "lon", "lat"), frame(spark, sf_dir, "v_stations").select("station_id", "lon", "lat"), "stop_id", "station_id", 2000.0)
    return found.select("stop_id", "station_id", half_up(F.col("distance"), 3).alias("distance"))


def coach_stop_attach(spark, sf_dir):
    return s.attach_coach_stops(frame(spark, sf_dir, "v_stops"), frame(spark, sf_dir, "v_stations"), 90.0)


def _rolled(spark, sf_dir):
    stops, stations = frame(spark, sf_dir, "v_stops"), frame(spark, sf_dir, "v_stations")
    served = s.resolve_stops(stops, stations).join(stops.select("stop_id", "line_id"), "stop_id").where("station_id is not null").select("station_id", "line_id")
    return served, stations, s.rollup(stations, served, frame(spark, sf_dir, "v_lines"))


def station_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir)[2].select("station_id", "n_lines", F.array_join("modes", ",").alias("modes"), "coach_only", "major")


def stop_rank(spark, sf_dir):
    return s.ranked(_rolled(spark, sf_dir)[2]).select("station_id", "rank")


def rank_counts(spark, sf_dir):
    return s.rank_counts(s.ranked(_rolled(spark, sf_dir)[2]))


def line_station_names(spark, sf_dir):
    served, stations, _ = _rolled(spark, sf_dir)
    return s.line_station_names(served, stations).select("line_id", F.array_join("stations", "; ").alias("stations"))


def marks_by_tier(spark, sf_dir):
    return s.marks_by_tier(s.ranked(_rolled(spark, sf_dir)[2])).groupBy("min_zoom").agg(F.count("*").alias("stations"), F.min("label_zoom").alias("label_zoom"))


def places_valid(spark, sf_dir):
    c = frame(spark, sf_dir, "customer")
    rows = c.select(
        "c_custkey", F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "town").when(F.col("c_custkey") % 3 == 1, "city").otherwise("village").alias("kind"),
        (F.col("c_acctbal") / 20).alias("lon"), (F.col("c_custkey") % 120).cast("double").alias("lat"), F.when(F.col("c_custkey") % 4 == 0, "many").otherwise(F.col("c_custkey").cast("string")).alias("population"),
    )
    return s.places(rows).select("c_custkey", "name", "kind", "population")


QUERIES = {f.__name__: f for f in (classify_mode, line_key, collapse_lines, colour_normalise, fallback_colour_fnv, text_on, colour_precedence, registry_counts, lines_per_way, bundle_segments, slot_ordinals, slot_diagnostics, tile_margin, resolve_stop_members, nearest_station, coach_stop_attach, station_rollup, stop_rank, rank_counts, line_station_names, marks_by_tier, places_valid)}

_REL = ctes("v_relations")
_MODE = r"""CASE WHEN route IN ('subway', 'tram') THEN route WHEN route = 'light_rail' THEN 'suburban' WHEN route NOT IN ('train', 'monorail', 'funicular') THEN NULL
    WHEN coalesce(service, '') IN ('high_speed', 'long_distance') THEN 'longdistance' WHEN coalesce(service, '') IN ('car', 'car_shuttle', 'motorail') THEN NULL
    WHEN regexp_matches(trim(coalesce(ref, '')), '(?i)^S\s?\d+') OR coalesce(service, '') = 'commuter' THEN 'suburban'
    WHEN regexp_matches(trim(coalesce(ref, '')), '(?i)^(ICE|IC|EC|ECE|NJ|EN|RJ|TGV|THA|FLX|D|CNL)\s*\d*') THEN 'longdistance'
    WHEN coalesce(service, '') IN ('regional', 'night') OR trim(coalesce(ref, '')) <> '' THEN 'regional' END"""
_PICK = r"""CASE WHEN ref IS NULL THEN '' WHEN NOT contains(ref, ';') THEN trim(ref) ELSE coalesce(
    list_filter(list_transform(string_split(ref, ';'), lambda t: trim(t)), lambda t: regexp_matches(t, '(?i)^(ICE|IC|EC|ECE|RE|RB|S|U|STR|FLX|NJ|EN|RJ|TGV)\s?\d'))[1], trim(string_split(ref, ';')[1])) END"""
_NAME = r"trim(regexp_replace(regexp_replace(CASE WHEN strpos(name, ':') BETWEEN 2 AND 7 THEN regexp_replace(name, '^[^:]*:', '') ELSE name END, '\s*=>\s*', ' – ', 'g'), '\s+', ' ', 'g'))"
_NAMED = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in style.NAMED.items()) + " END"
_COLOUR = rf"CASE WHEN regexp_matches(c, '^#[0-9a-f]{{6}}$') THEN c WHEN regexp_matches(c, '^#[0-9a-f]{{3}}$') THEN '#' || c[2] || c[2] || c[3] || c[3] || c[4] || c[4] ELSE {_NAMED} END"
_LINES = f"""{_REL}, m AS (SELECT *, {_MODE} AS mode, {_PICK} AS own_ref, lower(trim(colour)) AS c, coalesce(network_short, network, '') AS net FROM v_relations),
    keyed AS (SELECT *, {_COLOUR} AS own, lower(mode || '|' || net || '|' || CASE WHEN own_ref <> '' THEN own_ref ELSE trim(string_split(name, ':')[1]) END) AS line_id FROM m WHERE mode IS NOT NULL),
    lines AS (SELECT line_id, arg_min(mode, ord) AS mode, arg_min(own_ref, ord) AS ref, arg_min({_NAME}, ord) AS name, arg_min(operator, ord) AS operator, arg_min(net, ord) AS network,
        arg_min(own, ord) FILTER (own IS NOT NULL) AS own, count(*) AS relations FROM keyed GROUP BY line_id)"""
_WAYS = f"""{ctes("v_line_ways", "v_lines")}, sets AS (SELECT way_id, list_sort(list(line_id)) AS line_ids FROM v_line_ways GROUP BY way_id),
    segs AS (SELECT line_ids, min(way_id) AS seg_id, count(*) AS ways FROM sets GROUP BY line_ids),
    members AS (SELECT seg_id, unnest(line_ids) AS line_id FROM segs),
    slots AS (SELECT m.seg_id, m.line_id, row_number() OVER (PARTITION BY m.seg_id ORDER BY CASE mode WHEN 'regional' THEN 40 ELSE 30 END DESC,
        regexp_extract(ref, '^[A-Z]*'), CAST(regexp_extract(ref, '\\d+') AS INTEGER), m.line_id) - 1 AS ordinal, count(*) OVER (PARTITION BY m.seg_id) AS size
        FROM members m JOIN v_lines l ON m.line_id = l.line_id),
    placed AS (SELECT seg_id, line_id, CAST(ordinal AS INTEGER) AS ordinal, ordinal - (size - 1) / 2.0e0 AS slot FROM slots)"""


def _stops(radius: float, inclusive: bool = False) -> str:
    return f"""{ctes("v_stops", "v_stations", "v_lines")},
    near AS (SELECT s.stop_id, t.station_id, {d.metres("s.lon", "s.lat", "t.lon", "t.lat")} AS distance FROM v_stops s JOIN v_stations t
        ON abs(s.lat - t.lat) < 0.05 AND abs(s.lon - t.lon) < 0.08 WHERE {d.metres("s.lon", "s.lat", "t.lon", "t.lat")} {"<=" if inclusive else "<"} {radius}),
    first AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY distance, station_id) = 1),
    resolved AS (SELECT s.stop_id, s.line_id, CASE WHEN e.station_id IS NOT NULL THEN 'exact' WHEN f.station_id IS NOT NULL THEN 'nearest' ELSE 'unmatched' END AS how, coalesce(e.station_id, f.station_id) AS station_id
        FROM v_stops s LEFT JOIN v_stations e ON s.station_ref = e.station_id LEFT JOIN first f ON s.stop_id = f.stop_id)"""


_ROLL = f"""{_stops(300.0)}, calls AS (SELECT DISTINCT r.station_id, r.line_id, l.mode FROM resolved r JOIN v_lines l ON r.line_id = l.line_id WHERE r.station_id IS NOT NULL),
    sums AS (SELECT station_id, count(*) AS n_lines, list_sort(list_distinct(list(mode))) AS modes FROM calls GROUP BY station_id),
    rolled AS (SELECT t.station_id, t.name, coalesce(n_lines, 0) AS n_lines, coalesce(modes, []) AS modes, regexp_matches(t.name, '\\b(Hbf|Hauptbahnhof)\\b') AS major FROM v_stations t LEFT JOIN sums s ON t.station_id = s.station_id),
    ranked AS (SELECT *, CASE WHEN len(modes) > 0 AND len(list_filter(modes, lambda m: m <> 'tram')) = 0 THEN 3 WHEN list_contains(modes, 'longdistance') OR major AND n_lines >= 3 THEN 0 WHEN n_lines >= 3 OR major OR len(modes) >= 2 THEN 1 ELSE 2 END AS rank FROM rolled)"""
_PITCH = "2.804e0 * 1.4e0 * 1.02e0"

SQL = {
    "classify_mode": f"{_REL} SELECT id, {_MODE} AS mode FROM v_relations",
    "line_key": f"{_LINES} SELECT id, mode, line_id FROM keyed",
    "collapse_lines": f"{_LINES} SELECT line_id, mode, ref, name, operator, network, relations FROM lines",
    "colour_normalise": f"{_REL} SELECT id, {_COLOUR} AS colour FROM (SELECT id, lower(trim(colour)) AS c FROM v_relations)",
    "fallback_colour_fnv": f"""{_LINES}, keys AS (SELECT line_id, mode, network || '|' || ref AS k FROM lines),
        steps AS (SELECT line_id, mode, k, 0 AS i, CAST(2166136261 AS UBIGINT) AS h FROM keys UNION ALL
            SELECT line_id, mode, k, i + 1, (xor(h, CAST(ascii(k[i + 1]) AS UBIGINT)) * 16777619) % 4294967296 FROM steps WHERE i < length(k)),
        done AS (SELECT line_id, mode, CASE WHEN h >= 2147483648 THEN CAST(h AS BIGINT) - 4294967296 ELSE CAST(h AS BIGINT) END AS h FROM steps WHERE i = length(k))
        SELECT line_id, h AS hash, CASE WHEN mode = 'longdistance' THEN '#e30513' ELSE [{", ".join(f"'{c}'" for c in style.PALETTE)}][CAST(abs(h) % 8 AS INTEGER) + 1] END AS colour FROM done""",
    "text_on": """WITH c AS (SELECT c_custkey, [(v // 65536) / 255.0e0, (v // 256 % 256) / 255.0e0, (v % 256) / 255.0e0] AS rgb FROM (SELECT c_custkey, (c_custkey * 104729) % 16777216 AS v FROM customer)),
        l AS (SELECT c_custkey, list_transform(rgb, lambda x: CASE WHEN x <= 0.04045e0 THEN x / 12.92e0 ELSE power((x + 0.055e0) / 1.055e0, 2.4e0) END) AS g FROM c)
        SELECT c_custkey, CASE WHEN 0.2126e0 * g[1] + 0.7152e0 * g[2] + 0.0722e0 * g[3] > 0.179e0 THEN '#1a1a1a' ELSE '#ffffff' END AS text FROM l""",
    "colour_precedence": f"""{_LINES}, o AS (SELECT DISTINCT line_id FROM keyed WHERE ord % 50 = 7)
        SELECT l.line_id, CASE WHEN o.line_id IS NOT NULL THEN 'override' WHEN own IS NOT NULL THEN 'osm' ELSE 'fallback' END AS colour_source, CASE WHEN o.line_id IS NOT NULL THEN '#123456' ELSE own END AS colour
        FROM lines l LEFT JOIN o ON l.line_id = o.line_id""",
    "registry_counts": f"{_LINES} SELECT mode, count(*) AS lines, count(*) FILTER (own IS NOT NULL) AS coloured FROM lines GROUP BY mode",
    "lines_per_way": f"{_WAYS} SELECT way_id, CAST(len(line_ids) AS BIGINT) AS lines FROM sets",
    "bundle_segments": f"{_WAYS} SELECT array_to_string(line_ids, ',') AS line_ids, CAST(ways AS INTEGER) AS ways, seg_id AS first_way FROM segs",
    "slot_ordinals": f"{_WAYS} SELECT seg_id, line_id, ordinal, slot FROM placed",
    "slot_diagnostics": f"""{_WAYS}, gaps AS (SELECT max(gap) AS widest_gap FROM (SELECT max(slot) - min(slot) + 1 - count(*) AS gap FROM placed GROUP BY seg_id)),
        own AS (SELECT count(*) FILTER (n > 1) AS moving_lines, {d.half_up("avg(n)", 6)} AS mean_slots FROM (SELECT count(DISTINCT slot) AS n FROM placed GROUP BY line_id)) SELECT moving_lines, mean_slots, widest_gap FROM own, gaps""",
    "tile_margin": f"""{_WAYS}, w AS (SELECT max(abs(slot)) AS widest FROM placed), r AS (SELECT widest, widest * {_PITCH} * 1.6e0 + 3.364e0 * 1.4e0 * 1.6e0 * 2.1e0 / 2 AS reach FROM w)
        SELECT widest, {d.half_up("reach", 6)} AS reach, CAST(ceil(reach / 2.0e0) AS BIGINT) AS margin FROM r""",
    "resolve_stop_members": f"{_stops(100.0)} SELECT stop_id, how, station_id FROM resolved",
    "nearest_station": f"{_stops(2000.0)} SELECT stop_id, station_id, {d.half_up('distance', 3)} AS distance FROM first",
    "coach_stop_attach": f"{_stops(90.0, True)} SELECT s.stop_id, coalesce(CAST(f.station_id AS VARCHAR), 'coach-' || CAST(s.stop_id AS VARCHAR)) AS station_id, f.station_id IS NULL AS own FROM v_stops s LEFT JOIN first f ON s.stop_id = f.stop_id",
    "station_rollup": f"{_ROLL} SELECT station_id, n_lines, array_to_string(modes, ',') AS modes, FALSE AS coach_only, major FROM rolled",
    "stop_rank": f"{_ROLL} SELECT station_id, rank FROM ranked",
    "rank_counts": f"{_ROLL} SELECT rank, count(*) AS stations, count(*) FILTER (n_lines = 0) AS orphans FROM ranked GROUP BY rank",
    "line_station_names": f"{_ROLL} SELECT c.line_id, string_agg(DISTINCT t.name, '; ' ORDER BY t.name) AS stations FROM (SELECT DISTINCT station_id, line_id FROM resolved WHERE station_id IS NOT NULL) c JOIN v_stations t ON c.station_id = t.station_id GROUP BY c.line_id",
    "marks_by_tier": f"{_ROLL} SELECT CAST(CASE rank WHEN 0 THEN 6 WHEN 1 THEN 9 WHEN 2 THEN 11 ELSE 12 END AS INTEGER) AS min_zoom, count(*) AS stations, min(CASE rank WHEN 0 THEN 8.0e0 WHEN 1 THEN 10.0e0 WHEN 2 THEN 12.0e0 ELSE 13.5e0 END) AS label_zoom FROM ranked GROUP BY rank",
    "places_valid": """SELECT c_custkey, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'town' ELSE 'city' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey END AS population
        FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 3 <> 2 AND c_acctbal / 20 BETWEEN -180 AND 180 AND c_custkey % 120 <= 90""",
}
