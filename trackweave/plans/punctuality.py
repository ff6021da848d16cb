"""Queries on punctuality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.geo import half_up
from trackweave.operators import punctuality as p
from trackweave.plans import dialect as d
from trackweave.plans.views import ctes, frame


#: Departures of a reported station here: the derived tables are thin.
LEAST = 20


def _in(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [frame(spark, sf_dir, n) for n in names]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.attributed(*_in(spark, sf_dir, "v_departures", "v_lines", "v_line_stations", "v_ld_line_stations"))


def delay_minutes(spark, sf_dir):
    rows = p.with_delay(frame(spark, sf_dir, "v_departures"))
    return rows.groupBy("delay").agg(F.count("*").alias("n"))


def row_ref(spark, sf_dir):
    departures = frame(spark, sf_dir, "v_departures")
    return p.with_told(departures, p.told_refs(departures), "ref").groupBy("line_number", "train_type", "ref").agg(F.count("*").alias("n"))


def _pairs(spark, sf_dir, fuzzy):
    departures, lines, stations = _in(spark, sf_dir, "v_departures", "v_lines", "v_line_stations")
    return p.ref_station_matches(p.told_refs(p.by_product(departures)[1]), lines, stations, fuzzy)


def ref_station_match(spark, sf_dir):
    return _pairs(spark, sf_dir, None)


def ref_station_match_fuzzy(spark, sf_dir):
    return _pairs(spark, sf_dir, "full")


def ride_containment(spark, sf_dir):
    departures, stations = _in(spark, sf_dir, "v_departures", "v_ld_line_stations")
    return p.ride_matches(p.by_product(departures)[0], stations)


def delay_histogram(spark, sf_dir):
    counters = p.delay_counters(_rows(spark, sf_dir), "line_id", "station")
    return counters.select("line_id", "station", "n", "cancelled", F.posexplode("hist").alias("bucket", "departures")).where("departures > 0")


def hist_quantile(spark, sf_dir):
    counters = p.delay_counters(_rows(spark, sf_dir), "line_id")
    return counters.select("line_id", *(p.hist_quantile(F.col("hist"), q).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9, 0.99)))


def line_scores(spark, sf_dir):
    return p.line_scores(_rows(spark, sf_dir)).drop("hist")


def station_scores(spark, sf_dir):
    return p.station_scores(_rows(spark, sf_dir), LEAST)


def share_bands(spark, sf_dir):
    bands = p.share_bands(p.line_scores(_rows(spark, sf_dir)))
    return bands.select("line_id", "band", half_up(F.col("share"), 9).alias("share"))


def worst_first(spark, sf_dir):
    return p.worst_first(p.station_scores(_rows(spark, sf_dir), LEAST)).select("line_id", "place", "station", "on_time", "n")


def match_stats(spark, sf_dir):
    departures, lines, stations, long = _in(spark, sf_dir, "v_departures", "v_lines", "v_line_stations", "v_ld_line_stations")
    return p.match_stats(departures, lines, stations, long)


def latest_months(spark, sf_dir):
    return p.latest_months(frame(spark, sf_dir, "v_departures")).groupBy("month").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (delay_minutes, row_ref, ref_station_match, ref_station_match_fuzzy, ride_containment, delay_histogram, hist_quantile, line_scores, station_scores, share_bands, worst_first, match_stats, latest_months)}

_BASE = ctes("v_departures", "v_lines", "v_line_stations", "v_ld_line_stations")
_ROWS = f"""{_BASE},
    told AS (SELECT *, {d.row_ref("line_number", "train_type")} AS ref, {d.DELAY} AS delay FROM v_departures),
    local AS (SELECT * FROM told WHERE train_type <> 'ICE')"""
_SERVED = f"""served AS (SELECT l.line_id, {d.ref("l.ref")} AS ref, s.station AS served, {d.name("s.station")} AS name, {d.name("s.station", True)} AS whole
        FROM v_lines l JOIN v_line_stations s ON l.line_id = s.line_id WHERE l.mode IN ('regional', 'suburban')),
    pairs AS (SELECT DISTINCT ref, station, {d.name("station")} AS name, {d.name("station", True)} AS whole FROM local WHERE ref <> ''),
    exact AS (SELECT p.ref, p.station, count(DISTINCT s.line_id) AS n, min(s.line_id) AS line_id FROM pairs p JOIN served s ON p.ref = s.ref AND p.name = s.name GROUP BY 1, 2)"""
_CLOSE = f"""close AS (SELECT p.ref, p.station, count(DISTINCT s.line_id) AS n, min(s.line_id) AS line_id FROM pairs p JOIN served s ON p.ref = s.ref
        WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.ref = p.ref AND e.station = p.station)
            AND {d.names_match("p.name", "p.whole", "s.name", "s.whole")} GROUP BY 1, 2),
    found AS (SELECT * FROM exact UNION ALL SELECT * FROM close)"""
_OUTCOME = """SELECT p.ref, p.station, CASE WHEN f.n IS NULL THEN 'missed' WHEN f.n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, CASE WHEN f.n = 1 THEN f.line_id END AS line_id
    FROM pairs p LEFT JOIN {found} f ON p.ref = f.ref AND p.station = f.station"""
_RIDES = f"""ride_stations AS (SELECT DISTINCT month, ride, {d.name("station")} AS name FROM v_departures WHERE train_type = 'ICE'),
    ld AS (SELECT DISTINCT line_id, {d.name("station")} AS name FROM v_ld_line_stations),
    sizes AS (SELECT month, ride, count(*) AS size FROM ride_stations GROUP BY 1, 2),
    common AS (SELECT r.month, r.ride, l.line_id, count(*) AS n FROM ride_stations r JOIN ld l ON r.name = l.name GROUP BY 1, 2, 3),
    whole AS (SELECT c.month, c.ride, count(*) AS lines, min(line_id) AS line_id FROM common c JOIN sizes s ON c.month = s.month AND c.ride = s.ride AND c.n = s.size GROUP BY 1, 2),
    rides AS (SELECT s.month, s.ride, CASE WHEN size < 2 THEN 'too small' WHEN lines IS NULL THEN 'missed' WHEN lines > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, line_id
        FROM sizes s LEFT JOIN whole w ON s.month = w.month AND s.ride = w.ride)"""
_ATTRIBUTED = f"""{_ROWS}, {_SERVED}, {_CLOSE}, {_RIDES},
    attributed AS (SELECT 'ld' || CAST(r.line_id AS VARCHAR) AS line_id, l.station, l.delay, l.cancelled, {d.BUCKET} AS b FROM told l JOIN rides r ON l.month = r.month AND l.ride = r.ride
            WHERE l.train_type = 'ICE' AND r.outcome = 'matched' AND l.delay IS NOT NULL
        UNION ALL SELECT CAST(f.line_id AS VARCHAR) AS line_id, l.station, l.delay, l.cancelled, {d.BUCKET} AS b FROM local l JOIN found f ON l.ref = f.ref AND l.station = f.station WHERE f.n = 1 AND l.delay IS NOT NULL AND l.ref <> '')"""
_HIST = "list_transform(range(26), lambda i: CAST(len(list_filter(list(CASE WHEN cancelled THEN -1 ELSE b END), lambda y: y = i)) AS BIGINT))"
_COUNTERS = f"""{_ATTRIBUTED},
    line_counts AS (SELECT line_id, count(*) AS n, count(*) FILTER (cancelled) AS cancelled, list(CASE WHEN cancelled THEN -1 ELSE b END) AS bs FROM attributed GROUP BY 1),
    lines AS (SELECT line_id, n, cancelled, list_transform(range(26), lambda i: len(list_filter(bs, lambda y: y = i))) AS hist FROM line_counts),
    station_counts AS (SELECT line_id, station, count(*) AS n, count(*) FILTER (cancelled) AS cancelled, list(CASE WHEN cancelled THEN -1 ELSE b END) AS bs FROM attributed GROUP BY 1, 2),
    at_stations AS (SELECT line_id, station, line_id || '/' || station AS key, n, cancelled, list_transform(range(26), lambda i: len(list_filter(bs, lambda y: y = i))) AS hist FROM station_counts)"""
_ON_TIME = d.half_up("CAST(list_sum(hist[1:6]) AS DOUBLE) / (n - cancelled)", 3)
_LINES = f"""{_COUNTERS},
    reported AS (SELECT * FROM lines WHERE n >= 200 AND n > cancelled AND hist[1] < n - cancelled),
    median AS ({d.quantile("hist", 0.5, "line_id", "reported")}), p90 AS ({d.quantile("hist", 0.9, "line_id", "reported")})"""
_STATIONS = f"""{_LINES},
    possible AS (SELECT s.* FROM at_stations s JOIN reported r ON s.line_id = r.line_id WHERE s.n > s.cancelled AND s.hist[1] < s.n - s.cancelled),
    floors AS (SELECT line_id, greatest({LEAST}.0e0, list_sort(list(n))[count(*) // 2 + 1] * 0.1e0) AS floor FROM possible GROUP BY 1),
    kept AS (SELECT p.* FROM possible p JOIN floors f ON p.line_id = f.line_id WHERE p.n >= f.floor),
    m AS ({d.quantile("hist", 0.5, "key", "kept")}), q AS ({d.quantile("hist", 0.9, "key", "kept")}),
    station_scores AS (SELECT k.line_id, k.station, {_ON_TIME} AS on_time, m.q AS median, q.q AS p90, k.n FROM kept k JOIN m ON k.key = m.key JOIN q ON k.key = q.key)"""

SQL = {
    "delay_minutes": f"{_ROWS} SELECT delay, count(*) AS n FROM told GROUP BY 1",
    "row_ref": f"{_ROWS} SELECT line_number, train_type, ref, count(*) AS n FROM told GROUP BY 1, 2, 3",
    "ref_station_match": f"{_ROWS}, {_SERVED} {_OUTCOME.format(found='exact')}",
    "ref_station_match_fuzzy": f"{_ROWS}, {_SERVED}, {_CLOSE} {_OUTCOME.format(found='found')}",
    "ride_containment": f"{_BASE}, {_RIDES} SELECT month, ride, outcome, CASE WHEN outcome = 'matched' THEN line_id END AS line_id FROM rides",
    "delay_histogram": f"{_COUNTERS} SELECT line_id, station, n, cancelled, bucket, departures FROM (SELECT line_id, station, n, cancelled, CAST(unnest(range(26)) AS INTEGER) AS bucket, CAST(unnest(hist) AS BIGINT) AS departures FROM at_stations) WHERE departures > 0",
    "hist_quantile": f"{_COUNTERS}, "
    + ", ".join(f"q{round(q * 100)} AS ({d.quantile('hist', q, 'line_id', 'lines')})" for q in (0.25, 0.5, 0.75, 0.9, 0.99))
    + " SELECT q25.line_id, q25.q AS p25, q50.q AS p50, q75.q AS p75, q90.q AS p90, q99.q AS p99 FROM q25 JOIN q50 USING (line_id) JOIN q75 USING (line_id) JOIN q90 USING (line_id) JOIN q99 USING (line_id)",
    "line_scores": f"{_LINES} SELECT r.line_id, {_ON_TIME} AS on_time, m.q AS median, p.q AS p90, r.n, r.cancelled, {d.half_up('CAST(r.cancelled AS DOUBLE) / r.n', 4)} AS cancel_rate FROM reported r JOIN median m ON r.line_id = m.line_id JOIN p90 p ON r.line_id = p.line_id",
    "station_scores": f"{_STATIONS} SELECT * FROM station_scores",
    "share_bands": f"""{_LINES}, parts AS (
        SELECT line_id, n, unnest(['punctual', 'slight', 'late', 'severe', 'cancelled']) AS band,
            unnest([CAST(hist[1] AS DOUBLE), CAST(list_sum(hist[2:6]) AS DOUBLE), CAST(list_sum(hist[7:16]) AS DOUBLE), CAST(list_sum(hist[17:26]) AS DOUBLE), {d.half_up(d.half_up('CAST(cancelled AS DOUBLE) / n', 4) + ' * n')}]) AS c FROM reported)
        SELECT line_id, band, {d.half_up('c / n', 9)} AS share FROM parts WHERE c > 0""",
    "worst_first": f"{_STATIONS} SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY on_time, n DESC, station) AS INTEGER) AS place, station, on_time, n FROM station_scores",
    "match_stats": f"""{_ROWS}, {_SERVED}, {_CLOSE}, {_RIDES}, matches AS ({_OUTCOME.format(found='found')})
        SELECT 'departures' AS kind, outcome, count(*) AS n FROM local l JOIN matches m ON l.ref = m.ref AND l.station = m.station WHERE l.delay IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'pairs', outcome, count(*) FROM matches WHERE EXISTS (SELECT 1 FROM local l WHERE l.ref = matches.ref AND l.station = matches.station AND l.delay IS NOT NULL) GROUP BY 2
        UNION ALL SELECT 'rides', outcome, count(*) FROM rides GROUP BY 2""",
    "latest_months": f"{_BASE} SELECT month, count(*) AS n FROM v_departures WHERE month IN (SELECT DISTINCT month FROM v_departures ORDER BY month DESC LIMIT 12) GROUP BY 1",
}
