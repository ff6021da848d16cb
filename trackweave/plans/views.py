"""Transit tables derived from the driver's tables, in SQL that Spark and DuckDB read alike.

`text(names, dialect)` gives common table expressions; `frames` gives DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: {n40} stands for a table of the numbers under 40, in column k; {lon:k:1500} and {lat:k:1500} for the position of number k, a square for each 1,500.
VIEWS = {
    "v_lines": """
        SELECT s_suppkey AS line_id,
            CASE s_suppkey % 3 WHEN 0 THEN 'RE' WHEN 1 THEN 'RB' ELSE 'S' END || CAST(s_suppkey % 7 AS STRING) AS ref,
            CASE WHEN s_suppkey % 3 = 2 THEN 'suburban' ELSE 'regional' END AS mode, n_name AS operator
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_line_stations": """
        SELECT s_suppkey AS line_id, CASE WHEN k % 7 = 3 THEN 'Stadt Stat. ' || CAST(k AS STRING) WHEN k % 7 = 5 THEN 'Stat-ion ' || CAST(k AS STRING) || ' Bf'
            WHEN k % 2 = 1 THEN 'Station ' || CAST(k AS STRING) || ' Hauptbahnhof' ELSE 'Station ' || CAST(k AS STRING) || ' Hbf' END AS station
        FROM supplier, {n40} WHERE (7 * k + s_suppkey) % 10 < 3""",
    "v_ld_line_stations": """
        SELECT CAST(s AS BIGINT) AS line_id, 'Station ' || CAST(k AS STRING) || ' Hbf' AS station
        FROM (SELECT k AS s FROM {n4}), {n40} WHERE (31 * k + 17 * s + k * s) % 7 > 1""",
    "v_departures": """
        SELECT l_orderkey AS ride, 'Station ' || CAST(l_partkey % 40 AS STRING) || ' Hbf' AS station,
            CASE WHEN l_suppkey % 5 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'RE' WHEN 1 THEN 'RB' ELSE 'S' END || ' ' || CAST(l_suppkey % 7 AS STRING)
                ELSE CAST(l_suppkey % 7 AS STRING) END AS line_number,
            CASE WHEN l_orderkey % 10 = 0 THEN 'ICE' ELSE CASE l_suppkey % 3 WHEN 0 THEN 'RE' WHEN 1 THEN 'RB' ELSE 'S' END END AS train_type,
            l_shipdate AS planned,
            CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate + make_interval_minutes(CAST((l_quantity * l_quantity) % 60 AS INT) - 3) END AS changed,
            l_linestatus = 'F' AND l_partkey % 11 = 0 AS cancelled,
            CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS month
        FROM lineitem""",
    "v_relations": """
        SELECT p_partkey AS ord, CAST(p_partkey AS STRING) AS id,
            CASE WHEN p_size % 6 = 0 THEN 'subway' WHEN p_size % 6 = 1 THEN 'tram' WHEN p_size % 6 = 2 THEN 'light_rail' WHEN p_size % 17 = 3 THEN 'bus' ELSE 'train' END AS route,
            CASE WHEN p_partkey % 11 = 0 THEN 'high_speed' WHEN p_partkey % 11 = 1 THEN 'regional' WHEN p_partkey % 11 = 2 THEN 'car' WHEN p_partkey % 11 = 3 THEN 'commuter' ELSE NULL END AS service,
            CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 13 = 1 THEN 'ICE ' || CAST(p_size AS STRING)
                WHEN p_partkey % 13 = 2 THEN 'S ' || CAST(p_size % 9 AS STRING) WHEN p_partkey % 13 = 3 THEN '12;RE' || CAST(p_size AS STRING) ELSE 'RB ' || CAST(p_size AS STRING) END AS ref,
            p_brand AS network, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE NULL END AS network_short,
            CASE WHEN p_partkey % 3 = 0 THEN 'L' || CAST(p_size AS STRING) || ': ' || p_name || ' => ' || p_type ELSE p_name END AS name,
            CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '#Ab' || CAST(p_size % 10 AS STRING) ELSE split_part(p_name, ' ', 1) END AS colour,
            p_brand || ' rail' AS operator
        FROM part""",
    "v_line_ways": """
        SELECT DISTINCT CAST(floor(l_partkey / 500) AS BIGINT) * 12 + l_suppkey % 3 * 2 + l_partkey % 7 + CASE WHEN l_quantity > 47 THEN 1 ELSE 0 END AS line_id, l_partkey AS way_id FROM lineitem""",
    "v_stations": """
        SELECT c_custkey AS station_id, {lon:c_custkey:1500} AS lon, {lat:c_custkey:1500} AS lat,
            c_mktsegment || ' ' || CAST(c_nationkey AS STRING) || CASE WHEN c_custkey % 9 = 0 THEN ' Hbf' ELSE '' END AS name
        FROM customer""",
    "v_stops": """
        SELECT s_suppkey AS stop_id, {lon:s_suppkey * 4007:100:s_suppkey} + 0.000037 AS lon, {lat:s_suppkey * 147:100:s_suppkey} + 0.000021 AS lat,
            CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 3 ELSE NULL END AS station_ref, s_suppkey AS line_id
        FROM supplier""",
    "v_candidates": """
        SELECT 'c' || CAST(c_custkey AS STRING) || '-' || CAST(k AS STRING) AS id, CASE WHEN c_custkey % 23 = 0 THEN 'PLACE' ELSE 'STOP' END AS type, station_id,
            {lon:station_id:1500} + (c_custkey * 31 % 97 + k) / 20000.0e0 AS lon, {lat:station_id:1500} + (c_custkey * 17 % 89) / 40000.0e0 AS lat,
            CASE c_custkey % 5 WHEN 0 THEN 'Stadt Hlt ' || CAST(station_id AS STRING) WHEN 1 THEN 'Halt ' || CAST(station_id AS STRING) || ' Bahnhof' WHEN 2 THEN 'Ort Halt ' || CAST(station_id AS STRING)
                WHEN 3 THEN 'Ort Hal. ' || CAST(station_id AS STRING) ELSE 'Halt ' || CAST(station_id AS STRING) END AS name,
            CASE c_custkey % 4 WHEN 0 THEN 'REGIONAL_RAIL' WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 'BUS' ELSE 'METRO' END WHEN 2 THEN 'TRAM' ELSE '' END AS mode
        FROM (SELECT *, c_custkey - c_custkey % 4 AS station_id FROM customer ) AS own, {n2}""",
    "v_wanted": """
        SELECT c_custkey AS station_id, {lon:c_custkey:1500} AS lon, {lat:c_custkey:1500} AS lat,
            'Halt ' || CAST(c_custkey AS STRING) || ' Hbf' AS name, CASE WHEN c_custkey % 5 = 0 THEN 'tram' ELSE 'rail' END AS mode
        FROM customer""",
    "v_reading_1": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS begin_day, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS DATE) AS end_day,
            CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'closed' WHEN '2' THEN 'single-track' WHEN '3' THEN 'diverted' WHEN '4' THEN 'slower' ELSE 'other' END AS effect
        FROM orders WHERE o_orderkey % 4 <> 3""",
    "v_reading_2": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS begin_day,
            CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 + CASE WHEN o_orderkey % 6 = 0 THEN 7 ELSE 0 END AS INT) AS DATE) AS end_day,
            CASE WHEN o_orderkey % 10 = 1 THEN 'closed' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'closed' WHEN '2' THEN 'single-track' WHEN '3' THEN 'diverted' WHEN '4' THEN 'slower' ELSE 'other' END END AS effect
        FROM orders WHERE o_orderkey % 5 <> 0""",
    "v_log": """
        SELECT user_id AS id, event_id AS seq, CAST(ts AS DATE) AS t, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'error' THEN 'withdrawn' ELSE 'revised' END AS e,
            CASE WHEN event_type = 'error' THEN NULL ELSE CAST(CAST(ts AS DATE) + CAST(floor(value) AS INT) AS DATE) END AS end_day
        FROM events""",
    "v_windows": """
        SELECT DISTINCT user_id AS id, CAST(ts AS DATE) AS day, CASE WHEN hour(ts) < 8 THEN '00:00' WHEN hour(ts) < 16 THEN '08:00' ELSE '16:00' END AS from_time,
            CASE WHEN hour(ts) < 8 THEN '08:00' WHEN hour(ts) < 16 THEN '16:00' ELSE '00:00' END AS to_time
        FROM events""",
    "v_shapes": """
        SELECT user_id AS shape_id, event_id AS seq, 9.0 + (event_id * 37 % 199) / 500.0e0 AS lon, 52.0 + (event_id * 53 % 211) / 700.0e0 AS lat FROM events""",
    "v_trips": """
        SELECT o_custkey % 50 AS route_id, 10 * (o_custkey % 50) + o_custkey % 7 AS shape_id, o_orderkey AS trip_id FROM orders""",
    "v_stop_times": """
        SELECT l_orderkey AS trip_id, l_partkey % 60 AS stop_id, l_linenumber * 100 + l_suppkey % 100 AS stop_sequence FROM lineitem""",
    "v_edges": """
        SELECT c_custkey * 2 + k AS way_id, c_custkey AS src, c_custkey + CASE WHEN k = 0 THEN 1 ELSE 37 END AS dst,
            CAST(100 + (31 * c_custkey % 900) AS DOUBLE) AS metres, CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE CAST(c_custkey % 9 AS INT) END AS ref, c_custkey % 13 = 0 AS service
        FROM customer, {n2}""",
    "v_legs": """
        SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS journey_id, event_id AS idx,
            CASE event_type WHEN 'view' THEN 'REGIONAL_RAIL' WHEN 'click' THEN 'WALK' WHEN 'purchase' THEN 'HIGHSPEED_RAIL' WHEN 'signup' THEN 'BIKE' ELSE 'BUS' END AS mode,
            CAST(floor(value * 60) AS BIGINT) AS seconds, ts AS scheduled, 9.0 + (event_id * 37 % 199) / 500.0e0 AS lon, 52.0 + (event_id * 53 % 211) / 700.0e0 AS lat,
            'Stop ' || CAST(event_id % 90 AS STRING) AS from_name, 'Stop ' || CAST(event_id * 7 % 90 AS STRING) AS to_name
        FROM events""",
    "v_operator_names": """
        SELECT s_suppkey AS operator_id, CASE s_suppkey % 4 WHEN 0 THEN n_name || ' Bahn GmbH' WHEN 1 THEN n_name || ' Verkehr (' || substr(n_name, 1, 2) || ') AG'
            WHEN 2 THEN n_name || ';' || n_name || ' Lines' ELSE n_name END AS name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}


def _place(axis: str, origin: str, step: int, prime: int, k: str, block: str, of: str) -> str:
    """A position for number k: spread over one square, and a square for each `block` rows (by number `of`), so that a larger table is wider and not denser."""
    square = f"floor({of} / {block}.0e0)"
    return f"({origin}e0 + ({k} * {step} % {prime}) / 100000.0e0 + 0.12e0 * " + (f"({square} % 100))" if axis == "lon" else f"floor({square} / 100.0e0))")


def text(name: str, dialect: str, tables: dict[str, str]) -> str:
    """The view's SQL for `spark` or `duckdb`, over the named tables."""
    sql = VIEWS[name]
    for axis, origin, step, prime in (("lon", "9.7", 7919, 9973), ("lat", "52.3", 104729, 9967)):
        sql = re.sub(r"\{%s:([^:}]*):(\d+)(?::(\w+))?\}" % axis, lambda m: _place(axis, origin, step, prime, m[1], m[2], m[3] or m[1]), sql)
    for n in (2, 4, 40):
        numbers = f"(SELECT explode(sequence(0, {n - 1})) AS k)" if dialect == "spark" else f"(SELECT unnest(range({n})) AS k)"
        sql = sql.replace(f"{{n{n}}}", numbers)
    minutes = "make_interval(0, 0, 0, 0, 0, {})" if dialect == "spark" else "to_minutes({})"
    head, mark, tail = sql.partition("make_interval_minutes(")
    if mark:
        depth, at = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(tail[at], 0)
            at += 1
        sql = head + minutes.format(tail[: at - 1]) + tail[at:]
    if dialect == "spark":
        for t, source in tables.items():
            for word in ("FROM", "JOIN"):
                sql = sql.replace(f"{word} {t} ", f"{word} {source} AS {t} ").replace(f"{word} {t},", f"{word} {source} AS {t},")
                sql = sql + " " if not sql.endswith(" ") else sql
    return sql


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or one of the driver's tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(text(name, "spark", tables).strip() + " ")


def ctes(*names: str) -> str:
    """WITH clause of the views for DuckDB; other expressions may follow after a comma."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text(n, 'duckdb', {})})" for n in names)
