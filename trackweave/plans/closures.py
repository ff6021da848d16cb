"""Queries on closures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.functions.geo import half_up, mercator_to_degrees
from trackweave.operators import closures as c
from trackweave.plans import dialect as d
from trackweave.plans.views import ctes, frame


def _raw(spark, sf_dir):
    """Register records made of orders."""
    o = frame(spark, sf_dir, "orders")
    spelt = F.get(F.array(*[F.lit(x) for x in (*c.EFFECTS, "NEU")]), F.pmod("o_orderkey", F.lit(7)).cast("int"))
    ways = F.get(F.array(*[F.lit(x) for x in (*c.DIRECTIONS, "?")]), F.pmod("o_orderkey", F.lit(4)).cast("int"))
    point = lambda k: F.struct((1_095_000 + F.pmod(F.col("o_orderkey") * k, F.lit(9973))).cast("double").alias("x"), (6_625_000 + F.pmod(F.col("o_orderkey") * k, F.lit(9967))).cast("double").alias("y"))
    return o.select(
        F.col("o_orderkey").alias("id"), spelt.alias("wirkung"), ways.alias("richtung"), F.col("o_orderpriority").alias("arbeiten"),
        F.array((F.col("o_custkey") % 9).cast("int"), (F.col("o_orderkey") % 5).cast("int"), (F.col("o_custkey") % 9).cast("int")).alias("routes"),
        F.concat(F.lit(" Von "), F.col("o_custkey").cast("string"), F.lit("  ")).alias("name_from"), F.lit("FBT   ").alias("code_from"), point(7919).alias("point_from"),
        F.lit(" Bis").alias("name_to"), F.lit("HH ").alias("code_to"), point(31).alias("point_to"), F.col("o_orderdate").alias("begin"), F.col("o_orderdate").alias("end"),
    )


def closure_normalise(spark, sf_dir):
    rows = c.normalise(_raw(spark, sf_dir))
    return rows.select("id", "effect", "direction", "works", F.array_join("routes", ",").alias("routes"), F.col("from.name").alias("from_name"), F.col("from.code").alias("from_code"), half_up(F.col("from.lon"), 5).alias("lon"), half_up(F.col("from.lat"), 5).alias("lat"))


def mercator_to_wgs84(spark, sf_dir):
    lon, lat = mercator_to_degrees(F.col("point_to")["x"], F.col("point_to")["y"])
    return _raw(spark, sf_dir).select("id", half_up(lon, 7).alias("lon"), half_up(lat, 7).alias("lat"))


def weekday_mask(spark, sf_dir):
    named = frame(spark, sf_dir, "v_windows").groupBy("id").agg(F.collect_set(F.get(F.array(*map(F.lit, c.WEEKDAYS)), F.weekday("day"))).alias("days"))
    return named.select("id", c.weekday_mask(F.col("days")).alias("mask"))


def span_band(spark, sf_dir):
    days = c.span_days(F.col("begin_day"), F.col("end_day"))
    return frame(spark, sf_dir, "v_reading_2").select("id", days.alias("days"), c.band(days).alias("band"))


def _with_windows(spark, sf_dir):
    days = frame(spark, sf_dir, "v_windows")
    one = F.struct(F.col("day").alias("from"), F.col("day").alias("to"), c.weekday_bit(F.col("day")).alias("days"), "from_time", "to_time")
    return days.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("windows"), F.min("day").alias("day"))


def windows_on_day(spark, sf_dir):
    return _with_windows(spark, sf_dir).select("id", "day", F.explode(c.windows_on(F.col("windows"), F.col("day"))).alias("w")).select("id", "day", "w.from_time", "w.to_time")


def hours_text(spark, sf_dir):
    return _with_windows(spark, sf_dir).select("id", c.hours_text(c.windows_on(F.col("windows"), F.col("day"))).alias("hours"))


def compact_windows(spark, sf_dir):
    return c.compact_days(frame(spark, sf_dir, "v_windows"))


def _state(spark, sf_dir):
    return frame(spark, sf_dir, "v_reading_1").withColumn("withdrawn", F.col("id") % 9 == 0)


FIRST, LAST = "1996-01-01", "1996-12-31"
_ASKED = "DATE '1992-01-01' + CAST(s_suppkey * 37 % 2400 AS INT)"


def plan_diff(spark, sf_dir):
    return c.plan_diff(_state(spark, sf_dir), frame(spark, sf_dir, "v_reading_2"), F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))


def withdrawn_in_window(spark, sf_dir):
    return plan_diff(spark, sf_dir).where("e = 'withdrawn'").select("id")


def interval_overlaps(spark, sf_dir):
    """Closures of the plan and the spans of days, of a day to some years, that are asked for."""
    asked = frame(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ask_id", f"{_ASKED} AS first_day", f"{_ASKED} + CAST(s_suppkey % 40 * (s_suppkey % 40) AS INT) AS last_day")
    return c.interval_pairs(frame(spark, sf_dir, "v_reading_1").select("id", "begin_day", "end_day"), asked, ("begin_day", "end_day"), ("first_day", "last_day")).select("id", "ask_id")


def log_replay(spark, sf_dir):
    return c.replay(frame(spark, sf_dir, "v_log")).select("id", "since", "first_end", "end_day", "revisions", F.size("moves").alias("n_moves"), "withdrawn")


def end_moves_packed(spark, sf_dir):
    return c.replay(frame(spark, sf_dir, "v_log")).select("id", c.pack_moves(F.col("moves")).alias("moves"))


def closure_progress(spark, sf_dir):
    rows = frame(spark, sf_dir, "v_reading_2").join(frame(spark, sf_dir, "v_reading_1").select("id", F.col("end_day").alias("first_end")), "id", "left")
    total, gone, left, through, first = c.progress(F.col("begin_day"), F.col("end_day"), F.col("first_end"), F.lit("1996-06-15").cast("date"))
    return rows.select("id", total, gone, left, half_up(through, 9).alias("through"), half_up(first, 9).alias("first_end_at"))


def event_tally(spark, sf_dir):
    return frame(spark, sf_dir, "v_log").groupBy("e").agg(F.count("*").alias("n"))


def closure_history_join(spark, sf_dir):
    return c.with_history(frame(spark, sf_dir, "v_reading_1"), c.replay(frame(spark, sf_dir, "v_log")))


def closure_severity_order(spark, sf_dir):
    return c.drawing_order(frame(spark, sf_dir, "v_reading_1")).select("id", "effect", "draw_order")


QUERIES = {f.__name__: f for f in (closure_normalise, mercator_to_wgs84, weekday_mask, span_band, windows_on_day, hours_text, compact_windows, plan_diff, withdrawn_in_window, interval_overlaps, log_replay, end_moves_packed, closure_progress, event_tally, closure_history_join, closure_severity_order)}

_LON = lambda k: f"degrees((1095000 + (o_orderkey * {k}) % 9973) / 6378137.0e0)"
_LAT = lambda k: f"degrees(2 * atan(exp((6625000 + (o_orderkey * {k}) % 9967) / 6378137.0e0)) - pi() / 2)"
_BIT = "CAST(power(2, isodow({0}) - 1) AS INTEGER)"
_LIVE = f"""{ctes("v_log", "v_reading_1")},
    starts AS (SELECT *, max(CASE WHEN e = 'planned' THEN seq END) OVER (PARTITION BY id) AS start FROM v_log),
    live AS (SELECT *, last_value(end_day IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM starts WHERE start IS NOT NULL AND seq >= start),
    moves AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back FROM live WHERE e = 'revised' AND end_day IS NOT NULL AND was <> end_day),
    packed AS (SELECT id, count(*) AS n_moves, string_agg(CAST(t AS VARCHAR) || ':' || CAST(was AS VARCHAR) || '>' || CAST(end_day AS VARCHAR), ';' ORDER BY seq) FILTER (back <= 6) AS moves FROM moves GROUP BY id),
    state AS (SELECT l.id, arg_min(t, seq) AS since, arg_min(end_day, seq) AS first_end, arg_max(end_day, seq) FILTER (end_day IS NOT NULL) AS end_day, count(*) FILTER (e = 'revised') AS revisions, arg_max(e, seq) = 'withdrawn' AS withdrawn FROM live l GROUP BY l.id)"""
_DIFF = f"""{ctes("v_reading_1", "v_reading_2")},
    joined AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS known, b.id IS NOT NULL AS fresh, coalesce(a.id % 9 = 0, FALSE) AS withdrawn, a.begin_day AS ab, b.begin_day AS bb, a.end_day AS ae, b.end_day AS be, a.effect AS af, b.effect AS bf
        FROM v_reading_1 a FULL JOIN v_reading_2 b ON a.id = b.id),
    told AS (SELECT *, CASE WHEN fresh AND NOT known THEN 'planned' WHEN fresh AND (ab <> bb OR ae <> be OR af <> bf OR withdrawn) THEN 'revised'
        WHEN known AND NOT fresh AND NOT withdrawn AND ab <= DATE '{LAST}' AND ae >= DATE '{FIRST}' THEN 'withdrawn' END AS e FROM joined),
    diff AS (SELECT id, e, CASE WHEN e = 'revised' AND ab <> bb THEN ab END AS was_begin_day, CASE WHEN e = 'planned' OR e = 'revised' AND ab <> bb THEN bb END AS now_begin_day,
        CASE WHEN e = 'revised' AND ae <> be THEN ae END AS was_end_day, CASE WHEN e = 'planned' OR e = 'revised' AND ae <> be THEN be END AS now_end_day,
        CASE WHEN e = 'revised' AND af <> bf THEN af END AS was_effect, CASE WHEN e = 'planned' OR e = 'revised' AND af <> bf THEN bf END AS now_effect FROM told WHERE e IS NOT NULL)"""
_RANK = "CASE effect WHEN 'closed' THEN 4 WHEN 'single-track' THEN 3 WHEN 'diverted' THEN 2 WHEN 'slower' THEN 1 ELSE 0 END"

SQL = {
    "closure_normalise": f"""SELECT o_orderkey AS id, ['closed', 'single-track', 'single-track', 'diverted', 'slower', 'other', 'other'][CAST(o_orderkey % 7 AS INTEGER) + 1] AS effect,
        ['both', 'with-km', 'against-km', 'both'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS direction, o_orderpriority AS works,
        array_to_string(list_sort(list_distinct([o_custkey % 9, o_orderkey % 5])), ',') AS routes, 'Von ' || CAST(o_custkey AS VARCHAR) AS from_name, 'FBT' AS from_code,
        {d.half_up(f"round({_LON(7919)}, 6)", 5)} AS lon, {d.half_up(f"round({_LAT(7919)}, 6)", 5)} AS lat FROM orders""",
    "mercator_to_wgs84": f"SELECT o_orderkey AS id, {d.half_up(_LON(31), 7)} AS lon, {d.half_up(_LAT(31), 7)} AS lat FROM orders",
    "weekday_mask": f"{ctes('v_windows')} SELECT id, bit_or({_BIT.format('day')}) AS mask FROM v_windows GROUP BY id",
    "span_band": f"{ctes('v_reading_2')} SELECT id, CAST(end_day - begin_day + 1 AS INTEGER) AS days, CASE WHEN end_day - begin_day + 1 <= 3 THEN 'days' WHEN end_day - begin_day + 1 <= 31 THEN 'weeks' ELSE 'months' END AS band FROM v_reading_2",
    "windows_on_day": f"{ctes('v_windows')}, firsts AS (SELECT id, min(day) AS day FROM v_windows GROUP BY id) SELECT w.id, w.day, from_time, to_time FROM v_windows w JOIN firsts f ON w.id = f.id AND w.day = f.day",
    "hours_text": f"{ctes('v_windows')}, firsts AS (SELECT id, min(day) AS day FROM v_windows GROUP BY id) SELECT w.id, string_agg(from_time || '–' || to_time, ', ' ORDER BY from_time) AS hours FROM v_windows w JOIN firsts f ON w.id = f.id AND w.day = f.day GROUP BY w.id",
    "compact_windows": f"""{ctes('v_windows')}, numbered AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY id, from_time, to_time ORDER BY day) AS INTEGER) AS island FROM v_windows)
        SELECT id, from_time, to_time, min(day) AS from_day, max(day) AS to_day, bit_or({_BIT.format('day')}) AS days FROM numbered GROUP BY id, from_time, to_time, island""",
    "plan_diff": f"{_DIFF} SELECT * FROM diff",
    "interval_overlaps": f"""{ctes('v_reading_1')}, asked AS (SELECT s_suppkey AS ask_id, {_ASKED} AS first_day, {_ASKED} + CAST(s_suppkey % 40 * (s_suppkey % 40) AS INT) AS last_day FROM supplier)
        SELECT id, ask_id FROM v_reading_1 JOIN asked ON begin_day <= last_day AND end_day >= first_day""",
    "withdrawn_in_window": f"{_DIFF} SELECT id FROM diff WHERE e = 'withdrawn'",
    "log_replay": f"{_LIVE} SELECT s.id, since, first_end, end_day, revisions, CAST(coalesce(n_moves, 0) AS INTEGER) AS n_moves, withdrawn FROM state s LEFT JOIN packed p ON s.id = p.id",
    "end_moves_packed": f"{_LIVE} SELECT s.id, coalesce(moves, '') AS moves FROM state s LEFT JOIN packed p ON s.id = p.id",
    "closure_progress": f"""{ctes("v_reading_1", "v_reading_2")}, r AS (SELECT b.id, b.begin_day, b.end_day, a.end_day AS first_end, b.end_day - b.begin_day + 1 AS total FROM v_reading_2 b LEFT JOIN v_reading_1 a ON a.id = b.id),
        g AS (SELECT *, greatest(0, least(total, DATE '1996-06-15' - begin_day + 1)) AS gone FROM r)
        SELECT id, CAST(total AS INTEGER) AS total, CAST(gone AS INTEGER) AS gone, CAST(total - gone AS INTEGER) AS left_over, {d.half_up("CAST(gone AS DOUBLE) / total", 9)} AS through,
            CASE WHEN first_end < end_day THEN {d.half_up("least(1.0e0, greatest(0.0e0, CAST(first_end - begin_day + 1 AS DOUBLE) / total))", 9)} END AS first_end_at FROM g""",
    "event_tally": f"{ctes('v_log')} SELECT e, count(*) AS n FROM v_log GROUP BY e",
    "closure_history_join": f"""{_LIVE} SELECT r.id, r.begin_day, r.end_day, r.effect, s.since, s.first_end, coalesce(s.revisions, 0) AS revisions, coalesce(p.moves, '') AS moves
        FROM v_reading_1 r LEFT JOIN state s ON r.id = s.id LEFT JOIN packed p ON r.id = p.id""",
    "closure_severity_order": f"{ctes('v_reading_1')} SELECT id, effect, row_number() OVER (ORDER BY {_RANK}, id) AS draw_order FROM v_reading_1",
}
