"""Queries on the track network, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import bearing, half_up
from trackweave.operators import closures as c
from trackweave.operators import graph as g
from trackweave.operators import lines as n
from trackweave.operators import network as w
from trackweave.operators import paths as p
from trackweave.operators import tapers as tp
from trackweave.operators import tracks as t
from trackweave.operators.spatial import nearest
from trackweave.plans import dialect as d
from trackweave.plans import closures, lines
from trackweave.plans.views import ctes, frame

LON = "9.5e0 + ({0} * 7919 % 9973) / 400000.0e0"
LAT = "52.1e0 + ({0} * 104729 % 9967) / 400000.0e0"


#: Customers whose places fill one cell of the whole network; the next ones lie in a cell of their own, so that a larger table is a wider network and not a denser one.
BLOCK, CELL, ROW = 400, "0.03e0", 200


def _placed_ways(customers, lon, lat):
    """A way over the places of three customers in turn for every second one, and short ones for every fifth."""
    place = lambda k: f"named_struct('lon', {lon.format(k)}, 'lat', {lat.format(k)})"
    long = customers.where("c_custkey % 2 = 0").selectExpr("c_custkey * 2 AS way_id", f"array({place('c_custkey')}, {place('(c_custkey + 1)')}, {place('(c_custkey + 2)')}) AS coords", "CAST(c_custkey % 9 AS INT) AS ref", "c_custkey % 13 = 0 AS service")
    short = customers.where("c_custkey % 5 = 0").selectExpr("c_custkey * 2 + 1 AS way_id", f"array({place('c_custkey')}, {place('(c_custkey + 37)')}) AS coords", "CAST(NULL AS INT) AS ref", "false AS service")
    return long.unionByName(short)


WIDE_LON = f"({LON} + {CELL} * ({{0}} div {BLOCK} % {ROW}))"
WIDE_LAT = f"({LAT} + {CELL} * ({{0}} div {BLOCK} div {ROW}))"
#: A stop lies beside the places of fifteen customers each, in the cell of theirs.
STOP_LON = f"({LON.format('(stop_id * 5)')} + 0.0003e0 + {CELL} * (stop_id * 15 div {BLOCK} % {ROW}))"
STOP_LAT = f"({LAT.format('(stop_id * 3)')} + {CELL} * (stop_id * 15 div {BLOCK} div {ROW}))"
_DUCK = lambda x: x.replace(" div ", " // ")


def _network(spark, sf_dir):
    """Ways of all customers."""
    return _placed_ways(frame(spark, sf_dir, "customer"), WIDE_LON, WIDE_LAT)


def _in_cell(way_id, groups):
    """Ids of so many groups of ways in each cell; a way_id is about twice its customer's number."""
    return way_id % groups + groups * F.floor(way_id / (2 * BLOCK))


def rail_graph_edges(spark, sf_dir):
    return p.rail_graph(_network(spark, sf_dir)).select("way_id", "src", "dst", half_up(F.col("metres"), 3).alias("metres"), "forward")


def nearest_node(spark, sf_dir):
    stops = frame(spark, sf_dir, "v_stops").selectExpr("stop_id", f"{STOP_LON} AS lon", f"{STOP_LAT} AS lat")
    found = nearest(stops, p.graph_nodes(_network(spark, sf_dir)), "stop_id", "node", p.SNAP_METRES)
    return found.select("stop_id", half_up(F.col("distance"), 3).alias("distance"))


def _trips(spark, sf_dir):
    s = frame(spark, sf_dir, "supplier")
    return s.selectExpr("s_suppkey AS trip_id", "s_suppkey AS source", "s_suppkey + 37 * (s_suppkey % 3) + 2 AS target", "CASE WHEN s_suppkey % 8 = 0 THEN array(CAST(s_suppkey % 9 AS INT)) ELSE CAST(array() AS ARRAY<INT>) END AS refs", "4000.0D AS budget")


def batch_routes(spark, sf_dir):
    edges, trips = frame(spark, sf_dir, "v_edges").drop("way_id"), _trips(spark, sf_dir)
    return g.arrivals(g.batch_routes(edges, trips), trips).select("trip_id", half_up(F.col("cost"), 3).alias("cost"))


def _restrictions(spark, sf_dir):
    """A closure between the places of neighbouring customers for each supplier."""
    s = frame(spark, sf_dir, "supplier")
    effect = F.get(F.array(*map(F.lit, c.EFFECT_RANK)), (F.col("id") % len(c.EFFECT_RANK)).cast("int"))
    return s.selectExpr("s_suppkey AS id", f"{WIDE_LON.format('s_suppkey')} AS from_lon", f"{WIDE_LAT.format('s_suppkey')} AS from_lat", f"{WIDE_LON.format('(s_suppkey + s_suppkey % 3)')} AS to_lon", f"{WIDE_LAT.format('(s_suppkey + s_suppkey % 3)')} AS to_lat", "array(CAST(s_suppkey % 9 AS INT)) AS refs").withColumn("effect", effect)


def closure_layer(spark, sf_dir):
    state = c.replay(frame(spark, sf_dir, "v_log"))
    rows = p.closure_layer(_restrictions(spark, sf_dir), _network(spark, sf_dir), state)
    return rows.select("id", "kind", half_up(F.col("cost"), 3).alias("cost"), "draw_rank", F.col("revisions").cast("bigint").alias("revisions"))


def closure_paths(spark, sf_dir):
    rows = p.closure_paths(_restrictions(spark, sf_dir), _network(spark, sf_dir))
    first, last = F.get("coords", F.lit(0)), F.get("coords", F.size("coords") - 1)
    return rows.select("id", "kind", half_up(F.col("metres"), 3).alias("metres"), F.when(F.col("coords").isNotNull(), F.size("coords")).alias("points"), F.when(F.col("ways").isNotNull(), F.size("ways")).alias("ways"), first["lon"].alias("first_lon"), last["lat"].alias("last_lat"))


#: Double tracks for each twelve customers, in metres from the corridor's origin: the upper one has gaps, crossovers and stubs hang on it.
_CORRIDOR, _M_LAT, _M_LON = 12, "(1 / 111320.0e0)", "(1 / 68141.6e0)"
_UP_X, _DOWN_X = "(100.0e0 * ({0}) + ({0}) * 37 % 23 * 0.7e0)", "(100.0e0 * ({0}) + 30 + ({0}) * 29 % 19 * 0.9e0)"
#: Number, condition on the place j in the corridor, and both ends.
_TRACKS = (
    (0, "j % 5 <> 3", (_UP_X.format("j"), "0"), (_UP_X.format("j + 1"), "0")),
    (1, "j % 6 <> 5", (_DOWN_X.format("j"), "5"), (_DOWN_X.format("j + 1"), "5")),
    (2, "j % 4 = 2", (_UP_X.format("j"), "0"), (_DOWN_X.format("j"), "5")),
    (3, "j % 3 = 1", (_UP_X.format("j"), "0"), (_UP_X.format("j"), "-12")),
)


def _track_place(x, y, name, div):
    return f"9.5e0 + 0.03e0 * (k {div} {_CORRIDOR} % 200) + {x} * {_M_LON} AS {name}_lon, 52.26e0 + 0.01e0 * (k {div} {_CORRIDOR} {div} 200) + {y} * {_M_LAT} AS {name}_lat"


def _track_sql(customers, div):
    parts = (f"SELECT k * 4 + {i} AS way_id, k, {_track_place(*a, 'a', div)}, {_track_place(*b, 'b', div)} FROM places WHERE {ok}" for i, ok, a, b in _TRACKS)
    return f"WITH places AS (SELECT c_custkey AS k, c_custkey % {_CORRIDOR} AS j FROM {customers}) " + " UNION ALL ".join(parts)


def _double_tracks(spark, sf_dir):
    """ways (way_id, coords) and line_ways (line_id, way_id): one to three lines on each."""
    rows = spark.sql(_track_sql(f"parquet.`{sf_dir}/customer.parquet`", "div"))
    point = lambda e: F.struct(F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat"))
    ways = rows.select("way_id", "k", F.array(point("a"), point("b")).alias("coords"))
    line_ways = ways.select("way_id", "k", F.explode(F.sequence(F.lit(0), (F.col("way_id") % 3).cast("int"))).alias("n"))
    return ways.drop("k"), line_ways.select((F.floor(F.col("k") / _CORRIDOR) * 3 + F.col("n")).alias("line_id"), "way_id")


def canonical_ways(spark, sf_dir):
    ways, line_ways = _double_tracks(spark, sf_dir)
    return t.canonical_ways(line_ways, ways).select("way_id").where("way_id % 4 < 2")


def reconnected_ways(spark, sf_dir):
    ways, line_ways = _double_tracks(spark, sf_dir)
    return t.canonical_ways(line_ways, ways)


def collapse_lines_tracks(spark, sf_dir):
    """Each line's ways, measured against the network's canonical ones."""
    ways, line_ways = _double_tracks(spark, sf_dir)
    known = g.settled(t.canonical_ways(line_ways, ways))
    lines = line_ways.select("line_id").distinct().select("line_id", F.when(F.col("line_id") % 3 == 0, "tram").otherwise("regional").alias("mode"))
    return t.collapse_tracks(line_ways, ways.withColumn("lines", F.lit(0)), lines, known)


#: A corridor piece for each customer: its ends in metres, and the lines of its corridor of twelve that run on it, side by side.
_PIECE_Y, _RUNS = "(({0}) * 7 % 5 * 4.0e0)", "(j * 3 + l * 5) % 7 < 4"


def _pieces_sql(customers, numbers, div):
    """seg_id, corridor, j, line_id, slot and both ends of each line on each piece."""
    a, b = (_track_place(_UP_X.format(j), _PIECE_Y.format(j), n, div) for j, n in (("j", "a"), ("j + 1", "b")))
    return f"""SELECT k AS seg_id, j, k {div} {_CORRIDOR} * 6 + l AS line_id, {a}, {b}, row_number() OVER (PARTITION BY k ORDER BY l) - 1 - (count(*) OVER (PARTITION BY k) - 1) / 2.0e0 AS slot
        FROM (SELECT c_custkey AS k, c_custkey % {_CORRIDOR} AS j FROM {customers}) AS places, {numbers} WHERE {_RUNS}"""


def _pieces(spark, sf_dir):
    """chains, slots and lines of the corridor pieces."""
    rows = g.settled(spark.sql(_pieces_sql(f"parquet.`{sf_dir}/customer.parquet`", "(SELECT explode(sequence(0, 5)) AS l)", "div")))
    point = lambda e: F.struct(F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat"))
    chains = rows.select("seg_id", F.lit(0).alias("chain"), F.array(point("a"), point("b")).alias("coords")).dropDuplicates(["seg_id"])
    lines = rows.select("line_id").distinct().withColumn("mode", F.when(F.col("line_id") % 2 == 0, "tram").otherwise("regional"))
    slots = rows.select("seg_id", "line_id", F.col("slot").cast("double").alias("slot"))
    return chains, slots, lines


def _tapers(spark, sf_dir):
    chains, slots, lines = _pieces(spark, sf_dir)
    return chains, slots, lines, tp.resolve_tapers(chains, slots, lines)


def taper_steps(spark, sf_dir):
    *_, found = _tapers(spark, sf_dir)
    return found.steps.select("line_id", "seg_a", "step", half_up(F.col("slot"), 6).alias("slot"), "bundle", "min_zoom", half_up(p.length_of(F.col("coords")), 2).alias("metres"))


def taper_diagnostics(spark, sf_dir):
    *_, found = _tapers(spark, sf_dir)
    return found.diagnostics


def route_layer(spark, sf_dir):
    """Everything that is drawn of lines: how many metres of each part."""
    chains, slots, lines, found = _tapers(spark, sf_dir)
    rows = tp.route_layer(chains, slots, lines, found)
    return rows.groupBy("line_id", "part").agg(F.count("*").alias("n"), half_up(F.sum(p.length_of(F.col("coords"))), 1).alias("metres"))


def station_marks(spark, sf_dir):
    """Bars of a station beside the beginning of each corridor piece, at which two thirds of the lines on both sides call."""
    chains, slots, _ = _pieces(spark, sf_dir)
    ordered = slots.withColumn("ordinal", F.row_number().over(W.partitionBy("seg_id").orderBy("line_id")) - 1)
    start = F.get("coords", F.lit(0))
    stations = chains.select(F.col("seg_id").alias("station_id"), (start["lon"] + 0.0002).alias("lon"), (start["lat"] + 0.0003).alias("lat"))
    near = slots.select("line_id", F.explode(F.array("seg_id", F.col("seg_id") + 1)).alias("station_id")).join(stations.select("station_id"), "station_id").where("(line_id + station_id) % 3 <> 0")
    marks = w.station_marks(chains, ordered, stations, near)
    return marks.select("station_id", "mark", half_up(F.col("bearing"), 1).alias("bearing"), "mid", "span", F.size("lines").alias("lines"), "primary")


def _segment_ways(spark, sf_dir):
    return _network(spark, sf_dir).select(_in_cell(F.col("way_id"), 8).alias("seg_id"), F.col("way_id").alias("n"), "way_id")


def chain_ways(spark, sf_dir):
    chains = w.chain_ways(_segment_ways(spark, sf_dir), _network(spark, sf_dir), 30.0)
    return chains.select("seg_id", "chain", F.size("coords").alias("points"))


def collapse_tracks(spark, sf_dir):
    ways = _network(spark, sf_dir).withColumns({"lines": (F.col("way_id") % 3).cast("int"), "line_id": _in_cell(F.col("way_id"), 6)})
    far = 100_000_000_000_000  # past every way's id
    twin = ways.where("way_id % 4 = 0").select((F.col("way_id") + far).alias("way_id"), F.transform("coords", lambda p: F.struct((p["lon"] + 0.00002).alias("lon"), p["lat"].alias("lat"))).alias("coords"), "ref", "service", F.lit(0).alias("lines"), (_in_cell(F.col("way_id"), 6) - F.col("way_id") % 6 + (F.col("way_id") + far) % 6).alias("line_id"))
    ways = ways.unionByName(twin)
    lines = ways.select("line_id").distinct().select("line_id", F.lit("regional").alias("mode"))
    return t.collapse_tracks(ways.select("line_id", "way_id"), ways.drop("line_id"), lines)


def coorient(spark, sf_dir):
    ways = _network(spark, sf_dir)
    first, second, before, last = F.col("coords")[0], F.col("coords")[1], F.element_at("coords", -2), F.element_at("coords", -1)
    k = F.cos(F.radians(F.lit(52.1)))
    unit = lambda a, b: F.struct(((b["lon"] - a["lon"]) * k / F.hypot((b["lon"] - a["lon"]) * k, b["lat"] - a["lat"])).alias("x"), ((b["lat"] - a["lat"]) / F.hypot((b["lon"] - a["lon"]) * k, b["lat"] - a["lat"])).alias("y"))
    chains = ways.select(F.col("way_id").alias("chain_id"), p.node_key(first).alias("from_node"), p.node_key(last).alias("to_node"), unit(second, first).alias("from_dir"), unit(before, last).alias("to_dir"), ((last["lon"] - first["lon"]) * k * 111_320).alias("east"), ((last["lat"] - first["lat"]) * 111_320).alias("north"))
    return w.coorient(chains)


def _slots(spark, sf_dir):
    segments = n.bundle_segments(frame(spark, sf_dir, "v_line_ways")).withColumn("seg_id", F.array_min("way_ids"))
    return n.slot_ordinals(segments, frame(spark, sf_dir, "v_lines"))


def _near(number, n):
    """One of n places of the corridor's own 500 ways."""
    return number % n + n * F.floor(F.col("seg_id") / 500)


def taper_candidates(spark, sf_dir):
    slots = _slots(spark, sf_dir)
    ends = slots.select("seg_id").distinct().select(F.explode(F.array(F.struct(_near(F.col("seg_id"), 90).alias("node"), F.lit(-1).alias("side")), F.struct(_near(F.col("seg_id") * 7 + 1, 90).alias("node"), F.lit(1).alias("side")))).alias("e"), "seg_id").select("e.*", "seg_id", (F.col("seg_id") % 300 + 10).cast("double").alias("metres"))
    rows = w.taper_candidates(ends, slots, frame(spark, sf_dir, "v_lines"))
    return rows.select("node", "line_id", "outcome", "delta", half_up(F.col("length"), 6).alias("length"))


def taper_lengths(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 2).alias("tram"), F.pmod("l_partkey", F.lit(9)).cast("double").alias("delta"), (F.col("l_quantity") * 5).alias("up"), (F.col("l_linenumber") * 40.0).alias("down")).distinct()
    length = w.taper_length(F.when(F.col("tram") == 1, "tram").otherwise("regional"), F.col("delta"), F.col("up"), F.col("down"))
    return rows.withColumn("length", length).select("tram", "delta", "up", "down", half_up(F.col("length"), 6).alias("length"), F.when(F.col("length") > 0, w.taper_minzoom(F.col("length"))).alias("min_zoom"))


def _calls(spark, sf_dir):
    slots = _slots(spark, sf_dir)
    return slots, slots.select("seg_id", "line_id", F.explode(F.array(_near(F.col("seg_id"), 40), _near(F.col("seg_id") * 3, 40))).alias("station_id")).where("(line_id * 7 + station_id) % 3 <> 0").distinct()


def stop_mark_runs(spark, sf_dir):
    slots, calls = _calls(spark, sf_dir)
    return w.mark_runs(calls, slots).select("seg_id", "station_id", "lo", "hi", "first", F.size("lines").alias("lines"))


def stop_marks(spark, sf_dir):
    slots, calls = _calls(spark, sf_dir)
    lon, lat = F.lit(9.5) + F.col("station_id") / 1000 + (F.col("seg_id") % 5) / 50_000, F.lit(52.1) + F.col("station_id") / 1500
    drafts = w.mark_runs(calls, slots).withColumns({"lon": lon, "lat": lat}).withColumn("bearing", bearing(F.lit(9.5), F.lit(52.1), F.lit(9.5) + 0.01 * (F.col("seg_id") % 3 - 1), F.lit(52.11)) + 180 * (F.col("seg_id") % 2))
    marks = w.merge_marks(drafts.select("station_id", "seg_id", "lon", "lat", "bearing", "lo", "hi", "lines"))
    return w.primary_marks(marks).select("station_id", "mid", "span", F.size("lines").alias("lines"))


QUERIES = {f.__name__: f for f in (rail_graph_edges, nearest_node, batch_routes, closure_layer, closure_paths, canonical_ways, reconnected_ways, collapse_lines_tracks, chain_ways, collapse_tracks, coorient, taper_steps, taper_diagnostics, route_layer, station_marks, taper_candidates, taper_lengths, stop_mark_runs, stop_marks)}

_PLACES = f"""places AS (SELECT k, lon, lat, CAST(CAST(round(lon * 1000000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(lat * 1000000) AS BIGINT) AS VARCHAR) AS node
        FROM (SELECT k, {_DUCK(WIDE_LON.format("k"))} AS lon, {_DUCK(WIDE_LAT.format("k"))} AS lat FROM (SELECT unnest(range((SELECT max(c_custkey) + 40 FROM customer))) AS k))),
    members AS (SELECT c_custkey * 2 AS way_id, unnest([0, 1, 2]) AS pos, c_custkey + unnest([0, 1, 2]) AS k, 2 AS last FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey * 2 + 1, unnest([0, 1]), c_custkey + unnest([0, 37]), 1 FROM customer WHERE c_custkey % 5 = 0),
    vertices AS (SELECT m.way_id, m.pos, m.last, p.* FROM members m JOIN places p ON m.k = p.k),
    ends AS (SELECT DISTINCT node FROM vertices WHERE pos = 0 OR pos = last)"""
_SLOTS = lines._WAYS
_LENGTH = lambda tram, delta, up, down: f"CASE WHEN least(CASE WHEN {tram} THEN 40.0e0 ELSE 80.0e0 END * least(greatest(abs({delta}), 1.0e0), 3.0e0), 2 * 0.4e0 * least({up}, {down})) >= 12 THEN least(CASE WHEN {tram} THEN 40.0e0 ELSE 80.0e0 END * least(greatest(abs({delta}), 1.0e0), 3.0e0), 2 * 0.4e0 * least({up}, {down})) ELSE 0.0e0 END"

#: Ways of the double tracks tried one by one: the places (in their corridor) of those that stay.
_KEPT = f"""WITH RECURSIVE ways AS ({_track_sql("customer", "//")}),
        sized AS (SELECT *, way_id % 3 + 1 AS n_lines, {d.metres("a_lon", "a_lat", "b_lon", "b_lat")} AS m FROM ways),
        ranked AS (SELECT *, k // {_CORRIDOR} AS corridor, row_number() OVER (PARTITION BY k // {_CORRIDOR} ORDER BY n_lines DESC, m DESC, way_id) AS place FROM sized),
        points AS (SELECT way_id, corridor, place, i, a_lon + (b_lon - a_lon) * t AS lon, a_lat + (b_lat - a_lat) * t AS lat
            FROM (SELECT *, least(i * 20 / m, 1.0e0) AS t FROM (SELECT *, unnest(range(0, CAST(ceil(m / 20) AS BIGINT) + 1)) AS i FROM ranked))),
        offsets AS (SELECT p.way_id, p.i, o.place AS other, (o.a_lon - p.lon) * 111320.0e0 * cos(radians(p.lat)) AS ax, (o.a_lat - p.lat) * 111320.0e0 AS ay, (o.b_lon - o.a_lon) * 111320.0e0 * cos(radians(p.lat)) AS dx, (o.b_lat - o.a_lat) * 111320.0e0 AS dy
            FROM points p JOIN ranked o ON o.corridor = p.corridor AND o.place < p.place),
        near AS (SELECT way_id, i, other FROM (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM offsets) WHERE sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) <= 20),
        at_points AS (SELECT p.way_id, p.corridor, p.place, p.i, coalesce(list(n.other) FILTER (n.other IS NOT NULL), []) AS others FROM points p LEFT JOIN near n ON n.way_id = p.way_id AND n.i = p.i GROUP BY ALL),
        tried AS (SELECT way_id, corridor, place, list(others) AS others FROM at_points GROUP BY ALL),
        walk(corridor, place, kept) AS (SELECT DISTINCT corridor, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ranked
            UNION ALL SELECT w.corridor, r.place, CASE WHEN list_bool_and(list_transform(r.others, lambda o: list_has_any(o, w.kept))) THEN w.kept ELSE list_append(w.kept, r.place) END
            FROM walk w JOIN tried r ON r.corridor = w.corridor AND r.place = w.place + 1),
        last AS (SELECT corridor, kept FROM walk QUALIFY row_number() OVER (PARTITION BY corridor ORDER BY place DESC) = 1)"""
_END_NODE = "CAST(CAST(round({0}_lon * 10000000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round({0}_lat * 10000000) AS BIGINT) AS VARCHAR)"
#: Pieces meet end to end in their corridor, so a node has two of them at most; the line comes from the one of the smaller number.
_STEPS = f"""WITH pieces AS ({_pieces_sql("customer", "(SELECT unnest(range(6)) AS l) AS numbers", "//")}),
    sized AS (SELECT *, {d.metres("a_lon", "a_lat", "b_lon", "b_lat")} AS m, count(*) OVER (PARTITION BY seg_id) AS bundle FROM pieces),
    met AS (SELECT a.line_id, a.seg_id AS seg_a, b.seg_id AS seg_b, a.slot AS up, b.slot AS down, b.slot - a.slot AS delta, a.m AS ma, b.m AS mb, a.bundle FROM sized a JOIN sized b ON b.line_id = a.line_id AND b.seg_id = a.seg_id + 1 AND a.j < {_CORRIDOR - 1}),
    wanted AS (SELECT *, CASE WHEN line_id % 2 = 0 THEN 40.0e0 ELSE 80.0e0 END * least(greatest(abs(delta), 1.0e0), 3.0e0) AS want FROM met),
    fitted AS (SELECT *, least(want, 2 * 0.4e0 * least(ma, mb)) AS length FROM wanted),
    kinds AS (SELECT *, CASE WHEN delta = 0 THEN 'level' WHEN length < 12 THEN 'short' ELSE 'taper' END AS kind FROM fitted),
    cuts AS (SELECT line_id, seg_a, seg_a AS seg, ma AS m, length / 2 AS half FROM kinds WHERE kind = 'taper' UNION ALL SELECT line_id, seg_a, seg_b, mb, length / 2 FROM kinds WHERE kind = 'taper'),
    full_pieces AS (SELECT line_id, seg FROM cuts GROUP BY line_id, seg HAVING sum(half) >= max(m)),
    collided AS (SELECT DISTINCT c.line_id, c.seg_a FROM cuts c JOIN full_pieces f ON f.line_id = c.line_id AND f.seg = c.seg),
    kept AS (SELECT *, least(8, greatest(3, CAST(ceil(abs(delta) / 0.75e0) AS INTEGER))) AS n FROM kinds WHERE kind = 'taper' AND (line_id, seg_a) NOT IN (SELECT (line_id, seg_a) FROM collided)),
    stepped AS (SELECT *, up + delta / n * (k + 0.5e0) AS v FROM (SELECT *, unnest(range(n)) AS k FROM kept))"""

SQL = {
    "rail_graph_edges": f"""WITH {_PLACES}, steps AS (SELECT *, coalesce({d.metres("lag(lon) OVER o", "lag(lat) OVER o", "lon", "lat")}, 0) AS step FROM vertices WINDOW o AS (PARTITION BY way_id ORDER BY pos)),
        measured AS (SELECT *, sum(step) OVER (PARTITION BY way_id ORDER BY pos) AS at_m FROM steps),
        cuts AS (SELECT way_id, node AS src, lead(node) OVER o AS dst, lead(at_m) OVER o - at_m AS m FROM measured WHERE node IN (SELECT node FROM ends) WINDOW o AS (PARTITION BY way_id ORDER BY pos)),
        edges AS (SELECT * FROM cuts WHERE dst IS NOT NULL AND src <> dst)
        SELECT way_id, src, dst, {d.half_up("m", 3)} AS metres, TRUE AS forward FROM edges UNION ALL SELECT way_id, dst, src, {d.half_up("m", 3)}, FALSE FROM edges""",
    "nearest_node": f"""{ctes("v_stops")}, {_PLACES}, nodes AS (SELECT node, min(lon) AS lon, min(lat) AS lat FROM vertices WHERE pos = 0 OR pos = last GROUP BY node),
        s AS (SELECT stop_id, {_DUCK(STOP_LON)} AS lon, {_DUCK(STOP_LAT)} AS lat FROM v_stops),
        near AS (SELECT s.stop_id, {d.metres("s.lon", "s.lat", "n.lon", "n.lat")} AS distance FROM s JOIN nodes n ON abs(s.lat - n.lat) < 0.05)
        SELECT stop_id, {d.half_up("min(distance)", 3)} AS distance FROM near WHERE distance < 2000 GROUP BY stop_id""",
    "batch_routes": f"""{ctes("v_edges")}, trips AS (SELECT s_suppkey AS trip_id, s_suppkey AS source, s_suppkey + 37 * (s_suppkey % 3) + 2 AS target, CASE WHEN s_suppkey % 8 = 0 THEN CAST(s_suppkey % 9 AS INTEGER) END AS own FROM supplier),
        walk AS (SELECT trip_id, target, own, source AS node, 0.0e0 AS cost FROM trips UNION
            SELECT w.trip_id, w.target, w.own, e.dst, w.cost + e.metres * CASE WHEN w.own IS NOT NULL AND e.ref IS NOT NULL AND e.ref <> w.own THEN 4 ELSE 1 END * CASE WHEN e.service THEN 4 ELSE 1 END
            FROM walk w JOIN v_edges e ON w.node = e.src WHERE w.node <> w.target AND w.cost + e.metres * CASE WHEN w.own IS NOT NULL AND e.ref IS NOT NULL AND e.ref <> w.own THEN 4 ELSE 1 END * CASE WHEN e.service THEN 4 ELSE 1 END <= 4000)
        SELECT t.trip_id, {d.half_up("min(w.cost)", 3)} AS cost FROM trips t LEFT JOIN walk w ON t.trip_id = w.trip_id AND w.node = t.target GROUP BY t.trip_id""",
    "closure_layer": f"""WITH RECURSIVE {_PLACES}, steps AS (SELECT *, coalesce({d.metres("lag(lon) OVER o", "lag(lat) OVER o", "lon", "lat")}, 0) AS step FROM vertices WINDOW o AS (PARTITION BY way_id ORDER BY pos)),
        measured AS (SELECT *, sum(step) OVER (PARTITION BY way_id ORDER BY pos) AS at_m FROM steps),
        cuts AS (SELECT way_id, node AS src, lead(node) OVER o AS dst, lead(at_m) OVER o - at_m AS m FROM measured WHERE node IN (SELECT node FROM ends) WINDOW o AS (PARTITION BY way_id ORDER BY pos)),
        edges AS (SELECT src, dst, m, CASE WHEN way_id % 2 = 0 THEN way_id // 2 % 9 END AS ref, way_id % 2 = 0 AND way_id // 2 % 13 = 0 AS service FROM (SELECT * FROM cuts UNION ALL SELECT way_id, dst, src, m FROM cuts) WHERE src <> dst),
        nodes AS (SELECT node, min(lon) AS lon, min(lat) AS lat FROM vertices WHERE pos = 0 OR pos = last GROUP BY node),
        rows AS (SELECT s_suppkey AS id, s_suppkey % 9 AS own, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat, {d.metres("a.lon", "a.lat", "b.lon", "b.lat")} AS chord
            FROM supplier JOIN places a ON a.k = s_suppkey JOIN places b ON b.k = s_suppkey + s_suppkey % 3),
        snap AS (SELECT id, side, node FROM (SELECT id, side, n.node, {d.metres("r.lon", "r.lat", "n.lon", "n.lat")} AS m
                FROM (SELECT id, 1 AS side, alon AS lon, alat AS lat FROM rows UNION ALL SELECT id, 2, blon, blat FROM rows) r JOIN nodes n ON abs(n.lat - r.lat) < 0.05)
            WHERE m < 2000 QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY m, node) = 1),
        trips AS (SELECT r.id, r.own, r.chord, a.node AS source, b.node AS target, greatest(8000, 3.5 * chord) * 4 AS budget FROM rows r LEFT JOIN snap a ON a.id = r.id AND a.side = 1 LEFT JOIN snap b ON b.id = r.id AND b.side = 2),
        walk(id, node, cost) USING KEY (id, node) AS (SELECT id, source, 0.0e0 FROM trips WHERE chord >= 100 AND source <> target
            UNION SELECT x.id, x.node, x.cost FROM (SELECT w.id, e.dst AS node, min(w.cost + e.m * CASE WHEN e.ref <> t.own THEN 4 ELSE 1 END * CASE WHEN e.service THEN 4 ELSE 1 END) AS cost, any_value(t.budget) AS budget
                FROM walk w JOIN edges e ON e.src = w.node JOIN trips t ON t.id = w.id GROUP BY w.id, e.dst) x LEFT JOIN recurring.walk k ON k.id = x.id AND k.node = x.node WHERE x.cost <= x.budget AND (k.cost IS NULL OR x.cost < k.cost)),
        kinds AS (SELECT t.id, CASE WHEN chord < 100 THEN CASE WHEN source IS NOT NULL THEN 'point' END WHEN source <> target AND w.cost IS NOT NULL THEN 'section' END AS kind, CASE WHEN chord >= 100 THEN w.cost END AS cost
            FROM trips t LEFT JOIN walk w ON w.id = t.id AND w.node = t.target),
        log AS ({closures.SQL["log_replay"]})
        SELECT k.id, kind, {d.half_up("cost", 3)} AS cost, CAST({list(c.EFFECT_RANK.values())}[k.id % {len(c.EFFECT_RANK)} + 1] AS INTEGER) AS draw_rank, CAST(coalesce(l.revisions, 0) AS BIGINT) AS revisions FROM kinds k LEFT JOIN log l ON l.id = k.id WHERE kind IS NOT NULL""",
    "canonical_ways": f"{_KEPT} SELECT r.way_id FROM ranked r JOIN last l ON l.corridor = r.corridor WHERE list_contains(l.kept, r.place) AND r.way_id % 4 < 2",
    "reconnected_ways": f"""{_KEPT}, told AS (SELECT r.*, list_contains(l.kept, r.place) AS stays, {_END_NODE.format("a")} AS a, {_END_NODE.format("b")} AS b FROM ranked r JOIN last l ON l.corridor = r.corridor),
        meets AS (SELECT a, b FROM told WHERE stays UNION ALL SELECT b, a FROM told WHERE stays),
        stretch(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM meets
            UNION SELECT x.node, x.label FROM (SELECT m.b AS node, min(s.label) AS label FROM stretch s JOIN meets m ON m.a = s.node GROUP BY m.b) x JOIN recurring.stretch k ON k.node = x.node WHERE x.label < k.label),
        short AS (SELECT way_id, corridor, m, coalesce(s.label, a) AS x, coalesce(t.label, b) AS y FROM told LEFT JOIN stretch s ON s.node = a LEFT JOIN stretch t ON t.node = b WHERE NOT stays AND m <= 40),
        tries AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY m, way_id) AS n FROM short WHERE x <> y),
        trees(corridor, n, groups, chosen) AS (SELECT DISTINCT corridor, CAST(0 AS BIGINT), CAST([] AS VARCHAR[][]), CAST([] AS BIGINT[]) FROM tries
            UNION ALL SELECT corridor, n, CASE WHEN list_contains(own, y) THEN groups ELSE list_append(list_filter(groups, lambda g: NOT list_contains(g, x) AND NOT list_contains(g, y)), list_concat(own, other)) END, CASE WHEN list_contains(own, y) THEN chosen ELSE list_append(chosen, way_id) END
            FROM (SELECT t.corridor, r.n, r.x, r.y, r.way_id, t.groups, t.chosen, coalesce(list_filter(t.groups, lambda g: list_contains(g, r.x))[1], [r.x]) AS own, coalesce(list_filter(t.groups, lambda g: list_contains(g, r.y))[1], [r.y]) AS other
                FROM trees t JOIN tries r ON r.corridor = t.corridor AND r.n = t.n + 1)),
        forest AS (SELECT unnest(chosen) AS way_id FROM trees QUALIFY row_number() OVER (PARTITION BY corridor ORDER BY n DESC) = 1),
        live0 AS (SELECT t.way_id, t.x, t.y FROM tries t JOIN forest f ON f.way_id = t.way_id), firm AS (SELECT DISTINCT label AS node FROM stretch),
        {", ".join(f"""live{k + 1} AS (SELECT l.* FROM live{k} l WHERE NOT EXISTS (SELECT 1 FROM (SELECT node FROM (SELECT x AS node FROM live{k} UNION ALL SELECT y FROM live{k}) GROUP BY node HAVING count(*) = 1) d WHERE d.node IN (l.x, l.y) AND d.node NOT IN (SELECT node FROM firm)))""" for k in range(5))}
        SELECT way_id, FALSE AS linked FROM told WHERE stays UNION ALL SELECT way_id, TRUE FROM live5""",
    "taper_steps": f"""{_STEPS} SELECT line_id, seg_a, CAST(k AS INTEGER) AS step, {d.half_up("CASE WHEN occupied THEN v + 0.2e0 * sign(delta) ELSE v END", 6)} AS slot, CAST(bundle AS INTEGER) AS bundle,
        CAST(ceil(log2(156543.03392e0 * cos(radians(51)) / length)) AS INTEGER) AS min_zoom, {d.half_up("length / n", 2)} AS metres
        FROM (SELECT *, v > least(up, down) AND v < greatest(up, down) AND (abs(v - up - floor(v - up + 0.5)) < 1e-9 OR abs(v - down - floor(v - down + 0.5)) < 1e-9) AS occupied FROM stepped)""",
    "taper_diagnostics": f"""{_STEPS} SELECT count(*) FILTER (kind = 'taper') - (SELECT count(*) FROM collided) AS tapered, CAST(0 AS BIGINT) AS ambiguous, count(*) FILTER (kind = 'short') AS short, (SELECT count(*) FROM collided) AS collided,
        count(*) FILTER (kind = 'taper' AND length < want) AS shortened, CAST(0 AS BIGINT) AS occupied FROM kinds""",
    "taper_candidates": f"""{_SLOTS}, ends AS (SELECT seg_id % 90 + 90 * (seg_id // 500) AS node, -1 AS side, seg_id, CAST(seg_id % 300 + 10 AS DOUBLE) AS metres FROM segs UNION ALL SELECT (seg_id * 7 + 1) % 90 + 90 * (seg_id // 500), 1, seg_id, CAST(seg_id % 300 + 10 AS DOUBLE) FROM segs),
        r AS (SELECT e.node, p.line_id, e.seg_id, e.side, p.slot, e.metres, count(*) OVER w AS n, row_number() OVER (PARTITION BY e.node, p.line_id ORDER BY e.seg_id, e.side) AS i FROM ends e JOIN placed p ON e.seg_id = p.seg_id WINDOW w AS (PARTITION BY e.node, p.line_id)),
        s AS (SELECT node, line_id, max(n) AS n, count(DISTINCT seg_id) AS segments, max(slot) FILTER (i = 1) AS s1, max(slot) FILTER (i = 2) AS s2, max(side) FILTER (i = 1) AS d1, max(side) FILTER (i = 2) AS d2, max(metres) FILTER (i = 1) AS m1, max(metres) FILTER (i = 2) AS m2 FROM r GROUP BY 1, 2),
        t AS (SELECT s.*, CASE WHEN n = 2 AND segments = 2 THEN CASE WHEN d1 = d2 THEN -s2 ELSE s2 END - s1 END AS delta FROM s),
        u AS (SELECT *, CASE WHEN delta IS NOT NULL THEN {_LENGTH("FALSE", "delta", "m1", "m2")} END AS length FROM t)
        SELECT node, line_id, CASE WHEN n < 2 THEN 'ends' WHEN delta IS NULL THEN 'ambiguous' WHEN delta = 0 THEN 'level' WHEN length = 0 THEN 'short' ELSE 'taper' END AS outcome, delta, {d.half_up("length", 6)} AS length FROM u""",
    "taper_lengths": f"""WITH r AS (SELECT DISTINCT l_suppkey % 2 AS tram, CAST(l_partkey % 9 AS DOUBLE) AS delta, l_quantity * 5 AS up, l_linenumber * 40.0e0 AS down FROM lineitem), t AS (SELECT *, {_LENGTH("tram = 1", "delta", "up", "down")} AS length FROM r)
        SELECT tram, delta, up, down, {d.half_up("length", 6)} AS length, CASE WHEN length > 0 THEN CAST(ceil(log2(156543.03392e0 * cos(radians(51)) / length)) AS INTEGER) END AS min_zoom FROM t""",
    "stop_mark_runs": f"""{_SLOTS}, calls AS (SELECT DISTINCT seg_id, line_id, station_id FROM (SELECT seg_id, line_id, unnest([seg_id % 40 + 40 * (seg_id // 500), seg_id * 3 % 40 + 40 * (seg_id // 500)]) AS station_id FROM placed) WHERE (line_id * 7 + station_id) % 3 <> 0),
        hit AS (SELECT c.seg_id, c.station_id, p.slot, p.ordinal, p.ordinal - row_number() OVER (PARTITION BY c.seg_id, c.station_id ORDER BY p.ordinal) AS island FROM calls c JOIN placed p ON c.seg_id = p.seg_id AND c.line_id = p.line_id)
        SELECT seg_id, station_id, min(slot) AS lo, max(slot) AS hi, min(ordinal) AS first, CAST(count(*) AS INTEGER) AS lines FROM hit GROUP BY seg_id, station_id, island""",
}
