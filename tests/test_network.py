"""Track geometry on small networks, in metres about latitude 52."""

import inspect
import math

import numpy as np
import pytest

from trackweave.operators import graph, network, paths, resolve

K = 111_320.0


def way(*points):
    return np.array([(9.7 + x / (K * math.cos(math.radians(52.26))), 52.26 + y / K) for x, y in points])


def test_chains_join_and_stitch():
    a, b, c = ([tuple(p) for p in way(*pts)] for pts in (((0, 0), (100, 0)), ((200, 0), (100, 0)), ((210, 0), (300, 0))))
    assert [len(x) for x in network.chained([a, b, c])] == [3, 2]
    assert [len(x) for x in network.stitched(network.chained([a, b, c]), 15.0)] == [5]
    across = [tuple(p) for p in way((210, 0), (210, 90))]
    assert len(network.stitched(network.chained([a, b, across]), 15.0)) == 2
    ring = [[tuple(p) for p in way(*pts)] for pts in (((0, 0), (100, 0)), ((100, 0), (50, 80)), ((50, 80), (0, 0)))]
    assert [len(x) for x in network.chained(ring)] == [4]


def test_graph_splits_side_way_and_routes(spark):
    coords = lambda pts: [{"lon": float(x), "lat": float(y)} for x, y in way(*pts)]
    ways = spark.createDataFrame([("main", coords([(0, 0), (500, 0), (1000, 0)]), 1720, False), ("side", coords([(500, 0), (500, 400)]), None, False), ("yard", coords([(0, 0), (1000, 0)][::-1]), 9, True), ("loop", coords([(0, 0), (0, 50), (0, 0)]), 1, False)], "way_id string, coords array<struct<lon:double,lat:double>>, ref int, service boolean")
    edges = paths.rail_graph(ways)
    assert {(r["way_id"], round(r["metres"])) for r in edges.where("forward").collect()} == {("main", 500), ("side", 400), ("yard", 1000)} and edges.where("forward and way_id = 'main'").count() == 2
    x = lambda px, py: [float(v) for v in way((px, py))[0]]
    closures = spark.createDataFrame([(1, *x(0, 1), *x(500, 399), [1720]), (2, *x(0, 0), *x(30, 0), []), (3, *x(0, 0), *x(90_000, 0), []), (4, *x(50_000, 0), *x(90_000, 0), [])], "id int, from_lon double, from_lat double, to_lon double, to_lat double, refs array<int>")
    got = {r["id"]: (r["kind"], r["cost"] and round(r["cost"])) for r in paths.closure_paths(closures, ways).collect()}
    assert got == {1: ("section", 900), 2: ("point", None), 3: ("unmatched", None), 4: ("unmatched", None)}


def test_orientation(spark):
    d = lambda x, y: {"x": float(x), "y": float(y)}
    kind = "chain_id int, from_node string, to_node string, from_dir struct<x:double,y:double>, to_dir struct<x:double,y:double>, east double, north double"
    rows = [(1, "a", "b", d(-1, 0), d(1, 0), 100.0, 0.0), (2, "c", "b", d(1, 0), d(-1, 0), -60.0, 0.0), (3, "c", "d", d(-1, 0), d(1, 0), 50.0, 0.0), (4, "x", "y", d(1, 0), d(-1, 0), -10.0, 0.0)]
    got = {r["chain_id"]: r["flip"] for r in network.coorient(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_marks_merge_along_one_heading(spark):
    kind = "station_id int, seg_id int, lon double, lat double, bearing double, lo double, hi double, lines array<string>"
    rows = [(1, 1, 9.7, 52.0, 90.0, -1.0, 1.0, ["a", "b", "c"]), (1, 2, 9.7, 52.00002, 270.0, -2.0, -2.0, ["d"]), (1, 3, 9.7, 52.0, 0.0, 0.0, 0.0, ["e"]), (1, 1, 9.7, 52.0, 90.0, 3.0, 3.0, ["f"])]
    got = sorted((r["span"], r["lines"]) for r in network.merge_marks(spark.createDataFrame(rows, kind)).collect())
    assert got == [(1, ["e"]), (1, ["f"]), (4, ["a", "b", "c", "d"])]


def test_components_and_forest(spark):
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (6, 5), (8, 8)], "a int, b int")
    got = dict(tuple(r) for r in graph.components(nodes, edges).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    weighted = spark.createDataFrame([(0, 1, 3), (1, 2, 1), (0, 2, 2), (3, 4, 5)], "a int, b int, rank int")
    assert {r["rank"] for r in graph.spanning_forest(weighted).collect()} == {1, 2, 5}


def test_ambiguity_gives_none(spark):
    stations = spark.createDataFrame([(1, 9.7, 52.3, "Linden", "rail"), (2, 9.9, 52.3, "Linden", "rail")], "station_id int, lon double, lat double, name string, mode string")
    stops = spark.createDataFrame([("x", "STOP", 9.7005, 52.3, "Linden", ["BUS"]), ("y", "STOP", 9.7, 52.3006, "Linden", None), ("p", "STOP", 9.9, 52.3, "Linden", ["BUS"]), ("q", "STOP", 9.9003, 52.3, "Linden", ["REGIONAL_RAIL"]), ("z", "STOP", 9.9, 52.3, "Linden", [])], "id string, type string, lon double, lat double, name string, modes array<string>")
    got = {r["station_id"]: (r["state"], r["stop_id"]) for r in resolve.best_match(resolve.valid_candidates(stations, stops)).collect()}
    assert got == {1: ("ambiguous", None), 2: ("resolved", "q")}


def test_features_are_trimmed(spark):
    coords = [{"lon": float(x), "lat": float(y)} for x, y in way((0, 0), (100, 0), (200, 0))]
    chains = spark.createDataFrame([(1, 0, coords)], "seg_id int, chain int, coords array<struct<lon:double,lat:double>>")
    slots = spark.createDataFrame([(1, "a", -0.5), (1, "b", 0.5)], "seg_id int, line_id string, slot double")
    trims = spark.createDataFrame([(1, 0, "a", 30.0, 0.0), (1, 0, "a", 0.0, 120.0)], "seg_id int, chain int, line_id string, start_m double, end_m double")
    got = {r["line_id"]: [round((p["lon"] - 9.7) * K * math.cos(math.radians(52.26))) for p in r["coords"]] for r in network.route_features(chains, slots, trims).collect()}
    assert got == {"a": [30, 80], "b": [0, 100, 200]}


def test_anchor_is_the_nearest_vertex_of_a_line_that_calls(spark):
    p = [[float(v) for v in x] for x in way((0, 0), (70, 0), (140, 0), (5000, 0))]
    vertices = spark.createDataFrame([(1, 0, i, *x) for i, x in enumerate(p)], "seg_id int, chain int, pos int, lon double, lat double")
    stations = spark.createDataFrame([(7, p[1][0], p[1][1] + 0.0001), (8, p[1][0], p[1][1])], "station_id int, lon double, lat double")
    served = spark.createDataFrame([(7, "a"), (8, "z")], "station_id int, line_id string")
    slots = spark.createDataFrame([(1, "a", 0, 0.0)], "seg_id int, line_id string, ordinal int, slot double")
    got = [(r["station_id"], r["vertex"]["pos"]) for r in network.anchors(stations, vertices, served, slots).collect()]
    assert got == [(7, 1)]


def test_shortlist_stops_at_enough(spark):
    rows = [(1, v, r, f"e{v}{r}") for v in range(3) for r in range(4)] + [(1, 0, 9, "e00")]
    got = resolve.shortlist(spark.createDataFrame(rows, "operator_id int, variant int, rank int, entity string")).orderBy("n").collect()
    assert [r["entity"] for r in got] == ["e00", "e01", "e02", "e03", "e10", "e11", "e12", "e13"]


def test_queries_take_whole_tables(spark, tmp_path):
    from trackweave.plans import network as queries

    spark.range(1, 1001).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 91).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    ways = {2 * k for k in range(2, 1001, 2)} | {2 * k + 1 for k in range(5, 1001, 5)}
    assert sorted(r["id"] for r in queries.closure_paths(spark, tmp_path).collect()) == list(range(1, 91))
    assert {r["chain_id"] for r in queries.coorient(spark, tmp_path).collect()} == ways
    points = [r for r in queries._network(spark, tmp_path).select("way_id", "coords").collect()]
    assert {r["way_id"] for r in points} == ways and len({(p["lon"], p["lat"]) for r in points for p in r["coords"]}) > 900
    chains = queries.chain_ways(spark, tmp_path).collect()
    assert {r["seg_id"] for r in chains} == {i % 8 + 8 * (i // 800) for i in ways}
    kept = [(r["line_id"], r["way_id"]) for r in queries.collapse_tracks(spark, tmp_path).collect()]
    assert {line for line, _ in kept} == {i % 6 + 6 * (i // 800) for i in ways} and len(kept) == len(set(kept)) and {i for _, i in kept if i < 10_000} <= ways
    assert max(i for _, i in kept if i < 10_000) > 1900


def test_routes_are_never_cut_in_silence(spark):
    edges = spark.createDataFrame([(i, i + 1, 10.0, None, False) for i in range(6)], "src int, dst int, metres double, ref int, service boolean")
    trips = spark.createDataFrame([(1, 0, 6, [], 100.0), (2, 0, 6, [], 50.0)], "trip_id int, source int, target int, refs array<int>, budget double")
    reached = graph.batch_routes(edges, trips)
    assert sorted((r["trip_id"], r["cost"]) for r in graph.arrivals(reached, trips).collect()) == [(1, 60.0), (2, None)]
    assert sorted(r["node"] for r in graph.path_nodes(reached, trips).collect()) == list(range(7))
    with pytest.raises(RuntimeError):
        graph.batch_routes(edges, trips, rounds=3)
    assert inspect.signature(graph.batch_routes).parameters["rounds"].default is None


def test_routing_rounds_send_no_tables_through_the_driver(spark):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    spark.range(1).count()
    bus.waitUntilEmpty()
    seen = {e.executionId() for e in _executions(store)}
    edges = spark.createDataFrame([(i, i + 1, 10.0, None, False) for i in range(4)], "src int, dst int, metres double, ref int, service boolean")
    trips = spark.createDataFrame([(1, 0, 4, [], 100.0)], "trip_id int, source int, target int, refs array<int>, budget double")
    reached = graph.batch_routes(edges, trips)
    bus.waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in _executions(store) if e.executionId() not in seen]
    assert len(plans) > 5 and any("SortMergeJoin" in x for x in plans) and not any("BroadcastExchange" in x for x in plans)
    assert reached.count() == 5


def _executions(store):
    found = store.executionsList()
    return [found.apply(i) for i in range(found.size())]


def test_anchor_lies_on_the_segment_beside_the_vertex(spark):
    import math

    vertices = spark.createDataFrame([("a", 0, n, 9.0 + n / 1000, 52.0) for n in range(5)], "seg_id string, chain int, pos int, lon double, lat double")
    stations = spark.createDataFrame([(1, 9.0014, 52.0005), (2, 9.01, 52.0), (3, 9.0041, 52.0), (4, 9.002, 52.0)], "station_id long, lon double, lat double")
    served = spark.createDataFrame([(s, "l") for s in (1, 2, 3)] + [(4, "other")], "station_id long, line_id string")
    slots = spark.createDataFrame([("a", "l")], "seg_id string, line_id string")
    got = {r["station_id"]: r for r in network.anchors(stations, vertices, served, slots).collect()}
    assert set(got) == {1, 3}  # 2 is too far away, no line of the corridor calls at 4
    assert got[1]["vertex"]["pos"] == 1 and abs(got[1]["lon"] - 9.0014) < 1e-9 and abs(got[1]["lat"] - 52.0) < 1e-9 and abs(got[1]["distance"] - 0.0005 * 111_320) < 1e-6
    assert got[3]["lon"] == 9.004 and abs(got[3]["distance"] - 0.0001 * 111_320 * math.cos(math.radians(52.0))) < 1e-6
    marks = spark.createDataFrame([(1, 0, 0.0, 2, 90.0, ["l"])], "station_id long, mark int, mid double, span int, bearing double, lines array<string>")
    fallback = network.fallback_marks(stations, served, marks)
    assert fallback.dtypes == marks.dtypes and {r["station_id"]: (r["span"], r["lines"]) for r in fallback.collect()} == {2: (1, ["l"]), 3: (1, ["l"]), 4: (1, ["other"])}
