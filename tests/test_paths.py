"""Paths on the rail graph with their geometry, against a search one by one and the shapes of small networks."""

import heapq
import math
import random

import pytest

from trackweave.operators import graph, network, paths

K = 111_320.0
WAYS = "way_id string, coords array<struct<lon:double,lat:double>>, ref int, service boolean"
CLOSURES = "id int, from_lon double, from_lat double, to_lon double, to_lat double, refs array<int>"


def at(x, y):
    return 9.7 + x / (K * math.cos(math.radians(52.4))), 52.4 + y / K


def way(name, *points, ref=None, service=False):
    return name, [dict(zip(("lon", "lat"), at(*p), strict=True)) for p in points], ref, service


def metres(a, b):
    return math.hypot((b[0] - a[0]) * K * math.cos(math.radians(a[1])), (b[1] - a[1]) * K)


def found(spark, ways, asked):
    """asked: id -> (from, to, refs); for each closure kind, metres, ways and coords in metres."""
    table = spark.createDataFrame([(i, *at(*a), *at(*b), refs) for i, (a, b, refs) in asked.items()], CLOSURES)
    out = {}
    for r in paths.closure_paths(table, spark.createDataFrame(ways, WAYS)).collect():
        coords = r["coords"] and [(round((p["lon"] - 9.7) * K * math.cos(math.radians(52.4))), round((p["lat"] - 52.4) * K)) for p in r["coords"]]
        out[r["id"]] = (r["kind"], r["metres"] and round(r["metres"]), r["ways"], coords)
    return out


def test_shapes(spark):
    """Small networks side by side, some 100 km apart."""
    shift = lambda n, w: (f"{n}-{w[0]}", [{"lon": p["lon"] + 2 * n, "lat": p["lat"]} for p in w[1]], w[2], w[3])
    networks = [
        [way("main", (0, 0), (1000, 0), (2000, 0)), way("branch", (1000, 0), (1000, 1200))],
        [way("west-a", (0, 0), (0, 900), ref=1700), way("west-b", (0, 900), (2000, 900), ref=1700), way("west-c", (2000, 900), (2000, 0), ref=1700), way("direct", (0, 0), (2000, 0), ref=2200)],
        [way("gap", (0, 0), (1000, 0)), way("tagged", (1000, 0), (2000, 0), ref=1700), way("a", (0, 0), (0, 400), ref=1700), way("b", (0, 400), (1000, 400), ref=1700), way("c", (1000, 400), (1000, 0), ref=1700)],
        [way("running-a", (0, 0), (1000, 600)), way("running-b", (1000, 600), (2000, 0)), way("yard", (0, 0), (2000, 0), service=True)],
        [way("a", (0, 0), (400, 0), (1000, 0)), way("b", (1000, 0), (2000, 0)), way("c", (3000, 0), (2500, 0), (2000, 0)), way("branch-1", (1000, 0), (1000, 800)), way("branch-2", (2000, 0), (2000, 800))],
        [way("north", (0, 0), (1000, 0)), way("south", (0, -4000), (1000, -4000))],
    ]
    asked = [(0, (0, 0), (1000, 1200), []), (1, (0, 0), (2000, 0), [1700]), (1, (0, 0), (2000, 0), []), (2, (0, 0), (2000, 0), [1700]), (3, (0, 0), (2000, 0), []), (4, (1000, 0), (2000, 0), []), (4, (390, 0), (2510, 0), []), (4, (2510, 0), (390, 0), []), (5, (0, 0), (1000, -4000), []), (5, (0, 40_000), (0, 0), []), (5, (1000, 20), (1000, -20), [])]
    rows = [(k, at(*a)[0] + 2 * n, at(*a)[1], at(*b)[0] + 2 * n, at(*b)[1], refs) for k, (n, a, b, refs) in enumerate(asked)]
    got = {r["id"]: r for r in paths.closure_paths(spark.createDataFrame(rows, CLOSURES), spark.createDataFrame([shift(n, w) for n, ws in enumerate(networks) for w in ws], WAYS)).collect()}
    names = {k: r["ways"] and [w.split("-", 1)[1] for w in r["ways"]] for k, r in got.items()}
    flat = {k: r["coords"] and [(round((p["lon"] - 9.7 - 2 * asked[k][0]) * K * math.cos(math.radians(52.4))), round((p["lat"] - 52.4) * K)) for p in r["coords"]] for k, r in got.items()}
    assert names == {0: ["main", "branch"], 1: ["west-a", "west-b", "west-c"], 2: ["direct"], 3: ["gap", "tagged"], 4: ["running-a", "running-b"], 5: ["b"], 6: ["a", "b", "c"], 7: ["c", "b", "a"], 8: None, 9: None, 10: None}
    assert flat[0] == [(0, 0), (1000, 0), (1000, 1200)] and round(got[0]["metres"]) == 2200
    assert flat[5] == [(1000, 0), (2000, 0)] and round(got[5]["metres"]) == 1000
    assert flat[6] == [(400, 0), (1000, 0), (2000, 0), (2500, 0)] == flat[7][::-1] and round(got[6]["metres"]) == 2100 and round(got[6]["cost"]) == 3000
    assert [got[k]["kind"] for k in (8, 9, 10)] == ["unmatched", "unmatched", "point"] and flat[10] == [(1000, 20)]


def test_a_path_whose_ends_lie_the_other_way_is_left_whole(spark):
    from pyspark.sql import functions as F

    line = [(0.0, 0.0), (0.001, 0.0), (0.002, 0.0), (0.003, 0.0)]
    rows = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in line], {"lon": a, "lat": 0.0}, {"lon": b, "lat": 0.0}) for a, b in ((0.0011, 0.0028), (0.0028, 0.0011), (0.001, 0.001), (-1.0, 5.0))], "coords array<struct<lon:double,lat:double>>, a struct<lon:double,lat:double>, b struct<lon:double,lat:double>")
    got = [[p["lon"] for p in r["c"]] for r in rows.select(paths.trimmed(F.col("coords"), F.col("a"), F.col("b")).alias("c")).collect()]
    whole = [x for x, _ in line]
    assert got == [whole[1:], whole, whole, whole]


def test_random_networks_as_by_search(spark):
    r = random.Random(4)
    nodes = [(r.randrange(9000), r.randrange(9000)) for _ in range(60)]
    ways = []
    for n in range(110):
        a, b = r.sample(nodes, 2)
        if math.dist(a, b) < 4_500:
            ways.append(way(f"w{n}", a, ((a[0] + b[0]) / 2 + r.randrange(300), (a[1] + b[1]) / 2), b, ref=r.choice([None, 1, 2]), service=r.random() < 0.1))
    asked = {k: (*r.sample(nodes, 2), r.choice([[], [1], [2]])) for k in range(25)}
    got = found(spark, ways, asked)
    point = lambda p: (p["lon"], p["lat"])
    for k, (a, b, refs) in asked.items():
        start, end, best, heap, done = at(*a), at(*b), {}, [], set()
        ends = {point(p) for w in ways for p in (w[1][0], w[1][-1])}
        snap = lambda p: min(((metres(p, q), q) for q in ends), default=None)
        if snap(start)[0] > 1 or snap(end)[0] > 1:
            continue  # a place without a way
        s, t = snap(start)[1], snap(end)[1]
        budget = max(8000, 3.5 * metres(start, end)) * (4 if refs else 1)
        heap, best = [(0.0, s, [])], {}
        while heap:
            cost, node, trail = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = (cost, trail)
            for name, coords, ref, service in ways:
                for c in (coords, coords[::-1]):
                    if point(c[0]) == node:
                        m = sum(metres(point(p), point(q)) for p, q in zip(coords, coords[1:]))
                        step = cost + m * (4 if refs and ref is not None and ref not in refs else 1) * (4 if service else 1)
                        if step <= budget:
                            heapq.heappush(heap, (step, point(c[-1]), [*trail, name]))
        if t in best and s != t:
            assert got[k][0] == "section" and got[k][2] == best[t][1], k
            assert got[k][3][0] == a and got[k][3][-1] == b
        elif math.dist(a, b) >= 101:
            assert got[k][0] == "unmatched", k


def test_long_paths_are_ranked_in_few_rounds(spark, monkeypatch):
    n = 700
    edges = spark.createDataFrame([(i, i + 1, 1.0, None, False, str(i)) for i in range(n)], "src int, dst int, metres double, ref int, service boolean, edge_id string")
    trips = spark.createDataFrame([(1, 0, n)], "trip_id int, source int, target int")
    reached = edges.selectExpr("1 AS trip_id", "dst AS node", "CAST(dst AS DOUBLE) AS cost", "dst AS hops", "src AS previous", "edge_id AS via")
    reached = reached.unionByName(spark.createDataFrame([(1, 0, 0.0, 0, None, None), (1, -5, 9.0, 1, 0, "x")], reached.schema))
    rounds, write = [], graph.Rounds.settled
    monkeypatch.setattr(graph.Rounds, "settled", lambda self, df: rounds.append(self) or write(self, df))
    got = sorted((r["hops"], r["node"], r["via"]) for r in graph.path_nodes(reached, trips).collect())
    assert got == [(i, i, str(i - 1) if i else None) for i in range(n + 1)] and len(rounds) <= 2 * 13


def test_parity_of_a_long_chain(spark, monkeypatch):
    n = 4_000
    r = random.Random(2)
    names = r.sample(range(10**6), n)
    odd = [r.randrange(2) for _ in range(n - 1)]
    forest = spark.createDataFrame([(names[i], names[i + 1], odd[i]) if r.random() < 0.5 else (names[i + 1], names[i], odd[i]) for i in range(n - 1)], "a int, b int, odd int")
    rounds, write = [], graph.Rounds.settled
    monkeypatch.setattr(graph.Rounds, "settled", lambda self, df: rounds.append(1) or write(self, df))
    got = {r["node"]: (r["component"], r["parity"]) for r in graph.parities(spark.createDataFrame([(x,) for x in names], "node int"), forest).collect()}
    root = names.index(min(names))
    side = [0]
    for o in odd:
        side.append(side[-1] ^ o)
    assert got == {x: (min(names), side[i] ^ side[root]) for i, x in enumerate(names)} and len(rounds) <= 20
