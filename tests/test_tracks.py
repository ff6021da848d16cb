"""Parallel tracks and what links them, against ways tried one by one; the shapes of double tracks, in metres about latitude 52.26."""

import math
import random
from collections import defaultdict

import numpy as np

from trackweave.functions.geo import METRES_PER_DEGREE
from trackweave.operators import tracks

K = 111_320.0
WAYS = "way_id string, coords array<struct<lon:double,lat:double>>"


def _key(point):
    return round(point[0] * 1e7), round(point[1] * 1e7)


def gap(p, q):
    return math.hypot((q[0] - p[0]) * METRES_PER_DEGREE * math.cos(math.radians(p[1])), (q[1] - p[1]) * METRES_PER_DEGREE)


def sampled(coords, every):
    """Vertices, and points at whole multiples of `every` along the line."""
    out, at = [tuple(coords[0])], 0.0
    for p, q in zip(coords, coords[1:], strict=False):
        end = at + gap(p, q)
        k = math.floor(at / every) + 1
        while k * every < end:
            t = (k * every - at) / (end - at)
            out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
            k += 1
        out.append(tuple(q))
        at = end
    return out


def near(point, a, b, tolerance):
    k = METRES_PER_DEGREE * math.cos(math.radians(point[1]))
    ax, ay, dx, dy = (a[0] - point[0]) * k, (a[1] - point[1]) * METRES_PER_DEGREE, (b[0] - a[0]) * k, (b[1] - a[1]) * METRES_PER_DEGREE
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(ax + t * dx, ay + t * dy) <= tolerance


def collapse_group(ways, tolerance):
    """Ids to keep of ways (id, coords, lines, kept outright), tried one by one; then the links."""
    length = {i: sum(gap(p, q) for p, q in zip(c, c[1:], strict=False)) for i, c, _, _ in ways}
    ordered = sorted(ways, key=lambda w: (not w[3], -w[2], -length[w[0]], w[0]))
    kept, dropped, laid = [], [], []
    for i, c, _, before in ordered:
        if not before and tolerance > 0 and all(any(near(x, *g, tolerance) for g in laid) for x in sampled(c, tolerance)):
            dropped.append(i)
            continue
        kept.append(i)
        laid += list(zip(c, c[1:], strict=False))
    coords = {i: c for i, c, _, _ in ways}
    ends = {i: (_key(coords[i][0]), _key(coords[i][-1])) for i in coords}
    group: dict = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for i in kept:
        group[root(ends[i][0])] = root(ends[i][1])
    at = {e: root(e) for i in kept for e in ends[i]}  # stretches of what is kept, before links join them
    anchored, links = set(at.values()), []
    for i in sorted((i for i in dropped if length[i] <= 2 * tolerance), key=lambda i: (length[i], i)):
        x, y = (at.get(e, e) for e in ends[i])
        if root(x) != root(y):
            links.append((i, x, y))
            group[root(x)] = root(y)
    while True:  # dead ends don't reconnect anything
        degree = defaultdict(int)
        for _, x, y in links:
            degree[x] += 1
            degree[y] += 1
        live = [k for k in links if all(n in anchored or degree[n] > 1 for n in k[1:])]
        if len(live) == len(links):
            return kept + [i for i, _, _ in links]
        links = live


def way(*points):
    return np.array([(10.52 + x / (K * math.cos(math.radians(52.26))), 52.26 + y / K) for x, y in points])


def east(x, length, y=0.0):
    return way((x, y), (x + length, y))


def frames(spark, ways, lines=None):
    shapes = spark.createDataFrame([(i, [{"lon": float(a), "lat": float(b)} for a, b in c]) for i, c in ways.items()], WAYS).repartition(3)
    return shapes, spark.createDataFrame([(line, i) for i in ways for line in range((lines or {}).get(i, 1))], "line_id int, way_id string")


def canonical(spark, ways, lines=None, tolerance=15.0):
    shapes, line_ways = frames(spark, ways, lines)
    return {r["way_id"]: r["linked"] for r in tracks.canonical_ways(line_ways, shapes, tolerance).collect()}


CASES = {
    "the opposite track goes": ({"up": east(0, 800), "down": east(0, 800, 4)}, 15, {"up"}),
    "two streets stay": ({"up": east(0, 800), "down": east(0, 800, 40)}, 15, {"up", "down"}),
    "a turnout stays": ({"main": east(0, 800), "turnout": way((0, 0), (800, 60))}, 15, {"main", "turnout"}),
    "ways of one track stay": ({"first": east(0, 400), "second": east(400, 400)}, 15, {"first", "second"}),
    "a track cut elsewhere goes": ({"up": east(0, 900), "a": east(0, 300, 4), "b": east(300, 300, 4), "c": east(600, 300, 4)}, 15, {"up"}),
    "the track that stays is whole": ({"upA": east(0, 300), "upB": east(300, 300), "downA": east(0, 300, 4), "downB": east(300, 300, 4)}, 15, {"upA", "upB"}),
    "a crossover comes back": ({"upA": east(0, 400), "downA": east(0, 400, 4), "crossover": way((400, 0), (410, 4)), "downB": east(410, 400, 4)}, 15, {"upA", "crossover", "downB"}),
    "a whole track does not": ({"up": east(0, 900), "down": east(0, 900, 4), "farther": east(900, 400, 4)}, 15, {"up", "farther"}),
    "a branch stays": ({"trunk": east(0, 800), "back": east(0, 800, 4), "branch": way((800, 0), (800, 500))}, 15, {"trunk", "branch"}),
}


def test_shapes(spark):
    """All shapes as one network, each some kilometres from the next."""
    ways = {(n, i): np.asarray(c) + [0.1 * n, 0] for n, (own, _, _) in enumerate(CASES.values()) for i, c in own.items()}
    found = canonical(spark, {f"{n} {i}": c for (n, i), c in ways.items()}, tolerance=15.0)
    for n, (name, (own, tolerance, expected)) in enumerate(CASES.items()):
        assert {x.split(" ", 1)[1] for x in found if x.startswith(f"{n} ")} == expected == set(collapse_group([(i, c, 1, False) for i, c in own.items()], tolerance)), name


def test_a_link_of_several_ways_comes_back_without_its_dead_end(spark):
    ways = {"left": east(0, 400), "linkA": east(400, 15), "linkB": east(415, 15), "right": east(430, 400), "deadEnd": way((415, 0), (415, 4))}
    shapes, _ = frames(spark, ways)
    line_ways = spark.createDataFrame([(1, i) for i in ways], "line_id int, way_id string")
    lines = spark.createDataFrame([(1, "regional")], "line_id int, mode string")
    from pyspark.sql import functions as F

    found = tracks.collapse_tracks(line_ways, shapes.withColumn("lines", F.lit(1)), lines, spark.createDataFrame([("left",), ("right",)], "way_id string"))
    assert {r["way_id"] for r in found.collect()} == {"left", "linkA", "linkB", "right"}


def test_the_busier_track_stays(spark):
    far = lambda x: x + [0.1, 0]
    ways = {"a": east(0, 900), "b": east(0, 700, 6), "c": far(east(0, 700)), "d": far(east(0, 700, 6))}
    assert canonical(spark, ways, {"b": 3, "d": 3}, 20.0).keys() == {"a", "b", "d"}


def made_network(seed):
    r = random.Random(seed)
    ways = {}
    for c in range(6):
        base = c * 3_000
        for y in (0, r.choice([4, 6, 9])):
            x, n = base, 0
            while x < base + 1_200:
                length = r.choice([20, 35, 120, 180, 310])
                if r.random() < 0.85:
                    ways[f"{c}-{y}-{n}"] = way((x, y), (x + length / 2, y + r.choice([0, 0, 1])), (x + length, y))
                x, n = x + length, n + 1
        for n in range(5):
            a, b = r.choice(list(ways.values())), r.choice(list(ways.values()))
            if np.hypot(*((a[0] - b[-1]) * [68_000, K])) < 39 and (a[0] != b[-1]).any():
                ways[f"{c}-x-{n}"] = np.array([a[0], b[-1]])
            stub = r.choice(list(ways.values()))[0]
            ways[f"{c}-s-{n}"] = np.array([stub, stub + [0, r.choice([8, -14]) / K]])
    return ways, {i: r.randint(1, 3) for i in ways}


def test_a_network_as_one_by_one(spark):
    ways, lines = made_network(1)
    found = canonical(spark, ways, lines, 20.0)
    assert set(found) == set(collapse_group([(i, c, lines[i], False) for i, c in ways.items()], 20.0)) and any(found.values()) and len(found) < len(ways)


def test_lines_follow_the_canonical_track(spark):
    from pyspark.sql import functions as F

    ways, lines = made_network(3)
    shapes, line_ways = frames(spark, ways, lines)
    known = tracks.canonical_ways(line_ways, shapes, 20.0).cache()
    modes = spark.createDataFrame([(0, "tram"), (1, "regional"), (2, "coach")], "line_id int, mode string")
    got = defaultdict(set)
    for r in tracks.collapse_tracks(line_ways, shapes.withColumn("lines", F.lit(0)), modes, known).collect():
        got[r["line_id"]].add(r["way_id"])
    settled = {r["way_id"] for r in known.collect()}
    for line, tolerance in ((0, 15.0), (1, 20.0), (2, 0.0)):
        own = [(i, c, 0, i in settled) for i, c in ways.items() if lines[i] > line]
        assert got[line] == set(collapse_group(own, tolerance))


def test_ways_without_geometry(spark):
    shapes = spark.createDataFrame([("a", [{"lon": 10.5, "lat": 52.2}]), ("b", None), ("c", [])], WAYS)
    line_ways = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "line_id int, way_id string")
    assert tracks.canonical_ways(line_ways, shapes).count() == 0
