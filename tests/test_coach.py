"""Coach lines: clipping, gaps, calling order and the lines built from a feed, by value."""

import pytest

from trackweave.operators import coach

BOX = (0.0, 0.0, 10.0, 10.0)


def clipped(spark, points):
    rows = spark.createDataFrame([("s", 0, n, float(x), float(y)) for n, (x, y) in enumerate(points)], "shape_id string, part long, seq int, lon double, lat double")
    runs = {}
    for r in coach.clip(rows, BOX).orderBy("run", "n").collect():
        runs.setdefault(r["run"], []).append((round(r["lon"], 9), round(r["lat"], 9)))
    return list(runs.values())


@pytest.mark.parametrize(
    "points, expected",
    [
        ([(1, 1), (2, 5), (9, 9)], [[(1, 1), (2, 5), (9, 9)]]),  # inside
        ([(5, 5), (15, 5)], [[(5, 5), (10, 5)]]),  # leaves
        ([(-5, 5), (15, 5)], [[(0, 5), (10, 5)]]),  # crosses, no point inside
        ([(5, 5), (15, 5), (15, 8), (5, 8)], [[(5, 5), (10, 5)], [(10, 8), (5, 8)]]),  # leaves and returns
        ([(-5, 20), (15, 20)], []),  # misses
        ([(-5, 5), (5, 15)], []),  # touches a corner
        ([(-5, 0), (5, 0), (8, 0)], [[(0, 0), (5, 0), (8, 0)]]),  # along the edge
        ([(11, 5), (5, 5), (5, 11)], [[(10, 5), (5, 5), (5, 10)]]),  # enters and leaves in one run
    ],
)
def test_clip(spark, points, expected):
    assert clipped(spark, points) == expected


def test_gaps_and_lines_of_a_feed(spark):
    routes = spark.createDataFrame([("keep", "r1", "FLX 10", "73d700"), ("drop", "r2", "FLX 11", "73d700"), ("keep", "r3", "FLX 12", "no colour"), ("keep", "r4", "FLX 13", None)], "agency_id string, route_id string, route_short_name string, route_color string")
    trips = spark.createDataFrame([("r1", "minor", "t0"), ("r1", "major", "t1"), ("r1", "major", "t2"), ("r2", "major", "t3"), ("r3", "far", "t4"), ("r4", "minor", "t5")], "route_id string, shape_id string, trip_id string")
    # One degree of longitude at the equator is 111 km: the third step of `major` is a gap, the others aren't.
    shapes = {"minor": [(1.0, 1.0), (1.1, 1.0)], "major": [(1.0, 0.0), (1.1, 0.0), (1.2, 0.0), (5.0, 0.0), (5.1, 0.0)], "far": [(50.0, 50.0), (50.1, 50.0)]}
    points = spark.createDataFrame([(s, n, x, y) for s, own in shapes.items() for n, (x, y) in enumerate(own)], "shape_id string, seq int, lon double, lat double")
    times = spark.createDataFrame([("t1", "b", 20), ("t1", "a", 10), ("t1", "c", 30), ("t2", "z", 1), ("t0", "y", 1), ("t5", "q", 2), ("t5", "p", 1)], "trip_id string, stop_id string, stop_sequence int")
    parts = {(r["shape_id"], r["seq"]): r["part"] for r in coach.split_gaps(points).collect()}
    assert [parts["major", n] for n in range(5)] == [0, 0, 0, 1, 1] and parts["minor", 1] == 0
    got = {r["route_id"]: r.asDict() for r in coach.coach_lines(routes, trips, points, times, ["keep"], BOX, "FLX").collect()}
    assert set(got) == {"r1", "r4"}  # r2 is another agency's, r3 has no part in the box
    assert (got["r1"]["line_id"], got["r1"]["ref"], got["r1"]["colour"], got["r1"]["parts"], got["r1"]["points"], got["r1"]["stops"]) == ("coach|keep|10", "10", "#73d700", 2, 5, ["a", "b", "c"])
    assert (got["r4"]["colour"], got["r4"]["parts"], got["r4"]["points"], got["r4"]["stops"]) == (None, 1, 2, ["p", "q"])
    lines = coach.lines_per_stop(spark.createDataFrame([(r["line_id"], r["stops"]) for r in got.values()], "line_id string, stops array<string>"))
    assert {r["stop_id"]: r["lines"] for r in lines.collect()} == {s: ["coach|keep|10"] for s in "abc"} | {s: ["coach|keep|13"] for s in "pq"}
