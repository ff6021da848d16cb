"""Bars of stations across corridors, each case some kilometres from the next."""

import pytest
from trackweave.operators import network

EAST = lambda a, b, lat=52.0: [(a + n * 0.001, lat) for n in range(round((b - a) * 1000) + 1)]
NORTH = [(13.01, 51.99 + n * 0.001) for n in range(21)]
#: Corridors (lines, vertices) and the station (place, lines that call) of each case.
CASES = {
    "middle": ([("abcd", EAST(13.0, 13.02))], (13.01, 52.0005), "bc"),
    "anchor": ([("a", EAST(13.0, 13.02))], (13.0105, 52.0009), "a"),
    "gap": ([("abc", EAST(13.0, 13.02))], (13.01, 52.0), "ac"),
    "seam": ([("ax", EAST(13.0, 13.01)), ("a", EAST(13.01, 13.02))], (13.01, 52.0), "ax"),
    "mirrored": ([("ax", EAST(13.0, 13.01)), ("ax", EAST(13.01, 13.02)[::-1])], (13.01, 52.0), "ax"),
    "junction": ([("a", EAST(13.0, 13.02)), ("b", NORTH)], (13.01, 52.0), "ab"),
    "far": ([("a", EAST(13.0, 13.02))], (13.01, 52.01), "a"),
    "passing": ([("f", EAST(13.0, 13.02)), ("s", EAST(13.0, 13.02, 52.0005))], (13.01, 52.0005), "s"),
    "beside": ([("a", EAST(13.0, 13.02)), ("b", EAST(13.0, 13.02, 52.0005))], (13.01, 52.00025), "ab"),
    "none": ([("a", EAST(13.0, 13.02))], (13.01, 52.0), ""),
}


@pytest.fixture(scope="module")
def marks(spark):
    chains, slots, stations, served = [], [], [], []
    for n, (case, (corridors, (lon, lat), calls)) in enumerate(CASES.items()):
        for k, (lines, points) in enumerate(corridors):
            chains.append((n * 10 + k, 0, [{"lon": x + n, "lat": y} for x, y in points]))
            slots += [(n * 10 + k, f"{case} {line}", i - (len(lines) - 1) / 2, i) for i, line in enumerate(lines)]
        stations.append((case, lon + n, lat))
        served += [(case, f"{case} {line}") for line in calls]
    tables = [spark.createDataFrame(rows, kind) for rows, kind in ((chains, "seg_id int, chain int, coords array<struct<lon:double,lat:double>>"), (slots, "seg_id int, line_id string, slot double, ordinal int"), (stations, "station_id string, lon double, lat double"), (served, "station_id string, line_id string"))]
    out = {}
    for r in network.station_marks(*tables).orderBy("station_id", "mid", "bearing").collect():
        out.setdefault(r["station_id"], []).append(r.asDict() | {"lines": "".join(x[-1] for x in r["lines"]), "lon": r["lon"] - list(CASES).index(r["station_id"])})
    return out


def told(marks, case, *columns):
    return [tuple(round(m[c], 6) if isinstance(m[c], float) else m[c] for c in columns) for m in marks[case]]


def test_bars(marks):
    assert told(marks, "middle", "span", "lines", "mid", "bearing", "primary") == [(2, "bc", 0, 90, 1)]
    assert told(marks, "anchor", "lon", "lat") == [(13.0105, 52.0)]
    assert told(marks, "gap", "span", "lines", "mid") == [(1, "a", -1), (1, "c", 1)] and sum(m["primary"] for m in marks["gap"]) == 1
    assert told(marks, "seam", "lines", "span") == [("ax", 2)] and told(marks, "mirrored", "span", "mid") == [(2, 0)]
    assert sorted(told(marks, "junction", "bearing")) == [(0,), (90,)]
    assert told(marks, "far", "span", "bearing", "lon", "lat", "lines", "primary") == [(1, 0, 13.01, 52.01, "a", 1)]
    assert told(marks, "passing", "lines", "lat") == [("s", 52.0005)] and told(marks, "beside", "lines") == [("a",), ("b",)]
    assert "none" not in marks
