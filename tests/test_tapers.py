"""Tapers at junctions, in metres about latitude 52.26; each junction some kilometres from the next."""

import math

import pytest
from pyspark.sql import functions as F

from trackweave.operators import tapers

K = 111_320.0
CHAINS, SLOTS = "seg_id int, chain int, coords array<struct<lon:double,lat:double>>", "seg_id int, line_id string, slot double"


def at(x, y=0.0):
    return {"lon": 10.52 + x / (K * math.cos(math.radians(52.26))), "lat": 52.26 + y / K}


def metres(coords):
    return sum(math.hypot((q["lon"] - p["lon"]) * K * math.cos(math.radians(p["lat"])), (q["lat"] - p["lat"]) * K) for p, q in zip(coords, coords[1:]))


#: Segments of each case: points in metres and the places of lines.
CASES = {
    "branch": [(((0, 0), (200, 0)), {"main": 0}), (((200, 0), (400, 0)), {"main": 0.5, "other": -0.5}), (((200, 0), (200, 200)), {"branch": 0})],
    "three": [(((0, 0), (200, 0)), {"main": 0}), (((200, 0), (400, 0)), {"main": 1}), (((200, 0), (200, 200)), {"main": -1})],
    "ends": [(((0, 0), (200, 0)), {"ending": 0}), (((200, 0), (400, 0)), {"starting": 0})],
    "reversed": [(((0, 0), (200, 0)), {"main": 1}), (((0, 0), (-200, 0)), {"main": 0})],
    "level": [(((0, 0), (200, 0)), {"main": 1}), (((0, 0), (-200, 0)), {"main": -1})],
    "fitted": [(((0, 0), (30, 0)), {"main": 0}), (((30, 0), (60, 0)), {"main": 1})],
    "two ends": [(((0, 0), (200, 0)), {"main": 0}), (((200, 0), (320, 0)), {"main": 1}), (((320, 0), (520, 0)), {"main": 0})],
    "tiny": [(((0, 0), (10, 0)), {"main": 0}), (((10, 0), (200, 0)), {"main": 1})],
    "wide": [(((0, 0), (150, 0), (400, 0)), {"main": -4}), (((400, 0), (400, 300), (400, 700)), {"main": 6})],
    "even": [(((0, 0), (400, 0)), {"main": 0}), (((400, 0), (800, 0)), {"main": 2})],
    "tram": [(((0, 0), (200, 0)), {"tram": 0}), (((200, 0), (400, 0)), {"tram": 1})],
}


@pytest.fixture(scope="module")
def made(spark):
    chains, slots, lines = [], [], {}
    for n, (case, segments) in enumerate(CASES.items()):
        for k, (points, places) in enumerate(segments):
            chains.append((n * 10 + k, 0, [at(x + n * 20_000, y) for x, y in points]))
            for line, slot in places.items():
                slots.append((n * 10 + k, f"{case} {line}", float(slot)))
                lines[f"{case} {line}"] = "tram" if line == "tram" else "regional"
    tables = spark.createDataFrame(chains, CHAINS), spark.createDataFrame(slots, SLOTS), spark.createDataFrame(list(lines.items()), "line_id string, mode string")
    return (*tables, tapers.resolve_tapers(*tables))


@pytest.fixture(scope="module")
def steps(made):
    out = {}
    for r in made[3].steps.orderBy("line_id", "seg_a", "seg_b", "step").collect():
        out.setdefault((r["line_id"], r["seg_a"] % 10), []).append(r)
    return out


def test_which_lines_taper(made, steps):
    assert {k: len(v) for k, v in steps.items()} == {("branch main", 0): 3, ("reversed main", 0): 3, ("fitted main", 0): 3, ("two ends main", 0): 3, ("two ends main", 1): 3, ("wide main", 0): 8, ("even main", 0): 3, ("tram tram", 0): 3}
    assert made[3].diagnostics.first().asDict() == {"tapered": 8, "ambiguous": 1, "short": 1, "collided": 0, "shortened": 1, "occupied": 0}


def test_places_of_steps(steps):
    slots = {k: [round(r["slot"], 9) for r in v] for k, v in steps.items()}
    assert slots["reversed main", 0] == [-1 + 1 / 6, -0.5, -1 / 6] or [round(x, 6) for x in slots["reversed main", 0]] == [-0.833333, -0.5, -0.166667]
    assert [round(x, 6) for x in slots["even main", 0]] == [0.333333, 1.2, 1.666667]  # the middle one is moved off an occupied place
    for v in slots.values():
        assert v == sorted(v) or v == sorted(v, reverse=True)
    assert not any(float(x).is_integer() for x in slots["wide main", 0])


def test_geometry_of_steps(steps):
    for (line, _), rows in steps.items():
        for a, b in zip(rows, rows[1:]):
            assert a["coords"][-1] == pytest.approx(b["coords"][0])
        whole = sum(metres(r["coords"]) for r in rows)
        expected = {"fitted main": 24, "wide main": 240, "even main": 160, "tram tram": 40}.get(line, 80)
        assert abs(whole - expected) < 0.1 and max(metres(r["coords"]) for r in rows) - min(metres(r["coords"]) for r in rows) < 0.1
    corner = {(round(p["lon"], 7), round(p["lat"], 7)) for r in steps["wide main", 0] for p in r["coords"]}
    n = list(CASES).index("wide")
    assert (round(at(400 + n * 20_000)["lon"], 7), round(at(0)["lat"], 7)) in corner  # the path goes through the junction


def test_trims(made):
    got = {(r["line_id"], r["seg_id"] % 10): (round(r["start_m"], 2), round(r["end_m"], 2)) for r in made[3].trims.collect()}
    assert got["branch main", 0] == (0, 40) and got["branch main", 1] == (40, 0) and got["reversed main", 0] == (40, 0) == got["reversed main", 1]
    assert got["fitted main", 0] == (0, 12) and got["two ends main", 1] == (40, 40) and not any(x.startswith(("three", "ends", "level", "tiny")) for x, _ in got)


def test_tapers_that_take_a_whole_chain_are_left_out(spark):
    """Two chains of one corridor end where two others begin: what both tapers cut adds up past the chain."""
    chains = spark.createDataFrame([(1, 0, [at(0), at(200)]), (2, 0, [at(200), at(300)]), (3, 0, [at(300), at(500)])], CHAINS)
    slots = spark.createDataFrame([(1, "m", 0.0), (2, "m", 3.0), (3, "m", 0.0)], SLOTS)
    lines = spark.createDataFrame([("m", "regional")], "line_id string, mode string")
    share, tapers.taper_length = tapers.taper_length, lambda mode, delta, up, down: F.least(F.lit(240.0), 1.2 * F.least(up, down))
    try:
        found = tapers.resolve_tapers(chains, slots, lines)
        assert found.steps.count() == found.trims.count() == 0 and found.diagnostics.first()["collided"] == 2
    finally:
        tapers.taper_length = share


def test_layer_of_routes_and_steps(made, spark):
    chains, slots, lines, found = made
    coach = spark.createDataFrame([("coach", [at(0), at(10)])], "line_id string, coords array<struct<lon:double,lat:double>>")
    rows = tapers.route_layer(chains, slots, lines, found, coach).collect()
    assert {r["part"] for r in rows} == {"route", "taper", "coach"} and sum(r["part"] == "taper" for r in rows) == found.steps.count()
    branch = [r for r in rows if r["line_id"] == "branch main"]
    assert sorted(round(metres(r["coords"])) for r in branch if r["part"] == "route") == [160, 160] and {r["bundle"] for r in branch} == {1, 2}
    joined = sorted(round(p["lon"], 7) for r in branch for p in (r["coords"][0], r["coords"][-1]))
    assert joined[1::2][:-1] == joined[2::2]  # routes and steps meet end to end


@pytest.mark.parametrize("v,up,down,hit", [(1.0, 0.0, 2.0, True), (0.5, 0.0, 1.5, True), (0.0, 0.0, 2.0, False), (0.4, 0.0, 2.0, False), (-1.0, 2.0, -4.0, True), (3.0, 0.0, 2.0, False)])
def test_occupied(spark, v, up, down, hit):
    assert spark.range(1).select(tapers.on_occupied_slot(F.lit(v), F.lit(up), F.lit(down))).first()[0] is hit
