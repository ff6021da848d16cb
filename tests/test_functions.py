"""Names, references, colours, delays and histograms on stated cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackweave.functions import geo, style, text
from trackweave.operators import closures, coach, journeys, punctuality, stations


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def named(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(text.name_forms(F.col("a")).alias("a"), text.name_forms(F.col("b")).alias("b"))
    return df.select(text.names_equal(F.col("a"), F.col("b")), text.names_match(F.col("a"), F.col("b"))).first()


@pytest.mark.parametrize("raw,out", [("Hannover Hbf", "hannover"), ("Köln Hauptbahnhof", "koeln"), ("Haste (b Wunstorf)", "haste"), ("Saint-Étienne", "saint etienne"), ("Bf.", ""), ("Weißenfels Bf", "weissenfels")])
def test_normalise_name(spark, raw, out):
    assert one(spark, text.normalise_name(F.lit(raw))) == (out,)


@pytest.mark.parametrize(
    "a,b,equal,match",
    [
        ("Hannover Hbf", "Hannover Hauptbahnhof", True, True),
        ("Hannover Hbf", "Hannover Messe", False, True),
        ("Bad Nenndorf", "Nenndorf", False, True),
        ("Stadthagen Nord", "Stadthagen N", False, True),
        ("Aegidientorplatz", "Aegidien torplatz", False, True),
        ("Linden", "Hainholz", False, False),
        ("Hauptbahnhof", "Hbf", True, True),
    ],
)
def test_names(spark, a, b, equal, match):
    assert tuple(named(spark, a, b)) == (equal, match)


@pytest.mark.parametrize("line,kind,out", [("S 5", "S", "s5"), ("2", "RE", "re2"), ("2", "Bus", ""), (None, "RE", ""), ("RB38 (12345)", "RB", "rb38"), ("62a", "S", "s62a")])
def test_row_ref(spark, line, kind, out):
    assert one(spark, text.row_ref(F.lit(line).cast("string"), F.lit(kind))) == (out,)


@pytest.mark.parametrize("raw,out", [("#ABC", "#aabbcc"), (" Red ", "#e30513"), ("#12345g", None), ("#0069B4", "#0069b4"), (None, None)])
def test_colours(spark, raw, out):
    assert one(spark, style.normalise_colour(F.lit(raw).cast("string"))) == (out,)


def test_hash_is_fnv1a_signed(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    for key in ("", "a", "gvh|s5", "DB Regio|RE 10"):
        assert one(spark, style.fnv1a(F.lit(key))) == (fnv(key),)
    assert one(spark, style.text_on(F.lit("#ffffff")), style.text_on(F.lit("#000000"))) == ("#1a1a1a", "#ffffff")


@pytest.mark.parametrize("changed,out", [(None, 0.0), (5, 5.0), (-4, 0.0), (1440, 1440.0), (1441, None)])
def test_delay(spark, changed, out):
    planned = dt.datetime(2024, 5, 1, 12)
    rows = spark.createDataFrame([(planned, None if changed is None else planned + dt.timedelta(minutes=changed))], "p timestamp, c timestamp")
    assert rows.select(punctuality.delay_minutes(F.col("p"), F.col("c"))).first()[0] == out
    assert one(spark, punctuality.delay_minutes(F.lit(None).cast("timestamp"), F.lit(planned))) == (None,)


def test_buckets(spark):
    places = {0: 0, 0.9: 0, 20: 20, 20.5: 20, 21: 21, 30: 21, 31: 22, 45.9: 22, 46: 23, 60: 23, 61: 24, 90.5: 24, 91: 25, 700: 25}
    for minutes, at in places.items():
        assert one(spark, punctuality.bucket(F.lit(float(minutes)))) == (at,)


def test_quantile(spark):
    def of(p, **counts):
        h = [counts.get(f"b{i}", 0) for i in range(26)]
        return one(spark, punctuality.hist_quantile(F.array(*[F.lit(x).cast("long") for x in h]), p))[0]

    assert of(0.5) == 0 and of(0.5, b0=10) == 0 and of(0.9, b0=5, b3=5) == 3
    assert of(0.5, b21=10) == 26 and of(0.9, b25=3) == 91 and of(1.0, b24=4) == 90


def test_stop_rank(spark):
    rank = lambda modes, n, major: one(spark, style.stop_rank(F.array(*map(F.lit, modes)) if modes else F.array().cast("array<string>"), F.lit(n), F.lit(major)))[0]
    assert rank(["tram"], 9, True) == 3 and rank(["coach"], 1, False) == 1 and rank(["longdistance"], 1, False) == 0
    assert rank(["regional"], 3, True) == 0 and rank(["regional"], 3, False) == 1 and rank([], 0, False) == 2 and rank(["regional", "tram"], 2, False) == 1


def test_windows_and_moves(spark):
    d = lambda day: F.lit(f"2026-08-{day:02d}").cast("date")
    w = lambda a, b, days, x="03:00:00", y="04:00:00": F.struct(d(a).alias("from"), d(b).alias("to"), F.lit(days).alias("days"), F.lit(x).alias("from_time"), F.lit(y).alias("to_time"))
    fold = lambda *ws: [(r["from"].day, r["to"].day, r["days"]) for r in one(spark, closures.compact_windows(F.array(*ws)))[0]]
    assert fold(w(3, 3, 127), w(4, 4, 127), w(5, 5, 127)) == [(3, 5, 7)]
    assert fold(w(3, 3, 127), w(5, 5, 127)) == [(3, 3, 1), (5, 5, 4)]
    assert fold(w(3, 3, 127), w(4, 4, 127, "05:00:00")) == [(3, 3, 1), (4, 4, 2)]
    assert fold(w(1, 2, 96), w(3, 9, 96)) == [(1, 9, 96)] and fold(w(1, 2, 96), w(3, 9, 3)) == [(1, 2, 96), (3, 9, 3)]
    packed = "2026-09-02:2026-10-02>2026-11-15;broken;2026-09-03:2026-11-15>2026-11-16"
    assert len(one(spark, closures.unpack_moves(F.lit(packed)))[0]) == 2
    assert one(spark, closures.pack_moves(closures.unpack_moves(F.lit(packed)))) == (packed.replace("broken;", ""),)


def test_mercator(spark):
    lon, lat = one(spark, *geo.mercator_to_degrees(F.lit(1095159.0), F.lit(6625535.0)))
    assert abs(lon - 9.838) < 1e-3 and abs(lat - 51.064) < 0.05


@pytest.mark.parametrize(
    "points,runs",
    [
        ([(1, 1), (2, 2)], [2]),
        ([(1, 1), (20, 1)], [2]),
        ([(-5, 5), (15, 5)], [2]),
        ([(1, 1), (15, 1), (15, 5), (1, 5)], [2, 2]),
        ([(-5, 20), (5, 30)], []),
        ([(-1, 1), (1, -1)], []),
        ([(0, 2), (0, 8)], [2]),
    ],
)
def test_clip(spark, points, runs):
    rows = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "shape_id int, part int, seq int, lon double, lat double")
    got = coach.clip(rows, (0.0, 0.0, 10.0, 10.0)).groupBy("run").count().orderBy("run").collect()
    assert [r["count"] for r in got] == runs


def test_fares_and_places(spark):
    legs = spark.createDataFrame([("a", 1, "WALK"), ("a", 2, "REGIONAL_RAIL"), ("b", 1, "BUS"), ("c", 1, "WALK")], "journey_id string, idx int, mode string")
    ids = lambda fare: sorted(r[0] for r in journeys.fare_filter(legs, fare).collect())
    assert ids("any") == ["a", "b", "c"] and ids("regional") == ["a", "c"] and ids("ticket") == ["a", "b", "c"]
    places = spark.createDataFrame([("A", "city", 9.0, 52.0, "12"), ("B", "town", 9.0, 95.0, "1"), (None, "city", 1.0, 1.0, "1"), ("C", "village", 1.0, 1.0, "1"), ("D", "town", 1.0, 1.0, "1e3")], "name string, kind string, lon double, lat double, population string")
    assert {(r["name"], r["population"]) for r in stations.places(places).collect()} == {("A", 12), ("D", 0)}


def test_variants_and_slugs(spark):
    forms = lambda raw: list(one(spark, text.search_variants(F.lit(raw)))[0])
    assert forms("S-Bahn Berlin GmbH") == ["S-Bahn Berlin GmbH", "S-Bahn Berlin"]
    assert forms("Bahn (BB) AG, Weg 1;Other") == ["Bahn (BB) AG, Weg 1", "Bahn (BB) AG", "Bahn AG", "Bahn"]
    assert forms("DB") == []
    name = "Ørsted Straße.logo.svg"
    code = 0
    for c in name:
        code = (code * 31 + ord(c)) % 0xFFFFFF
    digits = ""
    while code:
        digits, code = "0123456789abcdefghijklmnopqrstuvwxyz"[code % 36] + digits, code // 36
    assert one(spark, text.slug(F.lit(name), F.lit("image/png"))) == (f"orsted-strasse-logo-{digits}.png",)


def test_stored_records(spark):
    rows = spark.createDataFrame([("1", "closed", "sideways", "2026-08-01", "2026-08-03", None, None, None), ("2", "odd", "both", "x", "y", 9, "weeks", 1)], "id string, effect string, direction string, begin string, end string, days int, band string, extended int")
    got = {r["id"]: (r["effect"], r["direction"], r["days"], r["band"], r["extended"]) for r in closures.validated(rows).collect()}
    assert got == {"1": ("closed", "both", 3, "days", 0), "2": ("other", "both", 9, "weeks", 1)}
    assert one(spark, closures.local_day(F.lit("2026-08-01 22:30:00").cast("timestamp"))) == (dt.date(2026, 8, 2),)


@pytest.mark.parametrize("raw,out", [("RE8 (14045)", "RE8"), ("S 1 (Nord)", "S 1 (Nord)"), (" ICE 5 ", "ICE 5"), (None, "")])
def test_badge(spark, raw, out):
    assert one(spark, text.badge(F.lit(raw).cast("string"))) == (out,)


def test_minutes_text(spark):
    assert one(spark, text.minutes_text(F.lit(90), 91), text.minutes_text(F.lit(91), 91)) == ("90", "91+")


def test_end_direction(spark):
    k = 111_320.0
    line = F.array(*(F.struct(F.lit(x / k).alias("lon"), F.lit(y / k).alias("lat")) for x, y in ((0, 0), (10, 0), (20, 0), (20, 40), (20, 400))))
    start, end = one(spark, geo.end_direction(line, True), geo.end_direction(line, False))
    assert (round(end["x"], 6), round(end["y"], 6)) == (0, 1) and abs(start["y"] / start["x"] - 2) < 1e-6  # the first 25 m end at the third segment's end
    still = F.array(*(F.struct(F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat")) for _ in range(2)))
    assert tuple(one(spark, geo.end_direction(still, True))[0]) == (0, 0)


def test_across(spark):
    a = [F.lit(v) for v in (13.0, 52.0, 13.001, 52.0005)]
    east, north = one(spark, geo.across(*a, F.lit(90.0)), geo.across(*a, F.lit(0.0)))
    assert abs(east - 0.0005 * 111_320) < 1e-6 and abs(north - 0.001 * 111_320 * 0.6156614753) < 1e-3


def test_coach_colours_overrides_and_ways(spark):
    from trackweave.operators import lines

    coach = spark.createDataFrame([("c1", "1", "n", "coach", "#AbC"), ("c2", "2", "n", "coach", None)], "line_id string, ref string, network string, mode string, colour string")
    assert {r["line_id"]: (r["colour"], r["colour_source"]) for r in lines.coach_colours(coach).collect()}["c1"] == ("#aabbcc", "feed")
    kind = "ord int, id string, route string, service string, ref string, network string, network_short string, name string, colour string, operator string, way_ids array<string>"
    rows = [(1, "1", "train", None, "RE 1", "n", None, "first", "#000000", "o", []), (2, "2", "train", None, "RE 1", "n", None, "second", "#ff0000", "o", ["w"]), (3, "3", "train", None, "RE 2", "n", None, "other", None, "o", ["w"])]
    table = spark.createDataFrame(rows, kind)
    plain = {r["ref"]: r for r in lines.collapse_lines(table).collect()}
    assert plain["RE 1"]["name"] == "second" and plain["RE 1"]["colour"] == "#ff0000" and plain["RE 1"]["relations"] == 1 and plain["RE 2"]["colour_source"] == "fallback"
    key = plain["RE 1"]["line_id"]
    over = spark.createDataFrame([(key, "#123456", "named")], "line_id string, override string, name string")
    row = lines.collapse_lines(table, over).where(F.col("line_id") == key).first()
    assert (row["colour"], row["colour_source"], row["name"]) == ("#123456", "override", "named")


def test_reservations_and_pills(spark):
    legs = spark.createDataFrame([("COMPULSORY",), ("OPTIONAL",), (None,)], "reservation string").withColumns({"mode": F.lit("BUS"), "line": F.lit("x"), "actual": F.lit(None).cast("string"), "scheduled": F.lit("t"), "bikes": F.lit(True)})
    assert [r["reservation_required"] for r in journeys.normalised_legs(legs).collect()] == [True, False, False]
    table = spark.createDataFrame([(1, "A Hbf"), (2, "B")], "station_id int, name string")
    lines = spark.createDataFrame([("l", "tram")], "line_id string, mode string")
    served = spark.createDataFrame([(1, "l")], "station_id int, line_id string")
    marks = spark.createDataFrame([(1, 0), (1, 1)], "station_id int, mark int")
    assert {r["station_id"]: r["pill"] for r in stations.rollup(table, served, lines, marks).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("tag,out", [("de:04011:13925", ["de-DELFI_de:04011:13925"]), ("de:04011:13925:1:2", ["de-DELFI_de:04011:13925:1:2", "de-DELFI_de:04011:13925"]), ("de:04011", []), ("DE:1:2", []), ("de:1:2;de:3:4", []), (None, [])])
def test_tag_ids(spark, tag, out):
    from trackweave.operators import resolve

    assert one(spark, resolve.tag_ids(F.lit(tag).cast("string"))) == (out,)


def test_tagged_stops(spark):
    from trackweave.operators import resolve

    table = spark.createDataFrame([(1, 9.7, 52.3, "Linden", "rail", "de:1:2:3"), (2, 9.8, 52.3, "Mitte", "rail", "de:1:9"), (3, 9.9, 52.3, "Nord", "tram", "bad")], "station_id int, lon double, lat double, name string, mode string, ifopt string")
    stops = spark.createDataFrame([("de-DELFI_de:1:2:3", "STOP", 9.7, 52.3, "Linden", ["BUS"]), ("de-DELFI_de:1:2", "STOP", 9.7, 52.3, "Linden", ["REGIONAL_RAIL"]), ("de-DELFI_de:1:9", "STOP", 12.0, 52.3, "Mitte", ["REGIONAL_RAIL"])], "id string, type string, lon double, lat double, name string, modes array<string>")
    assert [(r["station_id"], r["id"]) for r in resolve.tagged_stops(table, stops).collect()] == [(1, "de-DELFI_de:1:2")]
