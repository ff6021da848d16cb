"""Scans and outputs on small files."""

import pytest
from pyspark.sql import functions as F

from trackweave.sources import readers, sinks


def test_relations(spark, tmp_path):
    (tmp_path / "r.opl").write_text("n1 v1\nr7 v1 Ttype=route,route=train,name=S5%3a%%20%A%2c%B Mw1@,w2@forward,w3@platform,n4@stop,n5@stop_entry_only,n6@\nr8 v1 Troute=train Mw1@\n")
    r = readers.read_relations(spark, str(tmp_path / "r.opl")).collect()
    assert [(x["id"], x["way_ids"], x["stop_ids"], x["tags"]["name"]) for x in r] == [("7", ["1", "2"], ["4", "5"], "S5: A,B")]


def test_features_and_selection(spark, tmp_path):
    (tmp_path / "f.geojsonseq").write_text('\x1e{"type":"Feature","id":"w12","properties":{"railway":"rail"},"geometry":{"type":"LineString","coordinates":[[9.1,52.2],[9.2,52.3]]}}\n\n\x1e{"type":"Feature","id":"n3","properties":{"name":"A","place":"city"},"geometry":{"type":"Point","coordinates":[9.5,52.5]}}\nnot json\n')
    f = readers.read_features(spark, str(tmp_path / "f.geojsonseq"))
    line = readers.line_features(f).first()
    assert line["way_id"] == "12" and line["coords"][1]["lat"] == 52.3
    points = readers.point_features(f)
    assert [(p["name"], p["lon"]) for p in points.collect()] == [("A", 9.5)]
    assert readers.select_elements(points, "place").count() == 1 and readers.select_elements(points, "way").count() == 0


def test_way_geometry(spark):
    ways = spark.createDataFrame([("w", [3, 1, 9, 2])], "way_id string, node_refs array<long>")
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0)], "node_id long, lon double, lat double")
    assert [c["lon"] for c in readers.way_geometry(ways, nodes).first()["coords"]] == [3.0, 1.0, 2.0]


def test_feed(spark, tmp_path):
    (tmp_path / "routes.txt").write_text('route_id,agency_id,route_short_name,route_long_name\n1,x,"N ""5""","A, B"\n2,y,,\n')
    rows = [tuple(r) for r in readers.read_feed(spark, str(tmp_path), "routes").orderBy("route_id").collect()]
    assert rows == [("x", "1", 'N "5"', "A, B", None, None), ("y", "2", None, None, None, None)]


def test_delays_prune_months(spark, tmp_path):
    rows = spark.createDataFrame([(m, "s", "1", "RE", False, None, None, "r", "unused") for m in ("2025-01", "2025-02", "2025-03")], "month string, station_name string, line_number string, train_type string, departure_is_canceled boolean, departure_planned_time timestamp, departure_change_time timestamp, train_line_ride_id string, other string")
    rows.write.partitionBy("month").parquet(str(tmp_path / "d"))
    got = readers.read_delays(spark, str(tmp_path / "d"), 2)
    assert "other" not in got.columns and sorted(r["month"] for r in got.collect()) == ["2025-02", "2025-03"]


def test_optional_and_region(spark):
    assert readers.optional(spark, lambda: spark.read.parquet("/nowhere/at/all"), "a int").count() == 0
    assert readers.region({"x": {"bbox": [1, 2, 3, 4]}}, "x") == (1, 2, 3, 4)
    with pytest.raises(KeyError):
        readers.region({}, "y")


def test_publish_replaces_whole(spark, tmp_path):
    folder = str(tmp_path / "scores")
    sinks.publish(spark.range(3), folder)
    assert sinks.published(spark, folder).count() == 3
    sinks.publish(spark.range(5), folder)
    assert sinks.published(spark, folder).count() == 5


def test_state_is_carried(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "station_id int, stop_id string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "station_id int, stop_id string")
    got = sinks.carry_state(old, new, str(tmp_path / "state")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a"), (2, "c"), (3, "d")]


def test_log_and_features(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("2026-01-02", "planned", "1", 1)], "t string, e string, id string, seq long").withColumn("t", F.to_date("t"))
    assert sinks.append_log(events.limit(0), path) == 0 and not sinks.exists(spark, path)
    assert sinks.append_log(events, path) == 1 and sinks.append_log(events, path) == 1
    assert readers.read_log(spark, path).count() == 2
    places = spark.createDataFrame([("A", "city", 9.0, 52.0, 5)], "name string, kind string, lon double, lat double, population int")
    sinks.write_places(places, str(tmp_path / "p"))
    assert readers.point_features(readers.read_features(spark, str(tmp_path / "p"))).first()["name"] == "A"
    sinks.write_tiers(spark.range(4).withColumn("min_zoom", F.col("id") % 2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("min_zoom = 1").count() == 2


def test_readings_prune_parts(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.date(2026, 3, n)
    schema = f"{readers.READING}, reading_day date"
    rows = [(f"{n}-{k}", "closed", day(1 + k), day(3 + k), [1], day(n)) for n in range(1, 6) for k in range(0, 20, 4)]
    path = str(tmp_path / "register")
    sinks.write_reading(spark.createDataFrame(rows, schema), path)
    sinks.write_reading(spark.createDataFrame([("5-new", "other", day(5), day(5), [2], day(5))], schema), path)  # replaces that day's part only
    whole = readers.read_readings(spark, path)
    assert {r["id"] for r in whole.collect()} == {r[0] for r in rows if r[5] != day(5)} | {"5-new"}
    one = whole.where(F.col("reading_day") == day(2))
    assert "PartitionFilters: [isnotnull(reading_day" in one._jdf.queryExecution().toString() and one.count() == 5
    days = spark.createDataFrame([(day(1),), (day(5),)], "reading_day date")
    asked = readers.read_readings(spark, path, days, horizon=2)
    assert {r["id"] for r in asked.collect()} == {f"1-{k}" for k in range(0, 3, 4)} | {"5-new"}
    plan = readers.read_readings(spark, path, days.where("reading_day > date '2026-03-02'"))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_sources_that_cannot_be_read_are_empty(spark, tmp_path):
    schema = "id string, n int"
    good = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    good.write.parquet(str(tmp_path / "p"))
    read = lambda path: lambda: spark.read.schema(schema).parquet(str(tmp_path / path))
    assert readers.optional(spark, read("p"), schema).count() == 2 and readers.optional(spark, read("nowhere"), schema).count() == 0
    for f in (tmp_path / "p").glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:20])
    for f in (tmp_path / "p").glob(".*.crc"):
        f.unlink()
    assert readers.optional(spark, read("p"), schema).dtypes == good.dtypes and readers.optional(spark, read("p"), schema).count() == 0
    (tmp_path / "r.json").write_text('[{"id": "x", "effect": "closed"}, {"id": "y", "eff')
    assert readers.optional(spark, lambda: readers.strict_register(spark, str(tmp_path / "r.json")), readers.READING).count() == 0
    with pytest.raises(ZeroDivisionError):
        readers.optional(spark, lambda: 1 / 0, schema)


def test_a_broken_run_goes_on_after_the_last_whole_chunk(spark, tmp_path):
    work = spark.createDataFrame([(k, f"s{k}") for k in range(23)], "station_id int, name string").repartition(3)
    calls, broken = [], [True]

    def resolve(rows):
        first = rows.agg(F.min("station_id")).first()[0]
        if first == 10 and broken[0]:
            raise ConnectionError("source is away")
        calls.append(first)
        return rows.select("station_id", F.concat("name", F.lit("!")).alias("stop_id"))

    with pytest.raises(ConnectionError):
        sinks.in_chunks(work, "station_id", resolve, str(tmp_path / "run"), rows=5)
    assert calls == [0, 5]
    broken[0] = False
    got = sinks.in_chunks(work.where("station_id < 3"), "station_id", resolve, str(tmp_path / "run"), rows=5)  # the list that was written holds
    assert calls == [0, 5, 10, 15, 20] and sorted((r["station_id"], r["stop_id"]) for r in got.collect()) == [(k, f"s{k}!") for k in range(23)]
    whole = sinks.in_chunks(work, "station_id", resolve, str(tmp_path / "other"), rows=100)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))
    assert sinks.in_chunks(work.limit(0), "station_id", resolve, str(tmp_path / "none")).count() == 0


def test_log_is_appended_in_order_and_summary_counts(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-02", "b", "planned"), ("2026-01-01", "c", "planned"), ("2026-01-01", "a", "planned")], "t string, id string, e string")
    assert sinks.append_log(events.limit(0), str(tmp_path / "log")) == 0 and not (tmp_path / "log").exists()
    assert sinks.append_log(events, str(tmp_path / "log")) == 3 and spark.read.json(str(tmp_path / "log")).count() == 3
    lines = spark.createDataFrame([("a", "tram", "osm"), ("b", "tram", "feed"), ("c", "coach", "osm")], "line_id string, mode string, colour_source string")
    sinks.write_summary(lines, events, str(tmp_path / "s"))
    row = spark.read.json(str(tmp_path / "s")).first()
    assert row["stations"] == 3 and row["colour_coverage"] == 0.5 and row["lines"]["tram"] == 2
