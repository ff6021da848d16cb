"""What must hold so that queries work on larger tables."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from trackweave.operators import closures, graph, network, spatial, tracks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_broadcast_by_guess(spark):
    found, own = entry.queries(), spark.conf.get(entry.BROADCAST)
    rows = found["nearest_station"](spark, SF)
    assert spark.conf.get(entry.BROADCAST) == "-1" and "Broadcast" not in rows._jdf.queryExecution().sparkPlan().toString()
    found["op2_merkle_fixity"](spark, SF)
    assert spark.conf.get(entry.BROADCAST) != "-1" and own in ("-1", spark.conf.get(entry.BROADCAST))


def test_bars_of_a_station_are_one_row(spark):
    drafts = spark.createDataFrame([(1, 7, 9.5, 52.1, 10.0, 0.0, 1.0, [1, 2]), (1, 8, 9.5, 52.1, 190.0, -1.0, 1.0, [2, 3]), (2, 9, 9.5, 52.1, 0.0, 0.0, 0.0, [4])], "station_id long, seg_id long, lon double, lat double, bearing double, lo double, hi double, lines array<long>")
    marks = network.merge_marks(drafts)
    assert "FlatMapGroupsInPandas" not in plan(marks)
    assert sorted((r["station_id"], r["mark"], r["mid"], r["span"], r["lines"]) for r in marks.collect()) == [(1, 0, 0.0, 3, [1, 2, 3]), (2, 0, 0.0, 1, [4])]


def test_the_side_with_few_rows_is_spread(spark):
    few, many = (spark.range(n).select(F.col("id").alias(name), (9 + F.col("id") / 1000).alias("lon"), F.lit(52.0).alias("lat")) for n, name in ((3, "a"), (2000, "b")))
    pairs = spatial.near_pairs(few, many, 300.0)
    told = plan(pairs)
    assert told.count("Generate explode") == 2 and told.index("Generate explode") < told.index("Range (0, 2000") and "Generate explode" not in told[told.index("Range (0, 3") :]
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a in range(3) for b in range(7) if abs(a - b) <= 4}


def test_intervals_of_the_larger_table_stand_once(spark):
    import datetime
    import random

    r = random.Random(5)
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    span = lambda most: (a := r.randrange(3000), a + r.choice([0, 1, 7, 60, r.randrange(most), -2]))
    many = [(i, *map(day, span(90))) for i in range(1200)] + [(9001, None, day(5)), (9002, day(5), None), (9003, datetime.date(1, 1, 1), datetime.date(9999, 12, 31)), (9004, day(512), day(1023))]
    few = [(i, *map(day, span(2500))) for i in range(40)] + [(901, None, None), (902, day(-700000), day(2900)), (903, day(1023), day(1023))]
    a, b = spark.createDataFrame(many, "a int, f date, l date"), spark.createDataFrame(few, "b int, g date, m date")
    expected = sorted((i, j) for i, f, l in many for j, g, m in few if None not in (f, l, g, m) and f <= l and g <= m and f <= m and g <= l)  # noqa: E741
    for rows, columns in ((closures.interval_pairs(a, b, ("f", "l"), ("g", "m")), ["a", "f", "l", "b", "g", "m"]), (closures.interval_pairs(b, a, ("g", "m"), ("f", "l")), ["b", "g", "m", "a", "f", "l"])):
        assert rows.columns == columns and sorted((x["a"], x["b"]) for x in rows.collect()) == expected
        assert plan(rows).count("Generate explode") == 2  # sizes and bins of the smaller table


def test_equal_intervals_meet_as_one(spark, tmp_path):
    day = "date_add(date '2000-01-01', cast({0} as int))"
    many = spark.range(6000).selectExpr("id as a", "id % 2 as line", f"{day.format('id * 7919 % 20 * 3')} as f", f"{day.format('id * 7919 % 20 * 3 + 20')} as l")
    few = spark.range(2000).selectExpr("id as b", "id % 2 as line", f"{day.format('id * 31 % 100')} as f", f"{day.format('id * 31 % 100 + id % 40 * (id % 40) / 9')} as l")
    pairs = closures.interval_pairs(many, few, ("f", "l"), ("f", "l"), ("line",))
    assert pairs.columns == ["line", "a", "f", "l", "b", "f", "l"]
    out = f"{tmp_path}/pairs"
    pairs.select("a", "b").coalesce(1).write.parquet(out)
    x, y = many.alias("x"), few.alias("y")
    right = x.join(y, F.expr("x.line = y.line and x.f <= y.l and x.l >= y.f")).select("a", "b")
    seen = spark.read.parquet(out)
    assert seen.exceptAll(right).count() == right.exceptAll(seen).count() == 0
    # Rows that repeat stand where a file's encodings find them.
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * seen.count()


def test_a_larger_stream_has_more_files_in_as_many_batches(spark):
    from trackweave.plans import streams

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        rows, seen = spark.range(200_000), []
        stream = streams._stream(rows, 4)
        streams.jobs.run_once(stream, lambda part, n: seen.append((part.count(), part.select(F.input_file_name()).distinct().count())), "append")
        assert sum(n for n, _ in seen) == 200_000 and 2 <= len(seen) <= 4 and sum(f for _, f in seen) > 4
        seen.clear()
        streams.jobs.run_once(streams._stream(rows, 1), lambda part, n: seen.append(part.count()), "append")
        assert seen == [200_000]
        seen.clear()
        streams.jobs.run_once(streams._stream(spark.range(8).repartition(1), 4), lambda part, n: seen.append(part.count()), "append")
        assert sum(seen) == 8 and len(seen) == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_ways_that_may_go_send_their_neighbours_on(spark):
    metre = 1 / 111_320
    straight = lambda y, far=900: [{"lon": 10.0, "lat": 52.0 + y * metre}, {"lon": 10.0 + far / 68_500, "lat": 52.0 + y * metre}]
    rows = [("up", [1], straight(0), 0, False), ("down", [1, 2], straight(5), 1, False), ("longer", [1], straight(-5, 1200), 2, False), ("other line", [3], straight(2), 3, False), ("outright", [2], straight(9), 9, True), ("late", [1], straight(4, 400), 8, False)]
    shapes = spark.createDataFrame([(w, c, 20.0, "20.0", lines, place, before) for w, lines, c, place, before in rows], "way_id string, coords array<struct<lon:double,lat:double>>, tolerance double, band string, lines array<int>, place int, before boolean")
    found = tracks.contested(shapes)
    got = {(r["line_id"], r["way_id"]): (r["points"], {h["other"] for h in r["near"]}, len(r["near"])) for r in found.collect()}
    assert {k: v[1] for k, v in got.items()} == {(1, "down"): {"up"}, (2, "down"): {"outright"}, (1, "late"): {"up", "down", "longer"}}
    assert got[1, "down"][0] == got[1, "down"][2] and got[1, "late"][0] < got[1, "late"][2]


def test_a_long_way_is_few_rows(spark):
    coords = [{"lon": 10.0, "lat": 52.0}, {"lon": 10.012, "lat": 52.02}, {"lon": 10.012, "lat": 52.02}, {"lon": 10.03, "lat": 52.021}]
    shapes = spark.createDataFrame([("a", "20.0", [1], 1, False, 20.0, coords)], "way_id string, band string, lines array<int>, place int, before boolean, tolerance double, coords array<struct<lon:double,lat:double>>")
    segments = tracks._segments(shapes).cache()
    met = tracks._segment_cells(segments)
    assert met.count() == met.distinct().count() <= 20
    pieces = tracks._point_cells(segments, 1).select("x", "y", "here", F.explode("pieces").alias("c"))
    rows = pieces.collect()
    assert len(rows) <= 15
    inner = [k for r in rows if r["c"]["lo"] is not None for k in range(r["c"]["lo"], r["c"]["hi"] + 1)]
    long = segments.agg(F.max("at")).first()[0]
    assert sorted(inner) == list(range(1, int(long / 20) + 1)) and sorted(r["c"]["i"] for r in rows if r["c"]["end"]) == [0, 1, 2, 3]
    assert sum({(r["x"], r["y"]): r["here"] for r in rows}.values()) == len(inner) + 4
    for r in rows:
        c = r["c"]
        for k in (c["lo"], c["hi"]) if c["lo"] is not None else ():
            t = (k * 20.0 - (c["at"] - c["step"])) / c["step"]
            assert (c["p_lon"] + (c["q_lon"] - c["p_lon"]) * t) // tracks.TRACK_CELL == r["x"] and (c["p_lat"] + (c["q_lat"] - c["p_lat"]) * t) // tracks.TRACK_CELL == r["y"]
    segments.unpersist()


def test_what_a_table_was_shuffled_for_goes_with_it(spark):
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, own = files(), spark.conf.get(graph.FREED, None)
    counts = lambda: spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()
    counts().collect()
    assert files() - before
    before = files()
    told = graph.settled(counts())
    assert not files() - before and spark.conf.get(graph.FREED, None) == own
    rows = graph.Rounds(spark).settled(told.join(counts().withColumnRenamed("count", "n"), "k"))
    assert not files() - before and rows.where("count = n").count() == 7
