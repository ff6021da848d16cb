"""Parallel tracks over whole networks: which track of a corridor is the one to keep, and what links the kept ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import METRES_PER_DEGREE, metres
from trackweave.operators.graph import Rounds, components, settled, spanning_forest
from trackweave.operators.paths import length_of, node_key

TOLERANCE = {"tram": 15.0, "coach": 0.0}
OTHER_TOLERANCE = 20.0
#: Edge of a grid cell in degrees, far wider than any tolerance, as a way is sent once for each cell that it touches.
TRACK_CELL = 0.0072
#: Of the points inside a way's segments each so many-th is tried first.
FEW = 16
#: Dropped ways up to so many tolerances long may link what was kept.
LINK_TOLERANCES = 2


def _segments(shapes: DataFrame) -> DataFrame:
    """The columns of shapes without coords, and i, p, q, step (metres) and at (metres along the way where the segment ends); p is null at the first vertex."""
    order = W.partitionBy("way_id", "band").orderBy("i")
    rows = shapes.select(*(c for c in shapes.columns if c != "coords"), F.posexplode("coords").alias("i", "q")).withColumn("p", F.lag("q").over(order))
    step = F.coalesce(metres(F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat")), F.lit(0.0))
    return rows.withColumn("step", step).withColumn("at", F.sum("step").over(order))


def _multiples(every: int) -> tuple[Column, Column]:
    """A way's sample points are its vertices and a point at each whole multiple of the tolerance along it: the first and last multiple inside a segment, divided by `every`."""
    return F.floor((F.col("at") - F.col("step")) / F.col("tolerance") / every) + 1, F.ceil(F.col("at") / F.col("tolerance") / every) - 1


def _once(rows: DataFrame, name: str, **made: Column) -> DataFrame:
    """rows with a struct of what is made: exploded, so that a value used many times is worked out once."""
    return rows.select("*", F.explode(F.array(F.struct(*(v.alias(n) for n, v in made.items())))).alias(name))


def _along(segment: str, share: Column) -> tuple[Column, Column]:
    """lon and lat at a share of a segment (its fields p_lon, p_lat, q_lon, q_lat stand behind the prefix)."""
    field = lambda c: F.col(segment + c)
    return tuple(field(f"p_{axis}") + (field(f"q_{axis}") - field(f"p_{axis}")) * share for axis in ("lon", "lat"))


def _share(segment: str, k: Column, every: int, tolerance: str) -> Column:
    """Where the k-th point inside a segment lies on it."""
    return (k * every * F.col(tolerance) - (F.col(f"{segment}at") - F.col(f"{segment}step"))) / F.col(f"{segment}step")


def _point_cells(segments: DataFrame, every: int) -> DataFrame:
    """x, y, here and pieces of a way in each grid cell that has any of its points, one row for each cell; of the points inside segments each so many-th.

    Points of a segment in a cell follow each other, so a piece is that segment (i, at, step, both ends) and the first
    and last of them (lo, hi; null: none), and whether its end (a vertex) lies there too. here: how many points.
    """
    first, last = _multiples(every)
    flat = segments.withColumns({f"{e}_{axis}": F.col(f"{e}.{axis}") for e in "pq" for axis in ("lon", "lat")})
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    own = ["i", "at", "step", "p_lon", "p_lat", "q_lon", "q_lat"]
    of_way = ["way_id", "band", "lines", "place"]
    rows = flat.select(*of_way, "tolerance", *own, F.explode(F.concat(inside, F.array(F.lit(None).cast("bigint")))).alias("k"))
    lon, lat = (F.when(F.col("k").isNull(), F.col(f"q_{axis}")).otherwise(at) for axis, at in zip(("lon", "lat"), _along("", _share("", F.col("k"), every, "tolerance")), strict=True))
    rows = rows.select(*of_way, *own, "k", F.floor(lon / TRACK_CELL).alias("x"), F.floor(lat / TRACK_CELL).alias("y"))
    pieces = rows.groupBy(*of_way, *own, "x", "y").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("here"), F.count_if(F.col("k").isNull()).alias("ends"))
    return pieces.groupBy(*of_way, "x", "y").agg(F.sum("here").alias("here"), F.collect_list(F.struct(*own, "lo", "hi", (F.col("ends") > 0).alias("end"))).alias("pieces"))


def _segment_cells(segments: DataFrame) -> DataFrame:
    """x, y and both ends of each segment of a way, for each grid cell that the segment, widened by the tolerance, touches."""
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("q.lon") - F.col("p.lon")), F.abs(F.col("q.lat") - F.col("p.lat"))) / TRACK_CELL)).cast("int")
    own = ["way_id", "band", "lines", "place", "before", "tolerance", "p_lon", "p_lat", "q_lon", "q_lat"]
    flat = segments.where("p is not null").withColumns({f"{e}_{axis}": F.col(f"{e}.{axis}") for e in "pq" for axis in ("lon", "lat")})
    rows = flat.select(*own, parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    north = F.col("tolerance") / METRES_PER_DEGREE

    def box(k: Column) -> dict[str, Column]:
        """Cells of the k-th part: first and last in both directions."""
        (a_lon, a_lat), (b_lon, b_lat) = _along("", k / F.col("parts")), _along("", (k + 1) / F.col("parts"))
        east = north / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(a_lat), F.abs(b_lat)) + north)))
        ends = ("x", a_lon, b_lon, east), ("y", a_lat, b_lat, north)
        return {f"{c}{n}": F.floor(v / TRACK_CELL) for c, a, b, wide in ends for n, v in enumerate((F.least(a, b) - wide, F.greatest(a, b) + wide))}

    rows = _once(rows, "own", **box(F.col("k")))
    rows = _once(rows, "last", **box(F.col("k") - 1))
    rows = rows.select("*", F.explode(F.sequence("own.x0", "own.x1")).alias("x")).select("*", F.explode(F.sequence("own.y0", "own.y1")).alias("y"))
    # What the part before has reached already.
    again = (F.col("k") > 0) & F.col("x").between(F.col("last.x0"), F.col("last.x1")) & F.col("y").between(F.col("last.y0"), F.col("last.y1"))
    return rows.where(~again).select(*own, "x", "y")


def _full_cells(points: DataFrame, others: DataFrame, every: int) -> DataFrame:
    """line_id, way_id, band, here and near (other, word, bits) of the cells of a way in which each of its points (so many are here) is near a way of the line that comes before.

    Bit j of a word w says that the point of number 64 w + j is near: one row for each word and not for each point.
    """
    met = points.join(others, ["band", "x", "y"]).where("other_before or other_place < place").where("other <> way_id").where(F.arrays_overlap("lines", "other_lines"))
    met = met.select("band", "x", "y", "way_id", "other", "tolerance", "here", "p_lon", "p_lat", "q_lon", "q_lat", F.array_intersect("lines", "other_lines").alias("shared"), F.explode("pieces").alias("c"))
    inside = F.when(F.col("c.lo").isNotNull(), F.sequence("c.lo", "c.hi")).otherwise(F.array().cast("array<bigint>"))
    met = met.select("*", F.explode(F.when(F.col("c.end"), F.concat(inside, F.array(F.lit(None).cast("bigint")))).otherwise(inside)).alias("k"))
    end = F.col("k").isNull()
    lon, lat = (F.when(end, F.col(f"c.q_{axis}")).otherwise(at) for axis, at in zip(("lon", "lat"), _along("c.", _share("c.", F.col("k"), every, "tolerance")), strict=True))
    met = met.select("*", lon.alias("lon"), lat.alias("lat"), F.when(end, 2 * F.col("c.i") + 1).otherwise(2 * F.col("k")).alias("n"))
    met = met.select("*", (METRES_PER_DEGREE * F.cos(F.radians("lat"))).alias("east"))
    met = met.select("*", ((F.col("p_lon") - F.col("lon")) * F.col("east")).alias("ax"), ((F.col("p_lat") - F.col("lat")) * METRES_PER_DEGREE).alias("ay"), ((F.col("q_lon") - F.col("p_lon")) * F.col("east")).alias("dx"), ((F.col("q_lat") - F.col("p_lat")) * METRES_PER_DEGREE).alias("dy"))
    ax, ay, dx, dy, t = map(F.col, ("ax", "ay", "dx", "dy", "t"))
    size = dx * dx + dy * dy
    met = met.select("*", F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0).alias("t"))
    # Exploded and not filtered: a filter would be moved before the steps above, with all of them in it.
    near = F.when(F.hypot(ax + t * dx, ay + t * dy) <= F.col("tolerance"), F.col("shared")).otherwise(F.slice("shared", 1, 0))
    met = met.select("band", "x", "y", "way_id", "here", "other", "n", F.explode(near).alias("line_id"))
    key = ["band", "x", "y", "line_id", "way_id", "here"]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n").bitwiseAND(63).cast("int"))
    cells = met.groupBy(*key, "other", F.shiftright("n", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).groupBy(*key).agg(F.collect_list(F.struct("other", "word", "bits")).alias("near"))
    of_word = lambda w: F.aggregate(F.filter("near", lambda e: e["word"] == w), F.lit(0).cast("bigint"), lambda bits, e: bits.bitwiseOR(e["bits"]))
    return cells.where(F.aggregate(F.array_distinct("near.word"), F.lit(0), lambda n, w: n + F.bit_count(of_word(w))) == F.col("here"))


def _near_all(segments: DataFrame, others: DataFrame, every: int) -> DataFrame:
    """line_id, way_id, band, points (how many) and near (other, word, bits) of the ways all points of which are near ways of the line that come before."""
    first, last = _multiples(every)
    counts = segments.groupBy("way_id", "band").agg(F.sum(F.greatest(last - first + 1, F.lit(0)) + 1).alias("points"))
    full = _full_cells(_point_cells(segments, every), others, every)
    per = full.groupBy("way_id", "band", "line_id").agg(F.sum("here").alias("here"), F.flatten(F.collect_list("near")).alias("near"))
    return per.join(counts, ["way_id", "band"]).where("here = points").drop("here")


def contested(shapes: DataFrame) -> DataFrame:
    """line_id, way_id, points and near (array of n and other) of the ways whose points all lie within the tolerance of ways of the same line that come before; the others stay, whatever is decided of those.

    shapes: way_id, coords, tolerance, band (its text: joins and groups by a double are dealt twice), lines (array of ids),
    place (the way's order, no two alike) and before (kept outright). n: number of a point. Points and segments of a way are one row
    for each grid cell, cells meet in an equi join, only ways of a line in the right order are compared, and a way's
    points in a cell are judged there: a cell with a point that nothing is near sends nothing on. A few points of
    each way are tried first, as most ways stay by those, all points of the rest then; what was shuffled for the first
    is gone before the second.
    """
    segments = _segments(shapes)
    others = _segment_cells(segments).withColumnsRenamed({"way_id": "other", "lines": "other_lines", "place": "other_place", "before": "other_before"})
    tried = segments.where("not before")
    rest = settled(_near_all(tried, others, FEW).select("way_id", "band").distinct())
    found = _near_all(tried.join(rest, ["way_id", "band"], "left_semi"), others, 1).drop("band")
    numbers = lambda e: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftright", e["bits"], j).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return found.withColumn("near", F.flatten(F.transform("near", lambda e: F.transform(numbers(e), lambda j: F.struct((e["word"] * 64 + j).alias("n"), e["other"].alias("other"))))))


def kept_units(units: DataFrame, contested: DataFrame) -> DataFrame:
    """line_id, way_id and kept of each unit: a way goes when all its points are near kept ways of the same line that come before it.

    units: line_id, way_id. contested: those that are not kept whatever happens, with points and near. Rounds: a way goes when
    kept ways cover all its points, and stays when at some point neither a kept nor an open way before it is near. The first
    open way of a line is always decided, mostly nearly all are; the result is that of trying them one by one.
    """
    key = ["line_id", "way_id"]
    tables, done, pairs, verdicts = (Rounds(units.sparkSession) for _ in range(4))
    first = verdicts.settled(contested)
    open_ = tables.settled(first.select(*key, "points"))
    waiting = first.select(*key, F.explode("near").alias("e")).groupBy(*key, "e.other").agg(F.collect_list("e.n").alias("ns"))
    known = done.added(units.select(*key).join(open_, key, "left_anti").withColumn("kept", F.lit(True)))
    points_of = lambda on: F.array_distinct(F.flatten(F.collect_list(F.when(on, F.col("ns")))))
    while open_.limit(1).count():
        rest = pairs.settled(waiting)
        seen = rest.join(known.select("line_id", F.col("way_id").alias("other"), F.col("kept").alias("other_kept")), ["line_id", "other"], "left")
        per = seen.groupBy(*key).agg(points_of(F.coalesce("other_kept", F.lit(False))).alias("covered"), F.size(points_of(F.coalesce("other_kept", F.lit(True)))).alias("hope"))
        held = open_.join(per, key, "left").withColumns({"covered": F.coalesce("covered", F.array().cast("array<bigint>")), "hope": F.coalesce("hope", F.lit(0))})
        verdict = F.when(F.size("covered") == F.col("points"), False).when(F.col("hope") < F.col("points"), True)
        judged = verdicts.settled(held.select(*key, (F.col("points") - F.size("covered")).alias("points"), "covered", verdict.alias("kept")))
        # Covered points and ways that went don't matter any more.
        still = judged.where("kept is null")
        left = seen.where("other_kept is null").join(still.select(*key, "covered"), key).select(*key, "other", F.array_except("ns", "covered").alias("ns"))
        waiting = left.where(F.size("ns") > 0)
        known = done.added(judged.where("kept is not null").select(*key, "kept"))
        open_ = tables.settled(still.select(*key, "points"))
    return done.all().drop("round")


def links_between(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """line_id and way_id of the dropped ways to put back: those that link separate kept stretches of their line.

    kept: line_id, way_id, from_node, to_node. dropped: the same and length. Kept ways that share an end are one
    stretch, a node of the graph; the shortest dropped ways that join two trees form a forest, and ends of it that
    are no kept stretch are taken off, again and again.
    """
    spot = lambda c: F.struct("line_id", F.col(c).alias("node"))
    ends = kept.select(spot("from_node").alias("a"), spot("to_node").alias("b"))
    stretches = components(ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))), ends)
    name = lambda c: stretches.select(F.col("node").alias(c), F.col("component").alias(f"{c}_at"))
    placed = dropped.select("line_id", "way_id", spot("from_node").alias("a"), spot("to_node").alias("b"), F.struct("length", "line_id", "way_id").alias("rank"))
    placed = placed.join(name("a"), "a", "left").join(name("b"), "b", "left").select("line_id", "way_id", F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"), "rank").where("a <> b")
    forest = spanning_forest(settled(placed))
    terminals = settled(stretches.select(F.col("component").alias("node")).distinct())
    tables = Rounds(kept.sparkSession)
    live = tables.settled(forest)
    while True:
        nodes = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node")))
        loose = nodes.groupBy("node").count().where("count = 1").join(terminals, "node", "left_anti").select("node")
        loose = settled(loose)
        if not loose.limit(1).count():
            return live.select("line_id", "way_id")
        live = tables.settled(live.join(loose.withColumnRenamed("node", "a"), "a", "left_anti").join(loose.withColumnRenamed("node", "b"), "b", "left_anti"))


def _collapsed(units: DataFrame, ways: DataFrame, tolerance: Column) -> DataFrame:
    """line_id, way_id and linked of what stays. units: line_id, way_id, lines, before (both alike for all lines of a way) and what the tolerance is made of, one tolerance for each way and line; ways: way_id, coords."""
    place = F.struct((-F.col("lines")).alias("lines"), (-F.col("length")).alias("length"), "way_id")
    held = units.join(ways.where(F.size("coords") >= 2).select("way_id", "coords"), "way_id").withColumns({"tolerance": tolerance.cast("double"), "length": length_of(F.col("coords"))}).withColumn("place", place)
    held = settled(held.select("line_id", "way_id", "tolerance", "before", "length", "place", "coords"))
    # Points and neighbours once for each way and tolerance, whatever number of lines it has.
    # In as many parts as a shuffle has: few and large ones, as these small rows suggest, would spill what is made of them.
    dealt = held.where("tolerance > 0").withColumn("band", F.col("tolerance").cast("string")).repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "way_id", "band")
    shapes = dealt.groupBy("way_id", "band").agg(F.array_sort(F.collect_set("line_id")).alias("lines"), *(F.any_value(c).alias(c) for c in ("tolerance", "place", "before", "coords")))
    sized = settled(held.select("line_id", "way_id", "tolerance", "length", node_key(F.col("coords")[0], 7).alias("from_node"), node_key(F.element_at("coords", -1), 7).alias("to_node")))
    state = kept_units(sized, contested(shapes))
    judged = settled(sized.join(state, ["line_id", "way_id"]))
    stays = judged.where("kept").select("line_id", "way_id", "from_node", "to_node")
    back = links_between(stays, judged.where("not kept").where(F.col("length") <= LINK_TOLERANCES * F.col("tolerance")).select("line_id", "way_id", "from_node", "to_node", "length"))
    return stays.select("line_id", "way_id", F.lit(False).alias("linked")).unionByName(back.withColumn("linked", F.lit(True)))


def canonical_ways(line_ways: DataFrame, ways: DataFrame, tolerance: float = OTHER_TOLERANCE) -> DataFrame:
    """way_id and linked of the ways that stay when the whole network is one line: one track for each corridor, and the short ways that link them.

    Ways are tried by number of lines, length and id. line_ways: line_id, way_id. ways: way_id, coords. Ways of no line and without geometry take no part.
    """
    units = line_ways.distinct().groupBy("way_id").agg(F.count("*").alias("lines")).select(F.lit(0).alias("line_id"), "way_id", "lines", F.lit(False).alias("before"))
    return _collapsed(units, ways, F.lit(tolerance)).select("way_id", "linked")


def collapse_tracks(line_ways: DataFrame, ways: DataFrame, lines: DataFrame, settled_ways: DataFrame | None = None) -> DataFrame:
    """line_id, way_id without tracks that run beside one kept already, within the tolerance of the line's mode.

    Ways are tried by number of lines, length and id; those of settled_ways (the network's canonical ones) are kept outright.
    A way goes when all its sample points lie within the tolerance of kept ways. Short dropped ways that link kept
    stretches come back, without dead ends. ways: way_id, coords, lines.
    """
    by_mode = F.create_map(*(F.lit(x) for pair in TOLERANCE.items() for x in pair))[F.col("mode")]
    units = line_ways.distinct().join(ways.select("way_id", "lines"), "way_id").join(lines.select("line_id", F.coalesce(by_mode, F.lit(OTHER_TOLERANCE)).alias("within")), "line_id")
    before = F.lit(False)
    if settled_ways is not None:
        units = units.join(settled_ways.select("way_id", F.lit(True).alias("_settled")).distinct(), "way_id", "left")
        before = F.coalesce("_settled", F.lit(False))
    return _collapsed(units.select("line_id", "way_id", "lines", before.alias("before"), "within"), ways, F.col("within")).select("line_id", "way_id")
