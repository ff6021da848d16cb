"""Paths on the rail graph: the graph itself, found paths with their geometry, and the closure layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import metres
from trackweave.operators.closures import effect_rank, with_history
from trackweave.operators.graph import arrivals, batch_routes, path_nodes, route_budget, settled
from trackweave.operators.spatial import nearest

POINT_METRES, SNAP_METRES = 100.0, 2_000.0


def node_key(point: Column, digits: int = 6) -> Column:
    """Two vertices are one node if they agree to so many decimals."""
    scale = 10**digits
    return F.concat_ws(":", F.round(point["lon"] * scale).cast("bigint").cast("string"), F.round(point["lat"] * scale).cast("bigint").cast("string"))


def rail_graph(ways: DataFrame, geometry: bool = False) -> DataFrame:
    """Edges src, dst, way_id, metres, ref, service, forward: each way cut where another way ends, both directions, no loops.

    ways: way_id, coords (array of lon, lat), ref, service. With geometry also edge_id (way_id, the place
    where the piece begins, direction) and coords, in the direction of the edge.
    """
    rows = ways.where(F.size("coords") >= 2).select("way_id", "ref", "service", F.size("coords").alias("size"), F.posexplode("coords").alias("pos", "p")).withColumn("node", node_key(F.col("p")))
    is_end = (F.col("pos") == 0) | (F.col("pos") == F.col("size") - 1)
    ends = rows.where(is_end).select("node").distinct().withColumn("_end", F.lit(True))
    order = W.partitionBy("way_id").orderBy("pos")
    step = metres(F.lag("p.lon").over(order), F.lag("p.lat").over(order), F.col("p.lon"), F.col("p.lat"))
    measured = rows.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("at", F.sum("_step").over(order))
    cuts = measured.join(ends, "node", "left_semi")
    after = cuts.select("way_id", "ref", "service", F.col("node").alias("src"), F.lead("node").over(order).alias("dst"), (F.lead("at").over(order) - F.col("at")).alias("metres"), "pos", F.lead("pos").over(order).alias("to"))
    forward = after.where("dst is not null and src <> dst").withColumn("forward", F.lit(True))
    back = forward.withColumns({"src": F.col("dst"), "dst": F.col("src"), "forward": F.lit(False)})
    both = forward.unionByName(back)
    plain = ["way_id", "ref", "service", "src", "dst", "metres", "forward"]
    if not geometry:
        return both.select(*plain)
    piece = F.slice("coords", F.col("pos") + 1, F.col("to") - F.col("pos") + 1)
    placed = both.join(ways.select("way_id", "coords"), "way_id")
    return placed.select(*plain, F.struct("way_id", "pos", "forward").alias("edge_id"), F.when(F.col("forward"), piece).otherwise(F.reverse(piece)).alias("coords"))


def graph_nodes(ways: DataFrame) -> DataFrame:
    """node, lon, lat of the ends of the ways."""
    p = ways.select(F.explode(F.array(F.col("coords")[0], F.element_at("coords", -1))).alias("p"))
    return p.groupBy(node_key(F.col("p")).alias("node")).agg(F.min("p.lon").alias("lon"), F.min("p.lat").alias("lat"))


def path_geometry(reached: DataFrame, trips: DataFrame, edges: DataFrame) -> DataFrame:
    """trip_id, coords and ways of each found path, from its source to its target.

    reached: as batch_routes gives it for edges that carry edge_id and coords (in their own direction).
    Each edge brings its whole geometry; the vertex that it shares with the edge before is written once.
    """
    steps = path_nodes(reached, trips).where("hops > 0").select("trip_id", "hops", F.col("via").alias("edge_id"))
    pieces = steps.join(edges.select("edge_id", "way_id", "coords"), "edge_id")
    own = F.when(F.col("hops") > 1, F.slice("coords", 2, F.greatest(F.size("coords") - 1, F.lit(0)))).otherwise(F.col("coords"))
    ordered = pieces.select("trip_id", F.struct("hops", "way_id", own.alias("coords")).alias("s")).groupBy("trip_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("trip_id", F.flatten("s.coords").alias("coords"), F.col("s.way_id").alias("ways"))


def length_of(coords: Column) -> Column:
    """Metres along a polyline."""
    steps = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords)), lambda p, q: metres(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def trimmed(coords: Column, start: Column, end: Column) -> Column:
    """The stretch between the vertices nearest to two points (structs lon, lat; the first of equally near ones); the whole where they come in the other order."""

    def nearest_vertex(point: Column) -> Column:
        gaps = F.transform(coords, lambda p: metres(p["lon"], p["lat"], point["lon"], point["lat"]))
        return F.array_position(gaps, F.array_min(gaps)).cast("int")

    a, b = nearest_vertex(start), nearest_vertex(end)
    return F.when(a < b, F.slice(coords, a, b - a + 1)).otherwise(coords)


def closure_paths(closures: DataFrame, ways: DataFrame, snap: float = SNAP_METRES) -> DataFrame:
    """id, kind (point, section, unmatched), cost, hops, metres, ways and coords of closures put on the track.

    closures: id, from_lon, from_lat, to_lon, to_lat, refs. Ends closer than 100 m are a point, which needs a
    node near; a section needs a path within its budget, which is cut back to the vertices nearest to the stated
    ends. What finds none is unmatched and never a straight line. cost is of the whole path, metres of what is left.
    """
    nodes, edges = graph_nodes(ways), settled(rail_graph(ways, geometry=True))
    chord = metres(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    rows = closures.withColumn("chord", chord).withColumn("point", F.col("chord") < POINT_METRES)
    snapped = lambda side: nearest(rows.select("id", F.col(f"{side}_lon").alias("lon"), F.col(f"{side}_lat").alias("lat")), nodes, "id", "node", snap).select("id", F.col("node").alias(side))
    ends = rows.join(snapped("from"), "id", "left").join(snapped("to"), "id", "left")
    spot = lambda side: F.struct(F.col(f"{side}_lon").alias("lon"), F.col(f"{side}_lat").alias("lat")).alias(f"{side}_spot")
    ends = settled(ends.select("id", "point", "chord", "refs", "from", "to", spot("from"), spot("to")))
    trips = ends.where("not point and from is not null and to is not null and from <> to").select(F.col("id").alias("trip_id"), F.col("from").alias("source"), F.col("to").alias("target"), "refs", route_budget(F.col("chord"), F.size("refs") > 0).alias("budget"))
    reached = settled(batch_routes(edges.select("src", "dst", "metres", "ref", "service", "edge_id"), trips))
    found = arrivals(reached, trips).where("cost is not null").join(path_geometry(reached, trips, edges), "trip_id").withColumnRenamed("trip_id", "id")
    kind = F.when(F.col("point") & F.col("from").isNotNull(), "point").when(F.col("cost").isNotNull() & ~F.col("point"), "section").otherwise("unmatched")
    path = trimmed(F.col("coords"), F.col("from_spot"), F.col("to_spot"))
    out = ends.join(found, "id", "left").withColumn("kind", kind)
    shape = F.when(F.col("kind") == "section", path).when(F.col("kind") == "point", F.array("from_spot"))
    return out.select("id", "kind", "cost", "hops", F.when(F.col("kind") == "section", length_of(path)).alias("metres"), "ways", shape.alias("coords"))


def closure_layer(closures: DataFrame, ways: DataFrame, state: DataFrame | None = None, snap: float = SNAP_METRES) -> DataFrame:
    """The closures that are on the track, with kind, cost, hops, metres, ways, coords and draw_rank (least severe first), and their log's history.

    closures: as for closure_paths, with effect and any further columns. state: as replay gives it; without it there is no history.
    """
    placed = closures.join(closure_paths(closures, ways, snap).where("kind <> 'unmatched'"), "id").withColumn("draw_rank", effect_rank(F.col("effect")))
    if state is None:
        none = {c: F.lit(None).cast("date") for c in ("since", "first_end")}
        return placed.withColumns({**none, "revisions": F.lit(0).cast("long"), "moves": F.lit("")})
    return with_history(placed, state)
