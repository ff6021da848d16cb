"""Corridor geometry: chains, orientation, tapers, route features, stop marks."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import METRES_PER_DEGREE, metres
from trackweave.operators.graph import parities, settled, spanning_forest
from trackweave.operators.spatial import nearest

STRAIGHT_ON, ALIGNED = math.radians(25), 0.5
TAPER_METRES, TRAM_TAPER_METRES, MOST_PITCHES, CHAIN_SHARE, LEAST_TAPER = 80.0, 40.0, 3, 0.4, 12.0
MARK_METRES, MERGE_DEGREES, MERGE_ACROSS = 300.0, 25.0, 12.0
#: Metres of a web map's pixel at zoom 0 on the latitude that tapers are drawn for.
PIXEL_METRES = 156_543.03392 * math.cos(math.radians(51))


def _key(point) -> tuple[int, int]:
    return round(point[0] * 1e7), round(point[1] * 1e7)


def chained(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Polylines joined end to end, in their order: each grows from its tail, then from its head, by the first unused one that meets it."""
    at = defaultdict(list)
    for i, line in enumerate(lines):
        for end in (line[0], line[-1]):
            at[_key(end)].append(i)
    free, out = set(range(len(lines))), []

    def following(end) -> list | None:
        i = next((i for i in at[_key(end)] if i in free), None)
        if i is None:
            return None
        free.discard(i)
        return lines[i] if _key(lines[i][0]) == _key(end) else lines[i][::-1]

    for i, line in enumerate(lines):
        if i not in free:
            continue
        free.discard(i)
        chain = list(line)
        for _ in range(2):
            while more := following(chain[-1]):
                chain += more[1:]
            chain.reverse()
        out.append(chain)
    return out


def stitched(chains: list[list[tuple[float, float]]], snap: float) -> list[list[tuple[float, float]]]:
    """Chains whose ends nearly meet and carry straight on, joined with the smallest gap first; no rings, no end twice."""
    if len(chains) < 2:
        return chains
    ends = []
    for c, chain in enumerate(chains):
        for side, (end, inner) in enumerate(((chain[0], chain[1]), (chain[-1], chain[-2]))):
            k = math.cos(math.radians(end[1]))
            ends.append((c, side, end, math.atan2(end[1] - inner[1], (end[0] - inner[0]) * k)))
    meets = []
    for i, (ca, sa, pa, ta) in enumerate(ends):
        for cb, sb, pb, tb in ends[i + 1 :]:
            gap = math.hypot((pb[0] - pa[0]) * METRES_PER_DEGREE * math.cos(math.radians(pa[1])), (pb[1] - pa[1]) * METRES_PER_DEGREE)
            turn = abs(math.remainder(ta - tb - math.pi, 2 * math.pi))
            if ca != cb and gap <= snap and turn <= STRAIGHT_ON:
                meets.append((gap, ca, sa, cb, sb))
    owner, used, whole = list(range(len(chains))), set(), {i: ([*c], (i, 0), (i, 1)) for i, c in enumerate(chains)}
    for _, ca, sa, cb, sb in sorted(meets):
        a, b = owner[ca], owner[cb]
        if a == b or (ca, sa) in used or (cb, sb) in used:
            continue
        (pa, ha, ta), (pb, hb, tb) = whole.pop(a), whole.pop(b)
        if ta != (ca, sa):
            pa, ha, ta = pa[::-1], ta, ha
        if hb != (cb, sb):
            pb, hb, tb = pb[::-1], tb, hb
        used |= {(ca, sa), (cb, sb)}
        whole[a] = (pa + pb, ha, tb)
        owner = [a if o == b else o for o in owner]
    return [w[0] for _, w in sorted(whole.items())]


def chain_ways(segment_ways: DataFrame, ways: DataFrame, snap: float = 0.0) -> DataFrame:
    """seg_id, chain and coords: a corridor's ways joined end to end, in order of first appearance (column n), then way_id. A corridor is one small group."""
    rows = segment_ways.join(ways.where(F.size("coords") >= 2).select("way_id", "coords"), "way_id")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "way_id"])
        lines = [[(p["lon"], p["lat"]) for p in c] for c in group["coords"]]
        chains = chained(lines)
        chains = stitched(chains, snap) if snap > 0 else chains
        return pd.DataFrame({"seg_id": group["seg_id"].iloc[0], "chain": range(len(chains)), "coords": [[{"lon": x, "lat": y} for x, y in c] for c in chains]})

    kind = dict(segment_ways.dtypes)["seg_id"]
    return rows.select("seg_id", "n", "way_id", "coords").groupBy("seg_id").applyInPandas(join, f"seg_id {kind}, chain int, coords array<struct<lon:double,lat:double>>")


def coorient(chains: DataFrame) -> DataFrame:
    """chain_id and flip: chains that carry on from one another face one way, the one that most metres of the group run: east, or north.

    chains: chain_id, from_node, to_node, from_dir and to_dir (struct x, y: unit step out of the chain at its ends),
    east and north (metres that it runs). Ends that meet along a line (dot of 0.5 at least, either sign) bind two chains;
    straightest first, and what contradicts an earlier one is dropped, so the binding ones are a spanning forest.
    """
    ends = chains.select("chain_id", F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("from_dir").alias("d"), F.lit(0).alias("side")), F.struct(F.col("to_node").alias("node"), F.col("to_dir").alias("d"), F.lit(1).alias("side")))).alias("e")).select("chain_id", "e.*")
    a, b = ends.selectExpr("chain_id AS a", "node", "d AS da", "side AS sa"), ends.selectExpr("chain_id AS b", "node", "d AS db", "side AS sb")
    dot = F.col("da.x") * F.col("db.x") + F.col("da.y") * F.col("db.y")
    pairs = a.join(b, "node").where("a < b").withColumn("dot", dot).where(F.col("dot") <= -ALIGNED)
    # Out of one and into the other: opposite sides run on, equal sides face each other.
    pairs = pairs.withColumn("odd", (F.col("sa") == F.col("sb")).cast("int"))
    ranked = pairs.withColumn("rank", F.struct(F.col("dot").alias("k"), "a", "b", "sa", "sb"))
    forest = settled(spanning_forest(ranked.select("a", "b", "rank", "odd")))
    known = parities(chains.select(F.col("chain_id").alias("node")), forest)
    sign = F.when(F.col("parity") == 0, 1.0).otherwise(-1.0)
    faced = known.join(chains.select(F.col("chain_id").alias("node"), "east", "north"), "node")
    sums = faced.groupBy("component").agg(F.sum(sign * F.col("east")).alias("e"), F.sum(sign * F.col("north")).alias("n"))
    turn = F.when(F.abs("e") >= F.abs("n"), F.col("e") < 0).otherwise(F.col("n") < 0)
    return faced.join(sums, "component").select(F.col("node").alias("chain_id"), ((F.col("parity") == 1) != turn).alias("flip"))


def taper_length(mode: Column, delta: Column, up: Column, down: Column) -> Column:
    """Metres of a taper over so many places: what the mode asks for, up to 40 % of either chain from both sides, none under 12 m."""
    want = F.when(mode == "tram", TRAM_TAPER_METRES).otherwise(TAPER_METRES) * F.least(F.greatest(F.abs(delta), F.lit(1.0)), F.lit(float(MOST_PITCHES)))
    fitted = F.least(want, 2 * CHAIN_SHARE * F.least(up, down))
    return F.when(fitted >= LEAST_TAPER, fitted).otherwise(0.0)


def taper_minzoom(length: Column) -> Column:
    return F.ceil(F.log2(F.lit(PIXEL_METRES) / length)).cast("int")


def taper_candidates(ends: DataFrame, slots: DataFrame, lines: DataFrame) -> DataFrame:
    """node, line_id, outcome and, where the line goes on between exactly two corridors, both corridors, slots and length.

    ends: node, seg_id, side (-1 where the chain begins, 1 where it ends), metres. outcome: taper, level (equal slots), short, ambiguous, ends.
    Slots are signed by how the chain runs through the node.
    """
    rows = ends.join(slots, "seg_id")
    per = rows.groupBy("node", "line_id").agg(F.count("*").alias("n"), F.countDistinct("seg_id").alias("segments"), F.array_sort(F.collect_list(F.struct("seg_id", "side", "slot", "metres"))).alias("e"))
    one, two = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    clear = (F.col("n") == 2) & (F.col("segments") == 2)
    # The second chain is seen as it leaves the node; if both begin or both end there its places change sides.
    second = F.when(one["side"] == two["side"], -two["slot"]).otherwise(two["slot"])
    out = per.join(lines.select("line_id", "mode"), "line_id").withColumns({"delta": F.when(clear, second - one["slot"]), "length": F.when(clear, taper_length(F.col("mode"), second - one["slot"], one["metres"], two["metres"]))})
    outcome = F.when(F.col("n") < 2, "ends").when(~clear, "ambiguous").when(F.col("delta") == 0, "level").when(F.col("length") == 0, "short").otherwise("taper")
    return out.select("node", "line_id", outcome.alias("outcome"), F.when(clear, one["seg_id"]).alias("seg_a"), F.when(clear, two["seg_id"]).alias("seg_b"), "delta", "length")


def route_features(chains: DataFrame, slots: DataFrame, trims: DataFrame) -> DataFrame:
    """seg_id, chain, line_id, slot and coords of each line on each chain, shortened at its ends where a taper takes over.

    chains: seg_id, chain, coords. trims: seg_id, chain, line_id, start_m, end_m (several add up). Points nearer to an
    end than the trim go; the cut point is set on the segment that it falls on. What is trimmed away whole is left out.
    """
    cut = trims.groupBy("seg_id", "chain", "line_id").agg(F.sum("start_m").alias("start_m"), F.sum("end_m").alias("end_m"))
    steps = F.transform("coords", lambda p, i: F.when(i == 0, 0.0).otherwise(metres(F.get(F.col("coords"), i - 1)["lon"], F.get(F.col("coords"), i - 1)["lat"], p["lon"], p["lat"])))
    along = F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, 1, i + 1), F.lit(0.0), lambda a, x: a + x))
    measured = chains.withColumn("at", along).withColumn("total", F.element_at("at", -1))
    rows = measured.join(slots.select("seg_id", "line_id", "slot"), "seg_id").join(cut, ["seg_id", "chain", "line_id"], "left")
    rows = rows.withColumns({"a": F.coalesce("start_m", F.lit(0.0)), "b": F.col("total") - F.coalesce("end_m", F.lit(0.0))}).where("a < b")
    zipped = F.arrays_zip("coords", "at")

    def point(where: Column) -> Column:
        i = F.greatest(F.size(F.filter("at", lambda x: x <= where)) - 1, F.lit(0))
        p, q, d = F.get("coords", i), F.coalesce(F.get("coords", i + 1), F.get("coords", i)), F.coalesce(F.get("at", i + 1) - F.get("at", i), F.lit(1.0))
        t = (where - F.get("at", i)) / F.when(d > 0, d).otherwise(1.0)
        return F.struct((p["lon"] + (q["lon"] - p["lon"]) * t).alias("lon"), (p["lat"] + (q["lat"] - p["lat"]) * t).alias("lat"))

    inner = F.transform(F.filter(zipped, lambda z: (z["at"] > F.col("a")) & (z["at"] < F.col("b"))), lambda z: F.struct(z["coords"]["lon"].alias("lon"), z["coords"]["lat"].alias("lat")))
    return rows.select("seg_id", "chain", "line_id", "slot", F.concat(F.array(point(F.col("a"))), inner, F.array(point(F.col("b")))).alias("coords"))


def mark_runs(calls: DataFrame, slots: DataFrame) -> DataFrame:
    """bundle, station, run, lo, hi and lines: unbroken runs of places whose lines call at the station. calls: seg_id, station_id, line_id. slots as by slot_ordinals."""
    hit = slots.join(calls, ["seg_id", "line_id"])
    order = W.partitionBy("seg_id", "station_id").orderBy("ordinal")
    island = F.col("ordinal") - F.row_number().over(order)
    return hit.withColumn("_island", island).groupBy("seg_id", "station_id", "_island").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.array_sort(F.collect_list("line_id")).alias("lines"), F.min("ordinal").alias("first")).drop("_island")


def anchors(stations: DataFrame, vertices: DataFrame, served: DataFrame, slots: DataFrame, radius: float = MARK_METRES) -> DataFrame:
    """seg_id, station_id, the nearest vertex of the corridor within the radius, the nearest place (lon, lat, distance) on the two segments beside it and the direction of its segment (bearing), for stations at which a line of the corridor calls.

    vertices: seg_id, chain, pos, lon, lat. Vertices are spread over cells: a corridor has few, and many stations may call.
    """
    calling = slots.select("seg_id", "line_id").join(served, "line_id").select("seg_id", "station_id").distinct()
    wanted = stations.select("station_id", "lon", "lat").join(calling, "station_id")
    found = nearest(wanted.withColumn("_pair", F.struct("seg_id", "station_id")), vertices.select("seg_id", "lon", "lat", F.struct("chain", "pos").alias("vertex")), "_pair", "vertex", radius, inclusive=True, on=["seg_id"], spread="right")
    found = found.select("seg_id", "station_id", "vertex", "vertex.chain", "vertex.pos", "lon", "lat", F.struct("distance", F.col("r_lon").alias("lon"), F.col("r_lat").alias("lat")).alias("v"))
    for name, step in (("before", 1), ("after", -1)):
        beside = vertices.select("seg_id", "chain", (F.col("pos") + step).alias("pos"), F.struct("lon", "lat").alias(name))
        found = found.join(beside, ["seg_id", "chain", "pos"], "left")
    def foot(name: str, a: Column, b: Column) -> Column:
        way = direction(a, b)
        own = once(segment_foot(F.col("lon"), F.col("lat"), a, b), lambda f: F.struct(f["distance"].alias("distance"), f["lon"].alias("lon"), f["lat"].alias("lat"), way.alias("bearing")))
        return F.when(F.col(name).isNotNull(), own).alias(name)

    v = F.col("v")
    feet = foot("before", F.col("before"), v), foot("after", v, F.col("after"))
    alone = F.struct("v.distance", "v.lon", "v.lat", F.lit(0.0).alias("bearing"))

    def nearer(feet: Column) -> Column:
        first, second = feet["before"], feet["after"]
        return F.when(first.isNotNull() & (second.isNull() | (first["distance"] <= second["distance"])), first).otherwise(F.coalesce(second, alone))

    return found.withColumn("f", once(F.struct(*feet), nearer)).where(F.col("f.distance") <= radius).select("seg_id", "station_id", "vertex", "f.lon", "f.lat", "f.distance", "f.bearing")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def direction(p: Column, q: Column) -> Column:
    """Degrees clockwise from north of the way from p to q, not folded: which side is right depends on it."""
    east = (q["lon"] - p["lon"]) * F.cos(F.radians((p["lat"] + q["lat"]) / 2))
    return F.pmod(F.lit(90.0) - F.degrees(F.atan2(q["lat"] - p["lat"], east)), F.lit(360.0))


def segment_foot(lon: Column, lat: Column, p: Column, q: Column) -> Column:
    """distance, lon and lat of the place nearest to a point on the segment from p to q; null without q."""
    k = F.cos(F.radians(lat))
    dx, dy = (q["lon"] - p["lon"]) * k, q["lat"] - p["lat"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - p["lon"]) * k * dx + (lat - p["lat"]) * dy) / size))).otherwise(0.0)
    place = once(t, lambda t: F.struct((p["lon"] + (q["lon"] - p["lon"]) * t).alias("x"), (p["lat"] + (q["lat"] - p["lat"]) * t).alias("y")))
    return F.when(q.isNotNull(), once(place, lambda s: F.struct(metres(lon, lat, s["x"], s["y"]).alias("distance"), s["x"].alias("lon"), s["y"].alias("lat"))))


def fallback_marks(stations: DataFrame, served: DataFrame, marks: DataFrame) -> DataFrame:
    """A bar of one place on the spot, across a track to the north, for stations that no corridor gives a mark."""
    lines = served.select("station_id", "line_id").distinct().groupBy("station_id").agg(F.array_sort(F.collect_list("line_id")).alias("lines"))
    rest = stations.select("station_id").join(marks.select("station_id"), "station_id", "left_anti").join(lines, "station_id", "left")
    empty = F.array().cast(dict(marks.dtypes)["lines"])
    where = [c for c in ("lon", "lat") if c in marks.columns]
    rest = rest.join(stations.select("station_id", *where), "station_id") if where else rest
    return rest.select("station_id", F.lit(0).alias("mark"), *where, F.lit(0.0).alias("mid"), F.lit(1).alias("span"), F.lit(0.0).alias("bearing"), F.coalesce("lines", empty).alias("lines")).select(*marks.columns)


def station_marks(chains: DataFrame, slots: DataFrame, stations: DataFrame, served: DataFrame, radius: float = MARK_METRES) -> DataFrame:
    """station_id, mark, lon, lat, mid, span, bearing, lines and primary of the bars of all stations at which a line calls.

    A bar lies across a corridor at the place nearest to the station and spans an unbroken run of the lines that call;
    bars of corridors that carry on along one heading are one. Where no corridor within the radius gives one, there is a
    bar of one place on the station's own spot. chains: seg_id, chain, coords. slots: as by slot_ordinals. stations:
    station_id, lon, lat. served: station_id, line_id. primary is the widest bar of a station, the first of equals.
    """
    calls = served.select("station_id", "line_id").distinct()
    calling = stations.select("station_id", "lon", "lat").join(calls.select("station_id").distinct(), "station_id", "left_semi")
    vertices = chains.select("seg_id", "chain", F.posexplode("coords").alias("pos", "p")).select("seg_id", "chain", "pos", "p.lon", "p.lat")
    spots = settled(anchors(calling, vertices, calls, slots, radius).drop("vertex"))
    pairs = spots.select("seg_id", "station_id").join(calls, "station_id")
    drafts = mark_runs(pairs, slots).join(spots, ["seg_id", "station_id"])
    merged = settled(merge_marks(drafts.select("station_id", "seg_id", "lon", "lat", "bearing", "lo", "hi", "lines")))
    marks = merged.unionByName(fallback_marks(calling, calls, merged))
    first = primary_marks(marks).select("station_id", "mark", F.lit(1).alias("primary"))
    return marks.join(first, ["station_id", "mark"], "left").withColumn("primary", F.coalesce("primary", F.lit(0)))


def merge_marks(drafts: DataFrame) -> DataFrame:
    """Bars of one station: drafts of different corridors along one heading, close beside one another, become one; the widest first, the first that fits takes a draft.

    drafts: station_id, seg_id, lon, lat, bearing, lo, hi, lines. A draft that runs the other way has its places mirrored. A station is one small group.
    """
    def merged(rows: list[dict]) -> list[dict]:
        bars: list[dict] = []
        for r in sorted(rows, key=lambda r: (r["lo"] - r["hi"], r["seg_id"], r["lo"])):
            for bar in bars:
                gap = abs(math.remainder(bar["bearing"] - r["bearing"], 180.0))
                k = METRES_PER_DEGREE * math.cos(math.radians(bar["lat"]))
                east, north = (r["lon"] - bar["lon"]) * k, (r["lat"] - bar["lat"]) * METRES_PER_DEGREE
                t = math.radians(bar["bearing"])
                if bar["seg_id"] != r["seg_id"] and gap <= MERGE_DEGREES and abs(east * math.cos(t) - north * math.sin(t)) <= MERGE_ACROSS:
                    mirrored = abs(math.remainder(bar["bearing"] - r["bearing"], 360.0)) > 90
                    lo, hi = (-r["hi"], -r["lo"]) if mirrored else (r["lo"], r["hi"])
                    bar |= {"lo": min(bar["lo"], lo), "hi": max(bar["hi"], hi), "lines": [*bar["lines"], *(x for x in r["lines"] if x not in bar["lines"])]}
                    break
            else:
                bars.append({**r, "lines": list(r["lines"])})
        return [{"mark": i, "lon": b["lon"], "lat": b["lat"], "mid": (b["lo"] + b["hi"]) / 2, "span": int(b["hi"] - b["lo"] + 0.5) + 1, "bearing": b["bearing"], "lines": sorted(b["lines"])} for i, b in enumerate(bars)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, bars = [], []
            for k, rows in enumerate(batch.column("drafts").to_pylist()):
                made = merged(rows)
                owners += [k] * len(made)
                bars += made
            kinds = [("mark", pa.int32()), ("lon", pa.float64()), ("lat", pa.float64()), ("mid", pa.float64()), ("span", pa.int32()), ("bearing", pa.float64()), ("lines", batch.schema.field("drafts").type.value_type.field("lines").type)]
            columns = [batch.column("station_id").take(pa.array(owners, pa.int64())), *(pa.array([b[name] for b in bars], kind) for name, kind in kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["station_id", *(name for name, _ in kinds)])

    types = dict(drafts.dtypes)
    grouped = drafts.groupBy("station_id").agg(F.collect_list(F.struct("seg_id", "lon", "lat", "bearing", "lo", "hi", "lines")).alias("drafts"))
    return grouped.mapInArrow(merge, f"station_id {types['station_id']}, mark int, lon double, lat double, mid double, span int, bearing double, lines {types['lines']}")


def primary_marks(marks: DataFrame) -> DataFrame:
    """The widest mark of each station, the first of equals."""
    return marks.withColumn("_n", F.row_number().over(W.partitionBy("station_id").orderBy(F.desc("span"), "mark"))).where("_n = 1").drop("_n")
