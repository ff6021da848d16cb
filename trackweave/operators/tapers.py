"""Tapers: how a line moves from its place in one corridor to its place in the next, in steps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geo import metres
from trackweave.operators.graph import settled
from trackweave.operators.network import taper_length, taper_minzoom
from trackweave.operators.paths import length_of, node_key

LEAST_STEPS, MOST_STEPS, STEP_PITCH, NUDGE = 3, 8, 0.75, 0.2


class Tapers(NamedTuple):
    """steps: line_id, seg_a, seg_b, node, step (from 0), slot, bundle, min_zoom and coords. trims: seg_id, chain, line_id, start_m, end_m.

    diagnostics: one row with tapered, ambiguous, short, collided, shortened and occupied.
    """

    steps: DataFrame
    trims: DataFrame
    diagnostics: DataFrame


def step_count(delta: Column) -> Column:
    """A step for each three quarters of a place, three to eight."""
    return F.least(F.lit(MOST_STEPS), F.greatest(F.lit(LEAST_STEPS), F.ceil(F.abs(delta) / STEP_PITCH))).cast("int")


def on_occupied_slot(v: Column, up: Column, down: Column) -> Column:
    """Whether a place strictly between the two is whole places away from either, where other lines of the corridors rest."""
    whole = lambda d: F.abs(d - F.floor(d + 0.5)) < 1e-9
    return (v > F.least(up, down)) & (v < F.greatest(up, down)) & (whole(v - up) | whole(v - down))


def step_slots(up: Column, down: Column, steps: Column) -> Column:
    """The place of each step: the middle of its share of the ramp, a fifth of a place further where that is an occupied one."""
    share = (down - up) / steps
    plain = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: up + share * (k + 0.5))
    return F.transform(plain, lambda v: F.when(on_occupied_slot(v, up, down), v + NUDGE * F.signum(share)).otherwise(v))


def along(coords: Column) -> Column:
    """Metres from the first vertex to each."""
    steps = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords)), lambda p, q: metres(p["lon"], p["lat"], q["lon"], q["lat"]))
    start = F.array(F.lit(0.0))
    return F.aggregate(steps, start, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def stretch(coords: Column, at: Column, first: Column, last: Column) -> Column:
    """The part of a polyline between two distances along it; at: of its vertices."""

    def point(where: Column) -> Column:
        i = F.greatest(F.lit(0), F.least(F.size(F.filter(at, lambda x: x <= where)), F.size(at) - 1) - 1)
        p, q, d = F.get(coords, i), F.get(coords, i + 1), F.get(at, i + 1) - F.get(at, i)
        t = F.when(d > 0, (where - F.get(at, i)) / d).otherwise(0.0)
        return F.struct((p["lon"] + (q["lon"] - p["lon"]) * t).alias("lon"), (p["lat"] + (q["lat"] - p["lat"]) * t).alias("lat"))

    inner = F.transform(F.filter(F.zip_with(coords, at, lambda p, x: F.struct(p.alias("p"), x.alias("x"))), lambda z: (z["x"] > first) & (z["x"] < last)), lambda z: F.struct(z["p"]["lon"].alias("lon"), z["p"]["lat"].alias("lat")))
    return F.concat(F.array(point(first)), inner, F.array(point(last)))


def resolve_tapers(chains: DataFrame, slots: DataFrame, lines: DataFrame) -> Tapers:
    """The tapers of all lines at all nodes where exactly two corridors of theirs meet with one chain end each.

    chains: seg_id, chain, coords. slots: seg_id, line_id, slot. lines: line_id, mode. The corridor of the smaller id is
    the one a line comes from; places are signed by the way it runs. Where a chain's tapers would take its whole length,
    all of them are left out. A node of very many chains is two extremes and two counts to each line, never a list.
    """
    sized = settled(chains.where(F.size("coords") >= 2).select("seg_id", "chain", "coords", length_of(F.col("coords")).alias("metres")))
    end = lambda start: F.struct(node_key(F.col("coords")[0] if start else F.element_at("coords", -1), 7).alias("node"), F.lit(start).alias("at_start"))
    ends = sized.select("seg_id", "chain", "metres", F.explode(F.array(end(True), end(False))).alias("e")).select("e.*", "seg_id", "chain", "metres")
    told = F.struct("seg_id", "chain", "at_start", "slot", "metres")
    met = ends.join(slots.select("seg_id", "line_id", "slot"), "seg_id").groupBy("node", "line_id").agg(F.count("*").alias("ends"), F.countDistinct("seg_id").alias("segments"), F.min(told).alias("a"), F.max(told).alias("b"))
    clear = (F.col("segments") == 2) & (F.col("ends") == 2)
    a, b = F.col("a"), F.col("b")
    up = F.when(a["at_start"], -a["slot"]).otherwise(a["slot"])
    down = F.when(b["at_start"], b["slot"]).otherwise(-b["slot"])
    rows = met.where("segments > 1").join(lines.select("line_id", "mode"), "line_id").withColumns({"up": up, "down": down, "delta": down - up})
    full = taper_length(F.col("mode"), F.col("delta"), F.lit(1e9), F.lit(1e9))
    rows = rows.withColumns({"want": full, "length": taper_length(F.col("mode"), F.col("delta"), a["metres"], b["metres"])})
    kind = F.when(~clear, "ambiguous").when(F.col("delta") == 0, "level").when(F.col("length") == 0, "short").otherwise("taper")
    rows = settled(rows.select("node", "line_id", "a", "b", "up", "down", "delta", "want", "length", kind.alias("kind")))
    half = lambda side: F.struct(F.col(side)["seg_id"].alias("seg_id"), F.col(side)["chain"].alias("chain"), F.col(side)["at_start"].alias("at_start"), F.col(side)["metres"].alias("metres"))
    tapers = rows.where("kind = 'taper'")
    cuts = tapers.select("node", "line_id", (F.col("length") / 2).alias("half"), F.explode(F.array(half("a"), half("b"))).alias("c")).select("node", "line_id", "half", "c.*")
    full_chains = cuts.groupBy("seg_id", "chain", "line_id").agg(F.sum("half").alias("cut"), F.max("metres").alias("metres")).where("cut >= metres").select("seg_id", "chain", "line_id")
    collided = settled(cuts.join(full_chains, ["seg_id", "chain", "line_id"], "left_semi").select("node", "line_id").distinct())
    kept = settled(tapers.join(collided, ["node", "line_id"], "left_anti"))
    trims = cuts.join(kept.select("node", "line_id"), ["node", "line_id"], "left_semi").groupBy("seg_id", "chain", "line_id").agg(*(F.sum(F.when(F.col("at_start") == start, F.col("half")).otherwise(0.0)).alias(name) for start, name in ((True, "start_m"), (False, "end_m"))))
    # The last half of the one chain and the first half of the other, each as the line runs.
    of = lambda side: sized.select(F.col("seg_id").alias(f"{side}_seg"), F.col("chain").alias(f"{side}_chain"), F.col("coords").alias(f"{side}_coords"))
    placed = kept.withColumns({f"{s}_{n}": F.col(s)[c] for s in "ab" for n, c in (("seg", "seg_id"), ("chain", "chain"))}).join(of("a"), ["a_seg", "a_chain"]).join(of("b"), ["b_seg", "b_chain"])
    bundles = slots.groupBy(F.col("seg_id").alias("a_seg")).agg(F.countDistinct("line_id").cast("int").alias("bundle"))
    leaving = lambda side: F.when(F.col(side)["at_start"], F.col(f"{side}_coords")).otherwise(F.reverse(f"{side}_coords"))
    placed = placed.join(bundles, "a_seg").withColumns({"back": leaving("a"), "on": leaving("b")})
    placed = placed.withColumns({"back": stretch(F.col("back"), along(F.col("back")), F.lit(0.0), F.col("length") / 2), "on": stretch(F.col("on"), along(F.col("on")), F.lit(0.0), F.col("length") / 2)})
    path = F.concat(F.reverse("back"), F.slice("on", 2, F.size("on")))
    ramp = placed.withColumns({"path": path, "n": step_count(F.col("delta"))}).withColumn("at", along(F.col("path"))).withColumn("slots", step_slots(F.col("up"), F.col("down"), F.col("n")))
    steps = ramp.select("line_id", "a_seg", "b_seg", "node", "bundle", "length", "path", "at", "n", "up", "down", F.posexplode("slots").alias("step", "slot"))
    part = F.element_at("at", -1) / F.col("n")
    last = F.when(F.col("step") + 1 == F.col("n"), F.element_at("at", -1)).otherwise(part * (F.col("step") + 1))
    steps = settled(steps.select("line_id", F.col("a_seg").alias("seg_a"), F.col("b_seg").alias("seg_b"), "node", "step", "slot", "bundle", taper_minzoom(F.col("length")).alias("min_zoom"), stretch(F.col("path"), F.col("at"), part * F.col("step"), last).alias("coords"), on_occupied_slot(F.col("slot"), F.col("up"), F.col("down")).alias("_occupied")))
    counts = rows.agg(F.count_if(F.col("kind") == "taper").alias("found"), F.count_if(F.col("kind") == "ambiguous").alias("ambiguous"), F.count_if(F.col("kind") == "short").alias("short"), F.count_if((F.col("kind") == "taper") & (F.col("length") < F.col("want"))).alias("shortened"))
    more = collided.agg(F.count("*").alias("collided")).join(steps.agg(F.count_if("_occupied").alias("occupied")))
    diagnostics = counts.join(more).select((F.col("found") - F.col("collided")).alias("tapered"), "ambiguous", "short", "collided", "shortened", "occupied")
    return Tapers(steps.drop("_occupied"), trims, diagnostics)


def route_layer(chains: DataFrame, slots: DataFrame, lines: DataFrame, tapers: Tapers, coach: DataFrame | None = None) -> DataFrame:
    """line_id, part (route, taper or coach), slot, bundle, min_zoom and coords of all that is drawn of lines.

    Lines on their corridors, cut back where a taper takes over; the steps of the tapers; and, where given, coaches
    (line_id, coords), which run alone on place 0.
    """
    from trackweave.operators.network import route_features

    bundles = slots.groupBy("seg_id").agg(F.countDistinct("line_id").cast("int").alias("bundle"))
    routes = route_features(chains, slots, tapers.trims).join(bundles, "seg_id").join(lines.select("line_id"), "line_id", "left_semi")
    none = F.lit(None).cast("int")
    out = routes.select("line_id", F.lit("route").alias("part"), "slot", "bundle", none.alias("min_zoom"), "coords")
    out = out.unionByName(tapers.steps.select("line_id", F.lit("taper").alias("part"), "slot", "bundle", "min_zoom", "coords"))
    if coach is not None:
        out = out.unionByName(coach.select("line_id", F.lit("coach").alias("part"), F.lit(0.0).alias("slot"), F.lit(1).alias("bundle"), none.alias("min_zoom"), "coords"))
    return out
