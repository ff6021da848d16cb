"""Punctuality of lines from departures: attribution, delay counters, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import half_up
from trackweave.functions.text import name_forms, names_contain, names_match, normalise_name, normalise_ref, row_ref
from trackweave.operators.graph import settled

# Kinds of train that are matched by ride instead of by reference.
LONG_DISTANCE = ("ICE", "IC", "EC", "ECE", "EN", "RJ", "RJX", "NJ", "FLX", "TGV", "IR", "D")
SCORED_MODES = ("regional", "suburban")
# First minute of each delay bucket; the last is open.
EDGES = (*range(21), 21, 31, 46, 61, 91)
LONGEST_DELAY, ON_TIME = 24 * 60, 6
LINE_FLOOR, STATION_FLOOR, STATION_SHARE, RIDE_STATIONS = 200, 100, 0.1, 2


def delay_minutes(planned: Column, changed: Column) -> Column:
    """Null without a planned time or beyond a day; 0 without a change; early is 0."""
    minutes = (F.unix_micros(changed.cast("timestamp")) - F.unix_micros(planned.cast("timestamp"))) / 60e6
    known = F.when(F.abs(minutes) > LONGEST_DELAY, F.lit(None)).otherwise(F.greatest(F.lit(0.0), minutes))
    return F.when(planned.isNull(), F.lit(None)).when(changed.isNull(), F.lit(0.0)).otherwise(known)


def bucket(delay: Column) -> Column:
    whole = F.floor(F.greatest(F.lit(0.0), delay)).cast("int")
    out = F.when(whole <= 20, whole)
    for i, edge in enumerate(EDGES[22:], 21):
        out = out.when(whole < edge, i)
    return out.otherwise(len(EDGES) - 1)


def with_delay(departures: DataFrame) -> DataFrame:
    return departures.withColumn("delay", delay_minutes(F.col("planned"), F.col("changed")))


#: What a departure says of its line and place.
TOLD = ("line_number", "train_type", "station")


def worked_once(rows: DataFrame, keys: tuple[str, ...], **columns: Column) -> DataFrame:
    """Distinct keys with columns made from them (as key `_k` for k), once for each and not for each row.

    They are made from aggregates, so that a filter on them isn't pushed down to the rows.
    """
    distinct = rows.groupBy(*keys).agg(*(F.any_value(k).alias(f"_{k}") for k in keys))
    return distinct.withColumns(columns).drop(*(f"_{k}" for k in keys))


def told_refs(departures: DataFrame) -> DataFrame:
    """The distinct combinations of TOLD with the reference that they claim, as a table: few, however many departures there are."""
    return settled(worked_once(departures, TOLD, ref=row_ref(F.col("_line_number"), F.col("_train_type"))))


def with_told(departures: DataFrame, told: DataFrame, *columns: str) -> DataFrame:
    """Departures with columns of told, joined by what they say; nulls are equal."""
    other = told.select(*(F.col(c).alias(f"_{c}") for c in TOLD), *columns)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TOLD]
    return departures.join(other, on).drop(*(f"_{c}" for c in TOLD))


def latest_months(departures: DataFrame, n: int = 12) -> DataFrame:
    """The rows of the last n months that there are."""
    months = departures.select("month").distinct().orderBy(F.desc("month")).limit(n)
    return departures.join(F.broadcast(months), "month", "left_semi")


def by_product(departures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long-distance rows and all others."""
    long = F.coalesce(F.col("train_type").isin(*LONG_DISTANCE), F.lit(False))
    return departures.where(long), departures.where(~long)


def ref_station_matches(pairs: DataFrame, lines: DataFrame, line_stations: DataFrame, fuzzy: str | None = None) -> DataFrame:
    """ref, station, outcome (matched, ambiguous, missed) and line_id of distinct pairs.

    The line of that reference which serves a station of exactly that name, if it is the
    only one; if there is none, the only one with a matching name. fuzzy: None (exact names
    only), "contain" or "full". Each pair is resolved once, however many departures name it, and each two names are compared once.
    """
    pairs = settled(pairs.select("ref", "station").where("ref <> ''").distinct())
    served = lines.where(F.col("mode").isin(*SCORED_MODES)).select("line_id", normalise_ref(F.col("ref")).alias("ref")).where("ref <> ''").join(line_stations.select("line_id", F.col("station").alias("stop")), "line_id").distinct()
    # Small tables, each read several times below; written, the plan of every use is a scan.
    served = settled(served)
    own, theirs = settled(worked_once(pairs, ("station",), own=name_forms(F.col("_station")))), settled(worked_once(served, ("stop",), their=name_forms(F.col("_stop"))))
    equal = own.withColumn("name", F.col("own.bare")).where("name <> ''").join(theirs.withColumn("name", F.col("their.bare")), "name").select("station", "stop")
    line_of = lambda rows, alike: rows.join(alike, "station").join(served, ["ref", "stop"]).groupBy("ref", "station").agg(F.countDistinct("line_id").alias("n"), F.min("line_id").alias("line_id"))
    found = line_of(pairs, equal)
    if fuzzy:
        rest = pairs.join(found, ["ref", "station"], "left_anti")
        same = names_contain if fuzzy == "contain" else names_match
        # Names that meet under one reference, each two compared once.
        met = rest.join(served.select("ref", "stop").distinct(), "ref").select("station", "stop").distinct()
        alike = met.join(own, "station").join(theirs, "stop").where(same(F.col("their"), F.col("own"))).select("station", "stop")
        found = found.unionByName(line_of(rest, alike))
    outcome = F.when(F.col("n").isNull(), "missed").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return pairs.join(found, ["ref", "station"], "left").select("ref", "station", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("line_id")).alias("line_id"))


def ride_matches(rides: DataFrame, line_stations: DataFrame) -> DataFrame:
    """month, ride, outcome (matched, ambiguous, missed, too small) and line_id: the one line that serves every station of the ride."""
    name = normalise_name(F.col("_station"))
    stations = rides.select("month", "ride", "station").distinct().join(worked_once(rides, ("station",), name=name), "station").where("name <> ''").select("month", "ride", "name").distinct()
    served = line_stations.join(worked_once(line_stations, ("station",), name=name), "station").select("line_id", "name").distinct()
    sizes = stations.groupBy("month", "ride").agg(F.count("*").alias("size"))
    common = stations.join(served, "name").groupBy("month", "ride", "line_id").agg(F.count("*").alias("n"))
    whole = common.join(sizes, ["month", "ride"]).where("n = size").groupBy("month", "ride").agg(F.count("*").alias("lines"), F.min("line_id").alias("line_id"))
    outcome = F.when(F.col("size") < RIDE_STATIONS, "too small").when(F.col("lines").isNull(), "missed").when(F.col("lines") > 1, "ambiguous").otherwise("matched")
    all_ = sizes.join(whole, ["month", "ride"], "left").withColumn("outcome", outcome)
    return all_.select("month", "ride", "outcome", F.when(F.col("outcome") == "matched", F.col("line_id")).alias("line_id"))


def attributed(departures: DataFrame, lines: DataFrame, line_stations: DataFrame, long_stations: DataFrame | None = None, fuzzy: str | None = "full") -> DataFrame:
    """line_id, station, delay, cancelled of the departures whose line is known."""
    long, local = by_product(with_delay(departures).where("delay is not null"))
    told = told_refs(local)
    matches = ref_station_matches(told, lines, line_stations, fuzzy).where("outcome = 'matched'")
    named = settled(told.join(matches.select("ref", "station", "line_id"), ["ref", "station"]))
    out = with_told(local, named, "line_id").select(F.col("line_id").cast("string").alias("line_id"), "station", "delay", "cancelled")
    if long_stations is not None:
        rides = ride_matches(by_product(departures)[0], long_stations).where("outcome = 'matched'").select("month", "ride", "line_id")
        far = long.join(rides, ["month", "ride"])
        out = out.unionByName(far.select(F.concat(F.lit("ld"), F.col("line_id").cast("string")).alias("line_id"), "station", "delay", "cancelled"))
    return out


def delay_counters(rows: DataFrame, *keys: str) -> DataFrame:
    """n, cancelled and hist (departures that ran, by bucket) for each key: one pass, additive."""
    at = F.when(~F.col("cancelled"), bucket(F.col("delay")))
    counts = [F.count_if(F.col("_b") == i) for i in range(len(EDGES))]
    return rows.withColumn("_b", at).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("cancelled").alias("cancelled"), F.array(*counts).alias("hist"))


def summed(counters: DataFrame, *keys: str) -> DataFrame:
    """Counters of coarser keys: sums of finer ones, so that departures are read once for both."""
    hist = F.array(*[F.sum(F.col("hist")[i]) for i in range(len(EDGES))])
    return counters.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cancelled").alias("cancelled"), hist.alias("hist"))


def hist_quantile(hist: Column, p: float) -> Column:
    """Minutes at share p: the first bucket that reaches it, straight inside wide ones, halves up; the open bucket gives its floor."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    target = total * p
    edges = F.array(*[F.lit(e) for e in EDGES])
    start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("out"))

    def step(s: Column, x: Column) -> Column:
        low = F.get(edges, s["i"]).cast("double")
        high = F.coalesce(F.get(edges, s["i"] + 1) - 1, F.get(edges, s["i"])).cast("double")
        inside = F.when(high <= low, low).otherwise(half_up(low + (target - s["cum"]) / x * (high - low)))
        out = F.when(s["out"].isNotNull(), s["out"]).when((s["cum"] + x >= target) & (x > 0), inside).when(s["cum"] + x >= target, low)
        return F.struct((s["cum"] + x).alias("cum"), (s["i"] + 1).alias("i"), out.cast("double").alias("out"))

    return F.when(total == 0, 0.0).otherwise(F.aggregate(hist, start, step, lambda s: F.coalesce(s["out"], F.lit(float(EDGES[-1])))))


def on_time_share(hist: Column, ran: Column) -> Column:
    return half_up(F.aggregate(F.slice(hist, 1, ON_TIME), F.lit(0).cast("long"), lambda a, x: a + x) / ran, 3)


def scored(counters: DataFrame) -> DataFrame:
    ran = F.col("n") - F.col("cancelled")
    return counters.withColumns({"on_time": on_time_share(F.col("hist"), ran), "median": hist_quantile(F.col("hist"), 0.5), "p90": hist_quantile(F.col("hist"), 0.9)})


def reportable(counters: DataFrame) -> DataFrame:
    """Something ran, and not all of it exactly on time, which is how a line without live data looks."""
    ran = F.col("n") - F.col("cancelled")
    return counters.where((ran > 0) & (F.col("hist")[0] < ran))


def line_scores(rows: DataFrame) -> DataFrame:
    return scored_lines(delay_counters(rows, "line_id", "station"))


def scored_lines(counters: DataFrame) -> DataFrame:
    """Scores of lines from counters by line and station."""
    lines = reportable(summed(counters, "line_id").where(F.col("n") >= LINE_FLOOR))
    return scored(lines).withColumn("cancel_rate", half_up(F.col("cancelled") / F.col("n"), 4)).select("line_id", "on_time", "median", "p90", "n", "cancelled", "cancel_rate", "hist")


def station_scores(rows: DataFrame, least: float = STATION_FLOOR) -> DataFrame:
    """Of reported lines, stations seen as often as the floor: a tenth of the upper median of the line's stations, `least` departures at least."""
    counters = delay_counters(rows, "line_id", "station")
    lines = scored_lines(counters).select("line_id")
    stations = reportable(counters).join(lines, "line_id", "left_semi")
    ordered = F.array_sort(F.collect_list("n"))
    floors = stations.groupBy("line_id").agg(F.greatest(F.lit(float(least)), F.get(ordered, F.floor(F.count("*") / 2).cast("int")) * STATION_SHARE).alias("floor"))
    kept = stations.join(floors, "line_id").where("n >= floor")
    return scored(kept).select("line_id", "station", "on_time", "median", "p90", "n")


def share_bands(scores: DataFrame) -> DataFrame:
    """line_id, band and share of all scheduled departures; bands without any are left out."""
    total = lambda a, b: F.aggregate(F.slice(F.col("hist"), a + 1, b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    bands = F.array(*[F.struct(F.lit(name).alias("band"), count.cast("long").alias("count")) for name, count in (("punctual", total(0, 1)), ("slight", total(1, ON_TIME)), ("late", total(ON_TIME, 16)), ("severe", total(16, len(EDGES))), ("cancelled", half_up(F.col("cancel_rate") * F.col("n"))))])
    return scores.select("line_id", "n", F.explode(bands).alias("b")).select("line_id", "b.band", (F.col("b.count") / F.col("n")).alias("share")).where("share > 0")


def worst_first(stations: DataFrame) -> DataFrame:
    order = W.partitionBy("line_id").orderBy("on_time", F.desc("n"), "station")
    return stations.withColumn("place", F.row_number().over(order))


def match_stats(departures: DataFrame, lines: DataFrame, line_stations: DataFrame, long_stations: DataFrame, fuzzy: str | None = "full") -> DataFrame:
    """kind, outcome and count: of departures and pairs by reference, of rides by containment."""
    long, local = by_product(with_delay(departures))
    counted = settled(local.where("delay is not null").groupBy(*TOLD).agg(F.count("*").alias("departures")))
    told = settled(with_told(counted, told_refs(counted), "ref"))
    matches = settled(ref_station_matches(told, lines, line_stations, fuzzy))
    rows = told.where("ref <> ''").join(matches, ["ref", "station"], "left").groupBy(F.coalesce("outcome", F.lit("missed")).alias("outcome")).agg(F.sum("departures").alias("n")).select(F.lit("departures").alias("kind"), "outcome", "n")
    pairs = matches.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit("pairs").alias("kind"), "outcome", "n")
    rides = ride_matches(long, long_stations).groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit("rides").alias("kind"), "outcome", "n")
    return rows.unionByName(pairs).unionByName(rides)
