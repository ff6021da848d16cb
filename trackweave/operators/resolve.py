"""Resolution of stations to stop ids and of operators to marks, with their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import metres
from trackweave.functions.text import name_forms, names_contain, names_equal, names_match, normalise_name, same_stop_name
from trackweave.operators.graph import components, settled
from trackweave.operators.order import numbered
from trackweave.operators.spatial import near_pairs

MOST_METRES, DUPLICATE_METRES, MARGIN_METRES = 500.0, 20.0, 150.0
# Modes of a candidate that serve a station's mode.
COMPATIBLE = {"rail": ("HIGHSPEED_RAIL", "LONG_DISTANCE", "REGIONAL_RAIL", "SUBURBAN", "METRO", "SUBWAY"), "tram": ("TRAM",)}
# Licences and types of files that can be used, and the most bytes.
FREE_LICENCE = r"^(public domain|cc0)"
FILE_TYPES = ("image/svg+xml", "image/png", "image/jpeg", "image/webp", "image/gif")
MOST_BYTES = 250_000
BACKLOG_SHARE = 100


def compatible(mode: Column, modes: Column) -> Column:
    out = F.lit(False)
    for own, theirs in COMPATIBLE.items():
        out = out | ((mode == own) & F.arrays_overlap(modes, F.array(*map(F.lit, theirs))))
    return F.coalesce(out, F.lit(False))


def valid_candidates(stations: DataFrame, candidates: DataFrame, fuzzy: str = "full", radius: float = MOST_METRES) -> DataFrame:
    """Pairs of a station and a candidate that may be its stop: a stop that is served, near enough, with a matching name.

    stations: station_id, lon, lat, name, mode. candidates: id, type, lon, lat, name, modes (null: unknown; empty: unserved).
    """
    same = names_match if fuzzy == "full" else names_contain
    served = candidates.where("type = 'STOP' and (modes is null or size(modes) > 0)").select("id", "lon", "lat", F.col("name").alias("stop_name"), name_forms(F.col("name")).alias("stop_forms"), F.coalesce("modes", F.array().cast("array<string>")).alias("modes"))
    own = stations.select("station_id", "lon", "lat", "mode", name_forms(F.col("name")).alias("forms"))
    pairs = near_pairs(own, served, radius).where(same(F.col("stop_forms"), F.col("forms")))
    return pairs.withColumns({"exact": names_equal(F.col("stop_forms"), F.col("forms")), "serves": compatible(F.col("mode"), F.col("modes")), "stop": F.col("stop_forms.bare")}).select("station_id", "id", "distance", "exact", "serves", "stop", "r_lon", "r_lat")


def candidate_union(*tables: DataFrame, keys: tuple[str, ...] = ("station_id", "id")) -> DataFrame:
    """Candidates of all tables; of rows with one id (the last of the keys, of one station if that is a key) that of the first table stays, rows without an id stay all."""
    rows = None
    for n, table in enumerate(tables):
        own = table.withColumn("_table", F.lit(n))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (*keys, "_table")]
    first = F.min_by(F.struct(*columns), F.struct("_table", *columns)).alias("s") if columns else F.min("_table").alias("s")
    named = rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(first)
    named = named.select(*keys, *(F.col("s")[c].alias(c) for c in columns))
    return named.unionByName(rows.where(F.col(keys[-1]).isNull()).drop("_table"))


def tiered(valid: DataFrame) -> DataFrame:
    """Of a station with exact names only those."""
    any_exact = F.max("exact").over(W.partitionBy("station_id"))
    return valid.withColumn("_any", any_exact).where("exact or not _any").drop("_any")


def collapsed(valid: DataFrame) -> DataFrame:
    """One representative for each group of a station's candidates that share a name within 20 m, also through others: the smallest id of those that serve the station's mode, else the smallest."""
    # Written, since it is read three times and holds the comparison of all names.
    rows = settled(valid.withColumn("_node", F.concat_ws("\u0000", F.col("station_id").cast("string"), "id")))
    side = lambda s: rows.select("station_id", F.col("_node").alias(s), F.col("stop").alias(f"stop_{s}"), F.col("r_lon").alias(f"lon_{s}"), F.col("r_lat").alias(f"lat_{s}"))
    near = side("a").join(side("b"), "station_id").where("a < b")
    near = near.where(metres(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")) <= DUPLICATE_METRES).where(same_stop_name(F.col("stop_a"), F.col("stop_b")))
    near = settled(near.select("a", "b"))  # only these can belong to others; most stand alone
    groups = components(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), near).withColumnRenamed("node", "_node")
    best = F.min(F.struct(F.when(F.col("serves"), 0).otherwise(1).alias("k"), "id", "distance", "serves")).alias("s")
    grouped = rows.join(groups, "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    return grouped.groupBy("station_id", "component").agg(best).select("station_id", "s.id", "s.distance", "s.serves")


def best_match(valid: DataFrame) -> DataFrame:
    """station_id, state (resolved, ambiguous) and stop_id: the nearest, unless others come within 150 m of it and not exactly one of these serves the station's mode."""
    reps = collapsed(tiered(valid))
    least = F.min("distance").over(W.partitionBy("station_id"))
    tied = reps.withColumn("_least", least).where(F.col("distance") - F.col("_least") < MARGIN_METRES)
    sums = tied.groupBy("station_id").agg(F.count("*").alias("n"), F.count_if("serves").alias("fit"), F.min_by("id", F.struct("distance", "id")).alias("first"), F.min(F.when(F.col("serves"), F.col("id"))).alias("fitting"))
    stop = F.when(F.col("n") == 1, F.col("first")).when(F.col("fit") == 1, F.col("fitting"))
    return sums.select("station_id", F.when(stop.isNotNull(), "resolved").otherwise("ambiguous").alias("state"), stop.alias("stop_id"))


def town_missing(name: Column, town: Column) -> Column:
    """Whether a search with the town before the name asks anything new."""
    bare = normalise_name(town)
    return (bare != "") & ~normalise_name(name).contains(bare)


#: What stops of the national feed have in front of a station's own tag; the form of such a tag.
FEED_PREFIX, STOP_TAG = "de-DELFI_", "^[a-z]{2}:[A-Za-z0-9]+:[A-Za-z0-9]+(:[A-Za-z0-9]+)*$"


def tag_ids(tag: Column) -> Column:
    """The stop ids that a station's own tag may mean: the whole tag, then the stem of its first three parts; none where it hasn't the form."""
    stem = F.array_join(F.slice(F.split(tag, ":"), 1, 3), ":")
    ids = F.transform(F.array_distinct(F.array(tag, stem)), lambda x: F.concat(F.lit(FEED_PREFIX), x))
    return F.when(F.coalesce(tag.rlike(STOP_TAG), F.lit(False)), ids).otherwise(F.array().cast("array<string>"))


def tagged_stops(stations: DataFrame, stops: DataFrame, fuzzy: str = "full") -> DataFrame:
    """station_id, id and modes of the stop that each station's tag names, as cascade takes it: the first of tag_ids that is a stop with a mode the station can be served by, and that passes the checks of any candidate.

    stations: with ifopt. stops: as candidates are.
    """
    asked = stations.select("station_id", "mode", F.posexplode(tag_ids(F.col("ifopt"))).alias("rank", "id"))
    named = asked.join(stops, "id").where(compatible(F.col("mode"), F.col("modes")))
    sound = valid_candidates(stations, named.select(*stops.columns).distinct(), fuzzy).select("station_id", "id")
    rows = named.join(sound, ["station_id", "id"], "left_semi")
    return rows.groupBy("station_id").agg(F.min_by(F.struct("id", "modes"), "rank").alias("s")).select("station_id", "s.*")


def cascade(stations: DataFrame, tagged: DataFrame, stages: list[tuple], fuzzy: str = "full", final: tuple[str, ...] = ("spatial",)) -> DataFrame:
    """station_id, source, state and stop_id through sources in order of trust.

    tagged: station_id, id, modes of stops that the station names itself; taken if they serve its
    mode. Then each stage's candidates (a table for all stations) are matched; an id ends the
    search, so does any verdict of a stage in `final`. Else the last verdict stands. A stage is its
    name, its candidates and, if it is not for all, a condition on stations.
    """
    own = tagged.join(stations.select("station_id", "mode"), "station_id").where(compatible(F.col("mode"), F.col("modes")))
    done = own.groupBy("station_id").agg(F.min("id").alias("stop_id")).select("station_id", F.lit("tag").alias("source"), F.lit("resolved").alias("state"), "stop_id")
    last = None
    for name, candidates, *of in stages:
        open_ = stations.join(done, "station_id", "left_anti")
        open_ = open_.where(of[0]) if of else open_
        verdict = best_match(valid_candidates(open_, candidates, fuzzy)).select("station_id", F.lit(name).alias("source"), "state", "stop_id")
        verdict = settled(verdict)
        closes = verdict if name in final else verdict.where("state = 'resolved'")
        done = done.unionByName(closes)
        last = verdict if last is None else verdict.unionByName(last.join(verdict, "station_id", "left_anti"))
    open_ = stations.select("station_id").join(done, "station_id", "left_anti")
    rest = open_ if last is None else open_.join(last, "station_id", "left")
    return done.unionByName(rest.select("station_id", "source", F.coalesce("state", F.lit("none")).alias("state"), "stop_id"))


def drop_stale(state: DataFrame, version: int) -> DataFrame:
    """Rows of the state table that still hold: ids stay, negatives of an older resolver go."""
    return state.where((F.col("state") == "resolved") | (F.col("resolver_version") >= version))


def work_budget(stations: DataFrame, state: DataFrame, budget: int | None) -> DataFrame:
    """Stations to look up now, with their class and order: those never tried first, then up to 100 of what is left for ambiguous ones; no budget, no bound."""
    joined = stations.select("station_id").join(state.select("station_id", "state"), "station_id", "left")
    klass = F.when(F.col("state").isNull(), "new").when(F.col("state") == "ambiguous", "backlog")
    rows = joined.withColumn("class", klass).where("class is not null").select("station_id", "class")
    new, backlog = (rows.where(F.col("class") == c) for c in ("new", "backlog"))
    if budget is not None:
        left = min(BACKLOG_SHARE, max(0, budget - new.count()))
        new, backlog = new.orderBy("station_id").limit(budget), backlog.orderBy("station_id").limit(left)
    return numbered(new, ["station_id"], "n").unionByName(numbered(backlog, ["station_id"], "n"))


def file_refusal(licence: Column, kind: Column, size: Column) -> Column:
    """Why a mark's file can't be used; null if it can. Markup in the licence is passed over."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(licence, F.lit("")), "<[^>]*>", "")))
    free = plain.rlike(FREE_LICENCE)
    return F.when(~free, "licence").when(~F.coalesce(kind.isin(*FILE_TYPES), F.lit(False)), "type").when(F.coalesce(size, F.lit(MOST_BYTES + 1)) > MOST_BYTES, "size")


def choose_marks(operators: DataFrame, hits: DataFrame, files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """operator_id and file: the first acceptable file by rank of the hit, property, preferred first, listed order. An override decides alone, and `none` refuses.

    hits: operator_id, hit_rank, entity. files: entity, property, preferred, place, file, licence, kind, size.
    """
    rows = hits.join(files.withColumn("reason", file_refusal(F.col("licence"), F.col("kind"), F.col("size"))), "entity").where("reason is null")
    order = W.partitionBy("operator_id").orderBy("hit_rank", "property", F.desc("preferred"), "place", "file")
    found = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("operator_id", "file")
    out = operators.select("operator_id").join(found, "operator_id", "left")
    if overrides is not None:
        out = out.join(F.broadcast(overrides), "operator_id", "left").select("operator_id", F.when(F.col("override").isNull(), F.col("file")).when(F.col("override") != "none", F.col("override")).alias("file"))
    return out.where("file is not null")


def refusals(operators: DataFrame, hits: DataFrame, files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Operators without a mark, and the sorted distinct reasons why their files were refused."""
    missing = operators.select("operator_id").join(chosen, "operator_id", "left_anti")
    reasons = hits.join(files.withColumn("reason", file_refusal(F.col("licence"), F.col("kind"), F.col("size"))), "entity").groupBy("operator_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return missing.join(reasons, "operator_id", "left").select("operator_id", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def shortlist(hits: DataFrame, enough: int = 6, most: int = 8) -> DataFrame:
    """Hits of each operator by name variant, then rank: no further variant once six are there, distinct, eight at most."""
    per = W.partitionBy("operator_id").orderBy("variant")
    sizes = hits.groupBy("operator_id", "variant").agg(F.countDistinct("entity").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(per.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = hits.join(sizes.where(F.col("before") < enough).select("operator_id", "variant"), ["operator_id", "variant"])
    first = kept.groupBy("operator_id", "entity").agg(F.min(F.struct("variant", "rank")).alias("at"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("operator_id").orderBy("at", "entity"))).where(F.col("n") <= most).select("operator_id", "n", "entity")
