"""Track closures: readings of the plan, validity windows, the event log and its replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackweave.functions.geo import mercator_to_degrees
from trackweave.functions.style import EFFECT_RANK, lookup
from trackweave.operators.order import numbered

# Effects, directions and kinds of work as the register spells them, and what they are called here.
EFFECTS = {
    "TOTALSPERRUNG": "closed",
    "GGL_MIT_ZS_6": "single-track",
    "GGL_MIT_ZS_8": "single-track",
    "ABWEICHUNG_VOM_FPL": "diverted",
    "FAHRZEITVERLAENGERUNG": "slower",
    "SONSTIGES": "other",
}
DIRECTIONS = {"BEIDE": "both", "MIT_KILOMETRIERUNG": "with-km", "GEGEN_KILOMETRIERUNG": "against-km"}
WEEKDAYS = ("MO", "DI", "MI", "DO", "FR", "SA", "SO")
BAND_DAYS = {"days": 3, "weeks": 31}
MOST_MOVES = 6
TRACKED = ("begin_day", "end_day", "effect")


def normalise(raw: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """Readings in the library's terms; an unknown effect is other, an unknown direction both, unknown works stay as they are.

    works: a small table (arbeiten, works) of translations.
    """

    def end(name: str, code: str, point: str) -> Column:
        lon, lat = mercator_to_degrees(F.col(point)["x"], F.col(point)["y"])
        return F.struct(F.trim(name).alias("name"), F.trim(code).alias("code"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))

    rows = raw.withColumn("works", F.col("arbeiten")) if works is None else raw.join(F.broadcast(works), "arbeiten", "left").withColumn("works", F.coalesce("works", "arbeiten"))
    return rows.select(
        F.col("id"),
        lookup(F.col("wirkung"), EFFECTS, F.lit("other")).alias("effect"),
        lookup(F.col("richtung"), DIRECTIONS, F.lit("both")).alias("direction"),
        "works",
        F.array_sort(F.array_distinct(F.coalesce("routes", F.array().cast("array<int>")))).alias("routes"),
        end("name_from", "code_from", "point_from").alias("from"),
        end("name_to", "code_to", "point_to").alias("to"),
        "begin",
        "end",
    )


def weekday_bit(day: Column) -> Column:
    """Monday is 1, Sunday 64."""
    return F.pow(F.lit(2), F.weekday(day)).cast("int")


def weekday_mask(days: Column) -> Column:
    """Bits of an array of weekday names; unknown names are passed over."""
    bits = [F.when(F.array_contains(days, name), 1 << i).otherwise(0) for i, name in enumerate(WEEKDAYS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.coalesce(out, F.lit(0))


def span_days(begin: Column, end: Column) -> Column:
    """Days from begin to end, both counted; 0 if one isn't a date."""
    return F.coalesce(F.datediff(end, begin) + 1, F.lit(0))


def band(days: Column) -> Column:
    return F.when(days <= BAND_DAYS["days"], "days").when(days <= BAND_DAYS["weeks"], "weeks").otherwise("months")


def windows_on(windows: Column, day: Column) -> Column:
    """Of an array of windows (from, to, days, from_time, to_time) those in force on a day."""
    return F.filter(windows, lambda w: (w["from"] <= day) & (w["to"] >= day) & (w["days"].bitwiseAND(weekday_bit(day)) != 0))


def hours_text(windows: Column) -> Column:
    """Distinct clock spans of the windows; a whole day has none."""
    spans = F.transform(windows, lambda w: F.concat(F.substring(w["from_time"], 1, 5), F.lit("–"), F.substring(w["to_time"], 1, 5)))
    return F.array_join(F.array_distinct(F.filter(spans, lambda s: s != "00:00–00:00")), ", ")


def compact_days(windows: DataFrame, key: str = "id") -> DataFrame:
    """Islands of consecutive single days with equal hours, with the mask of their weekdays."""
    order = W.partitionBy(key, "from_time", "to_time").orderBy("day")
    starts = F.when(F.date_add(F.lag("day").over(order), 1) == F.col("day"), 0).otherwise(1)
    marked = windows.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(order))
    return marked.groupBy(key, "from_time", "to_time", "_island").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.bit_or(weekday_bit(F.col("day"))).alias("days")).drop("_island")


def compact_windows(windows: Column) -> Column:
    """The same for an array of windows of which some state a range: those merge with equal masks only. A fold over the sorted array."""
    made = F.transform(
        windows,
        lambda w: F.struct(w["from"].alias("from"), w["from_time"].alias("from_time"), w["to"].alias("to"), F.when(w["from"] == w["to"], weekday_bit(w["from"])).otherwise(w["days"]).alias("days"), w["to_time"].alias("to_time"), (w["from"] == w["to"]).alias("single")),
    )

    def add(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        near = (last["from_time"] == w["from_time"]) & (last["to_time"] == w["to_time"]) & (F.date_add(last["to"], 1) == w["from"]) & ((last["single"] & w["single"]) | (last["days"] == w["days"]))
        joined = F.struct(last["from"].alias("from"), last["from_time"].alias("from_time"), w["to"].alias("to"), last["days"].bitwiseOR(w["days"]).alias("days"), last["to_time"].alias("to_time"), (last["single"] & w["single"]).alias("single"))
        return F.when((F.size(done) > 0) & near, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(w)))

    kind = "array<struct<from:date,from_time:string,to:date,days:int,to_time:string,single:boolean>>"
    return F.transform(F.aggregate(F.array_sort(made).cast(kind), F.array().cast(kind), add), lambda w: w.dropFields("single"))


def overlaps(begin: Column, end: Column, first: Column, last: Column) -> Column:
    return (begin <= last) & (end >= first)


def replay(events: DataFrame) -> DataFrame:
    """The state of each id after its log: since, first_end, end_day, revisions, moves, withdrawn.

    Events before the last `planned` of an id don't count, revisions without one are passed
    over; a revision takes a withdrawal back. Order is that of seq.
    """
    per_id = W.partitionBy("id")
    start = F.max(F.when(F.col("e") == "planned", F.col("seq"))).over(per_id)
    live = events.withColumn("_start", start).where("_start is not null and seq >= _start")
    running = per_id.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.last("end_day", ignorenulls=True).over(running)
    live = live.withColumn("_was", before)
    moved = (F.col("e") == "revised") & F.col("end_day").isNotNull() & (F.col("_was") != F.col("end_day"))
    move = F.when(moved, F.struct("seq", F.col("t").alias("logged"), F.col("_was").alias("was"), F.col("end_day").alias("now")))
    return live.groupBy("id").agg(
        F.min_by("t", "seq").alias("since"),
        F.min_by("end_day", "seq").alias("first_end"),
        F.max_by("end_day", F.when(F.col("end_day").isNotNull(), F.col("seq"))).alias("end_day"),
        F.count_if(F.col("e") == "revised").alias("revisions"),
        F.array_sort(F.collect_list(move)).alias("moves"),
        (F.max_by("e", "seq") == "withdrawn").alias("withdrawn"),
    )


def pack_moves(moves: Column) -> Column:
    """The last six moves of an end date, oldest first: logged:was>now."""
    last = F.slice(moves, F.greatest(F.size(moves) - MOST_MOVES + 1, F.lit(1)), MOST_MOVES)
    return F.array_join(F.transform(last, lambda m: F.concat(m["logged"].cast("string"), F.lit(":"), m["was"].cast("string"), F.lit(">"), m["now"].cast("string"))), ";")


def unpack_moves(packed: Column) -> Column:
    """The inverse; entries of another form are dropped."""
    day = r"\d{4}-\d{2}-\d{2}"
    form = f"^({day}):({day})>({day})$"
    entries = F.filter(F.split(packed, ";"), lambda x: x.rlike(form))
    part = lambda x, i: F.to_date(F.regexp_extract(x, form, i))
    return F.transform(entries, lambda x: F.struct(part(x, 1).alias("logged"), part(x, 2).alias("was"), part(x, 3).alias("now")))


def plan_diff(state: DataFrame, fresh: DataFrame, first: Column, last: Column, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """id, e, and per tracked field was_ and now_: the events that turn the known state into a fresh reading.

    planned: not known. revised: a tracked field differs (only those are filled), or a withdrawn
    one has come back (none filled). withdrawn: known, not in the reading though its
    envelope overlaps the queried days, and not withdrawn already.
    state: id, tracked fields, withdrawn.
    """
    a, b = state.select("id", F.lit(True).alias("_a"), "withdrawn", *(F.col(c).alias(f"a_{c}") for c in tracked)), fresh.select("id", F.lit(True).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in tracked))
    both = a.join(b, "id", "full")
    changed = [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in tracked]
    some = changed[0]
    for c in changed[1:]:
        some = some | c
    known, read = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    gone = known & ~read & ~F.col("withdrawn") & overlaps(F.col("a_begin_day"), F.col("a_end_day"), first, last)
    event = F.when(read & ~known, "planned").when(read & (some | F.col("withdrawn")), "revised").when(gone, "withdrawn")
    out = both.withColumn("e", event).where("e is not null")
    fields = []
    for c, differs in zip(tracked, changed, strict=True):
        fields += [F.when((F.col("e") == "revised") & differs, F.col(f"a_{c}")).alias(f"was_{c}"), F.when((F.col("e") == "planned") | ((F.col("e") == "revised") & differs), F.col(f"b_{c}")).alias(f"now_{c}")]
    return out.select("id", "e", *fields)


def advanced(state: DataFrame, events: DataFrame, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """The state after the events of plan_diff: what was planned is new, what was revised has its changed fields and is no longer withdrawn."""
    told = events.select("id", "e", *(F.col(f"{w}_{c}") for c in tracked for w in ("was", "now")))
    both = state.select("id", "withdrawn", *tracked).join(told, "id", "full")
    moved = lambda c: (F.col("e") == "planned") | ((F.col("e") == "revised") & (F.col(f"was_{c}").isNotNull() | F.col(f"now_{c}").isNotNull()))
    fields = (F.when(F.coalesce(moved(c), F.lit(False)), F.col(f"now_{c}")).otherwise(F.col(c)).alias(c) for c in tracked)
    return both.select("id", *fields, F.when(F.col("e").isNull(), F.col("withdrawn")).otherwise(F.col("e") == "withdrawn").alias("withdrawn"))


#: No two dates are further apart than 2 to this power in days.
MOST_LEVEL = 32
#: At most so many rows of the larger table with the same interval, and so many of the smaller one that begin near each other, meet as one.
MOST_ALIKE, MOST_NEAR = 1024, 64


def interval_pairs(left: DataFrame, right: DataFrame, left_days: tuple[str, str], right_days: tuple[str, str], on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of two tables of intervals of days (first and last included) that overlap, each pair once. on: columns that must agree.

    A row of the larger table stands once, in the bin of its begin; bins have the size of its length's power of two, a
    least size apart. A row of the smaller table goes to all bins, of each size that occurs, from which rows can reach
    it. The least size is the smallest that gives it no more copies in all than the larger table has rows (or a few for
    each of its own), so that what is shuffled is in proportion to both tables. Intervals without a begin or end, or
    that end before they begin, meet none.

    Within a bin, rows of the larger table with the same interval are one row, and those of the smaller one that begin
    near each other are compared once with all of them. The pairs of both then follow each other row by row, so that a
    file holds them in a fraction of a byte each.
    """

    bins = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level))

    def levelled(df: DataFrame, days: tuple[str, str], first: str, last: str, level: str) -> DataFrame:
        rows = df.withColumns({name: F.unix_date(F.col(day)).cast("long") for name, day in zip((first, last), days, strict=True)}).where(F.col(first) <= F.col(last))
        return rows.withColumn(level, F.ceil(F.log2((F.col(last) - F.col(first) + 1).cast("double"))).cast("int"))

    def sizes(df: DataFrame, days: tuple[str, str]) -> tuple[int, list[int], list[float]]:
        """How many rows, which levels occur, and into how many bins of each level the rows would go."""
        rows = levelled(df, days, "_first", "_last", "_level")
        span = F.col("_last") - F.col("_first")
        told = rows.agg(F.count("*").alias("n"), F.collect_set("_level").alias("levels"), *(F.coalesce(F.sum(F.floor(span / (1 << k)) + 3), F.lit(0)).alias(f"b{k}") for k in range(MOST_LEVEL + 1))).first()
        return told["n"], sorted(told["levels"]), [told[f"b{k}"] for k in range(MOST_LEVEL + 1)]

    (n_left, levels_left, bins_left), (n_right, levels_right, bins_right) = sizes(left, left_days), sizes(right, right_days)
    swap = n_left < n_right
    many, few = ((right, right_days), (left, left_days)) if swap else ((left, left_days), (right, right_days))
    levels, spread = (levels_right, bins_left) if swap else (levels_left, bins_right)
    least, most = 0, max(n_left, n_right, 6 * min(n_left, n_right))
    while least < MOST_LEVEL and sum(spread[k] for k in {max(x, least) for x in levels}) > most:
        least += 1
    homes = sorted({max(x, least) for x in levels})

    a = levelled(*many, "_first", "_last", "_level").withColumn("_at", F.greatest("_level", F.lit(least)))
    a = a.withColumn("_bin", F.floor(F.col("_first") / bins("_at")))
    b = levelled(*few, "_from", "_to", "_other").withColumn("_at", F.explode(F.array(*map(F.lit, homes)).cast("array<int>")))
    b = b.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_from") - bins("_at") + 1) / bins("_at")), F.floor(F.col("_to") / bins("_at")))))
    key = ["_at", "_bin", *on]

    def packed(df: DataFrame, name: str) -> list[tuple[str, str]]:
        """The columns to hand on and what they are called meanwhile."""
        return [(c, f"{name}{i}") for i, c in enumerate(c for c in df.columns if c not in on)]

    def runs(rows: DataFrame, order: list[str], most: int) -> DataFrame:
        return rows.withColumn("_run", F.floor((F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1) / most))

    names = [packed(left, "_l"), packed(right, "_r")]
    ours, theirs = (names[1], names[0]) if swap else (names[0], names[1])
    row = lambda columns, *more: F.collect_list(F.struct(*more, *(F.col(c).alias(x) for c, x in columns)))
    a = runs(a, ["_first", "_last"], MOST_ALIKE).groupBy(*key, "_first", "_last", "_run").agg(row(ours).alias("_ours")).drop("_run")
    b = runs(b, ["_other", "_from", "_to"], MOST_NEAR).groupBy(*key, "_run").agg(row(theirs, "_from", "_to").alias("_theirs"), F.min("_from").alias("_from"), F.max("_to").alias("_to")).drop("_run")
    met = a.join(b, key).where("_first <= _to and _from <= _last")
    met = met.select(*on, "_ours", F.filter("_theirs", lambda r: (F.col("_first") <= r["_to"]) & (r["_from"] <= F.col("_last"))).alias("_theirs"))
    pairs = met.select(*on, "_theirs", F.inline("_ours")).select(*on, *(x for _, x in ours), F.inline("_theirs"))
    return pairs.select(*on, *(F.col(x).alias(c) for columns in names for c, x in columns))


def progress(begin: Column, end: Column, first_end: Column, day: Column) -> list[Column]:
    """total, gone, left_over and through (share, 0 to 1) of a closure on a day, and where in it the end first planned lies."""
    total = span_days(begin, end)
    gone = F.greatest(F.lit(0), F.least(total, F.datediff(day, begin) + 1))
    first = F.when((first_end < end) & (total > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), span_days(begin, first_end) / total)))
    return [total.alias("total"), gone.alias("gone"), (total - gone).alias("left_over"), F.when(total > 0, gone / total).otherwise(0.0).alias("through"), first.alias("first_end_at")]


def with_history(closures: DataFrame, state: DataFrame) -> DataFrame:
    """Closures with since, first_end, revisions and packed moves of their log, if they have one."""
    history = state.select("id", "since", "first_end", "revisions", pack_moves(F.col("moves")).alias("moves"))
    joined = closures.join(history, "id", "left")
    return joined.withColumns({"revisions": F.coalesce("revisions", F.lit(0)), "moves": F.coalesce("moves", F.lit(""))})


def validated(records: DataFrame) -> DataFrame:
    """Stored records with defaults for what is missing or unknown; days and band are computed again where they are absent. Dates are text."""
    text = [c for c, kind in records.dtypes if kind == "string"]
    rows = records.withColumns({c: F.coalesce(c, F.lit("")) for c in text})
    span = span_days(F.substring("begin", 1, 10).try_cast("date"), F.substring("end", 1, 10).try_cast("date")) if "begin" in text else F.lit(0)
    known = lambda c, values, default: F.when(F.col(c).isin(*values), F.col(c)).otherwise(default)
    return rows.withColumns({"effect": known("effect", EFFECT_RANK, "other"), "direction": known("direction", DIRECTIONS.values(), "both"), "days": F.coalesce("days", span), "band": known("band", ("days", "weeks", "months"), band(span)), "extended": F.coalesce("extended", F.lit(0))})


def local_day(moment: Column, zone: str = "Europe/Berlin", offset: int = 0) -> Column:
    """The date at a moment in the zone that the register writes its times in, some days on."""
    return F.date_add(F.to_date(F.from_utc_timestamp(moment, zone)), offset)


def effect_rank(effect: Column) -> Column:
    return lookup(effect, EFFECT_RANK)


def drawing_order(closures: DataFrame) -> DataFrame:
    """draw_order from 1: the least severe first, so that the worst are drawn on top."""
    return numbered(closures, [effect_rank(F.col("effect")), "id"], "draw_order")
