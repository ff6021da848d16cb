"""Incremental jobs on Structured Streaming: log replay, plan changes, delay counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackweave.operators import closures, punctuality
from trackweave.operators.graph import settled
from trackweave.sources.sinks import exists

MOVES = "array<struct<seq:bigint,logged:date,was:date,now:date>>"
KEPT = f"seq long, since date, first_end date, end_day date, revisions long, moves {MOVES}, withdrawn boolean"
REPLAYED = f"id long, {KEPT}"
#: The events since the last `planned`, so that one that comes late can be put in its place.
HELD = "seq long, t date, e string, end_day date"


def folder(spark: SparkSession) -> str:
    """A new folder beside the other scratch tables."""
    settled(spark.range(0))  # sets the place where it is unset
    return f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, each, mode: str = "update") -> None:
    """All that is there now, in micro-batches; each(rows, batch id) must give the same when a batch is tried again."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", folder(spark)).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


class Replay(StatefulProcessor):
    """Folds an id's events into its state: before a `planned` nothing counts, which also starts anew; a revision takes a withdrawal back.

    Events count in order of seq, also across micro-batches. What comes in order is folded into the small state at once
    and added to the list of events since the last `planned`, which is not read for that. One that comes late, after its last
    `planned`, is put in its place: only then the list is read and the fold done again; an older one changes nothing.
    Lists live in the state store, an event an entry, and are cut at each new `planned`. `kept_ms`: entries older than
    that (by the time they came) are dropped, so that ids without a new `planned` don't grow; events that come later than that
    are then placed among those that are left.
    """

    def __init__(self, kept_ms: int | None):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", KEPT)
        self.events = handle.getListState("events", HELD, self.kept_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = pd.concat(list(rows))
        new = {int(seq): (int(seq), t, e, None if pd.isna(end) else end) for seq, t, e, end in zip(rows["seq"], rows["t"], rows["e"], rows["end_day"], strict=True)}
        known = tuple(self.now.get()) if self.now.exists() else None
        last = known[0] if known else None
        if known and min(new) > last and not any(x[2] == "planned" for x in new.values()):
            events = [new[s] for s in sorted(new)]
            self.events.appendList(events)
            now = folded(events, (*known[:5], [tuple(m) for m in known[5]], known[6])) if known[1] is not None else (max(new), None, None, None, 0, [], False)
        else:
            held = {x[0]: tuple(x) for x in self.events.get()}
            events = [x for _, x in sorted((held | new).items())]
            starts = [k for k, x in enumerate(events) if x[2] == "planned"]
            if starts:
                events = events[starts[-1] :]
                now = folded(events)
            else:  # a `planned` may yet come before them
                now = (events[-1][0], None, None, None, 0, [], False)
            self.events.put(events)
        self.now.update(now)
        if now[1] is not None:
            yield pd.DataFrame([(key[0], *now)], columns=["id", "seq", "since", "first_end", "end_day", "revisions", "moves", "withdrawn"])

    def close(self) -> None:
        pass


def folded(events: list[tuple], before: tuple | None = None) -> tuple:
    """The state after events in order: from the state before them, or from the first of them, a `planned`."""
    if before is None:
        seq, since, _, first_end = events[0]
        events, before = events[1:], (seq, since, first_end, first_end, 0, [], False)
    seq, since, first_end, end_day, revisions, moves, withdrawn = before
    moves = list(moves)
    for seq, t, e, end in events:
        if e == "revised":
            if end is not None and end_day is not None and end != end_day:
                moves.append((seq, t, end_day, end))
            end_day, revisions, withdrawn = end if end is not None else end_day, revisions + 1, False
        elif e == "withdrawn":
            withdrawn = True
    return seq, since, first_end, end_day, revisions, moves, withdrawn


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """The session's state store is the one that holds lists and lets entries expire, and no batches are run for expiry alone, which would never end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def log_replay(events: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """The state of each id after a stream of log events (id, seq, t, e, end_day)."""
    spark, out = events.sparkSession, folder(events.sparkSession)
    with list_state(spark):
        mode = "ProcessingTime" if kept_ms else "None"
        states = events.groupBy("id").transformWithStateInPandas(Replay(kept_ms), REPLAYED, "update", mode)
        run_once(states, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    latest = spark.read.schema(f"{REPLAYED}, batch long").parquet(out)
    rows = latest.groupBy("id").agg(F.max_by(F.struct("since", "first_end", "end_day", "revisions", "moves", "withdrawn"), F.struct("batch", "seq")).alias("s"))
    return rows.select("id", "s.*")


def plan_changes(readings: DataFrame, state: DataFrame, first, last) -> DataFrame:
    """Events that a stream of readings makes against the known state. One micro-batch is one whole reading, else what is missing can't be told."""
    out = folder(state.sparkSession)

    def compare(reading: DataFrame, n: int) -> None:
        closures.plan_diff(state, reading, first, last).write.mode("overwrite").parquet(f"{out}/reading={n}")

    run_once(readings, compare, "append")
    return state.sparkSession.read.parquet(out).drop("reading")


def plan_log(readings: DataFrame, state: DataFrame, place: str, horizon: int = 14) -> tuple[DataFrame, DataFrame]:
    """Events (with reading_day) and last state of a stream of readings (id, tracked fields, reading_day), each compared with the log after the one before.

    One micro-batch is one whole reading. The state is a table of versions under `place`: reading n is compared
    with version n and leaves version n + 1 and its own events, so that a batch that is tried again writes the same
    again, and one that was done before a restart is passed over. Missing closures are withdrawn where their
    envelope overlaps the reading's day and `horizon` days after it; a reading without rows tells nothing and makes no events.
    """
    spark, columns = state.sparkSession, ["id", *closures.TRACKED]
    if not exists(spark, f"{place}/state/version=0/_SUCCESS"):
        state.select(*columns, "withdrawn").write.mode("overwrite").parquet(f"{place}/state/version=0")

    def compare(reading: DataFrame, n: int) -> None:
        after = f"{place}/state/version={n + 1}"
        if exists(spark, f"{after}/_SUCCESS"):
            return
        held, known = settled(reading), spark.read.parquet(f"{place}/state/version={n}")
        day = held.agg(F.min("reading_day")).first()[0]
        first = F.lit(day).cast("date")
        events = closures.plan_diff(known, held.select(*columns), first, F.date_add(first, horizon)) if day else closures.plan_diff(known, known.select(*columns), first, first).limit(0)
        events.withColumn("reading_day", first).write.mode("overwrite").parquet(f"{place}/events/batch={n}")
        closures.advanced(known, spark.read.parquet(f"{place}/events/batch={n}")).write.mode("overwrite").parquet(after)

    query = readings.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/progress").foreachBatch(compare).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    n = 0
    while exists(spark, f"{place}/state/version={n + 1}/_SUCCESS"):
        n += 1
    last = spark.read.parquet(f"{place}/state/version={n}")
    if not n:
        nothing = closures.plan_diff(last, last.select(*columns), F.lit(None).cast("date"), F.lit(None).cast("date"))
        return nothing.limit(0).withColumn("reading_day", F.lit(None).cast("date")), last
    return spark.read.parquet(f"{place}/events").drop("batch"), last


def counters(departures: DataFrame, claims: DataFrame) -> DataFrame:
    """n, cancelled and hist of each line and station from a stream of departures; claims: line_id of what a regional departure says (line_number, train_type, station).

    Only sums are kept, so months can be added as they come. Rides need their whole month and stay in the batch job.
    """
    out = folder(claims.sparkSession)
    local = punctuality.by_product(punctuality.with_delay(departures))[1].where("delay is not null")
    rows = punctuality.with_told(local, claims, "line_id").select(F.col("line_id").cast("string").alias("line_id"), "station", "delay", "cancelled")
    sums = punctuality.delay_counters(rows, "line_id", "station")
    run_once(sums, lambda rows, n: rows.write.mode("overwrite").parquet(out), "complete")
    return claims.sparkSession.read.parquet(out)
