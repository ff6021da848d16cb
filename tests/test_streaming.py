"""Streaming jobs over several micro-batches against their batch forms."""

import datetime as dt
import os
import random
import shutil
import tempfile

import pytest

from trackweave.operators import closures
from trackweave.streaming import jobs

LOG = "id long, seq long, t date, e string, end_day date"


def stream_of(spark, parts, schema):
    """A stream with one file, and so one micro-batch, for each part; files are read in order of their age."""
    path, aged = tempfile.mkdtemp(prefix="spark-"), set()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        new = {f for f in os.listdir(path) if f.endswith(".parquet")} - aged
        for f in new:
            os.utime(f"{path}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
        aged |= new
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_log_in_any_order_of_batches(spark, seed):
    """Late events, also ones before a `planned` that came first, count in their place."""
    r = random.Random(seed)
    day = lambda: dt.date(2026, 1, 1) + dt.timedelta(days=r.randrange(30))
    events = []
    for seq in range(150):
        e = r.choices(["planned", "revised", "withdrawn"], [2, 5, 1])[0]
        events.append((r.randrange(12), seq, day(), e, None if e == "withdrawn" or r.random() < 0.1 else day()))
    shuffled = r.sample(events, len(events))
    got = jobs.log_replay(stream_of(spark, [shuffled[a : a + 30] for a in range(0, 150, 30)], LOG))
    expected = closures.replay(spark.createDataFrame(events, LOG))
    columns = ["id", "since", "first_end", "end_day", "revisions", "moves", "withdrawn"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))


def test_a_log_in_order_reads_no_lists(spark):
    """Many batches in order, two of them with late events; lists that have expired lose no folded state."""
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    events = [(k, 0, day(0), "planned", day(5)) for k in range(3)] + [(k, 1 + s, day(s), "revised", day(6 + s)) for s in range(6) for k in range(3)] + [(7, 3, day(1), "revised", day(9)), (7, 1, day(0), "planned", day(4))]
    parts = [events[:8], events[8:12], events[12:16], events[16:21], [(0, 9, day(7), "withdrawn", None)], events[21:]]
    columns = ["id", "since", "first_end", "end_day", "revisions", "moves", "withdrawn"]
    expected = sorted(map(str, closures.replay(spark.createDataFrame([x for p in parts for x in p], LOG)).select(*columns).collect()))
    assert sorted(map(str, jobs.log_replay(stream_of(spark, parts, LOG)).select(*columns).collect())) == expected
    short = jobs.log_replay(stream_of(spark, parts[:5], LOG), kept_ms=1)
    kept = sorted(map(str, closures.replay(spark.createDataFrame([x for p in parts[:5] for x in p], LOG)).select(*columns).collect()))
    assert sorted(map(str, short.select(*columns).collect())) == kept


READING = "id long, begin_day date, end_day date, effect string, reading_day date"


def test_readings_meet_the_log_after_the_one_before(spark, tmp_path):
    day = lambda n: dt.date(2026, 3, n)
    row = lambda k, end, reading, effect="closed": (k, day(1), day(end), effect, day(reading))
    state = spark.createDataFrame([(9, day(1), day(30), "other", False), (8, day(1), day(2), "other", False)], "id long, begin_day date, end_day date, effect string, withdrawn boolean")
    readings = [[row(1, 20, 3), row(2, 20, 3)], [row(1, 20, 4), row(2, 20, 4)], [row(1, 25, 5)], [row(1, 25, 6), row(2, 20, 6)], [row(2, 20, 7, "slower")]]
    stream = stream_of(spark, readings, READING)
    events, last = jobs.plan_log(stream, state, str(tmp_path / "log"))
    got = sorted((r["reading_day"].day, r["id"], r["e"], r["was_end_day"] and r["was_end_day"].day, r["now_end_day"] and r["now_end_day"].day, r["now_effect"]) for r in events.collect())
    assert got == [(3, 1, "planned", None, 20, "closed"), (3, 2, "planned", None, 20, "closed"), (3, 9, "withdrawn", None, None, None), (5, 1, "revised", 20, 25, None), (5, 2, "withdrawn", None, None, None), (6, 2, "revised", None, None, None), (7, 1, "withdrawn", None, None, None), (7, 2, "revised", None, None, "slower")]
    assert {r["id"]: (r["end_day"].day, r["effect"], r["withdrawn"]) for r in last.collect()} == {1: (25, "closed", True), 2: (20, "slower", False), 8: (2, "other", False), 9: (30, "other", True)}
    # Batches that were done are passed over when they are tried again.
    shutil.rmtree(tmp_path / "log" / "progress")
    again, same = jobs.plan_log(stream, state, str(tmp_path / "log"))
    assert again.count() == len(got) and sorted(map(tuple, same.collect())) == sorted(map(tuple, last.collect()))


def test_empty_stream_of_readings(spark, tmp_path):
    state = spark.createDataFrame([(9, None, None, "other", False)], "id long, begin_day date, end_day date, effect string, withdrawn boolean")
    events, last = jobs.plan_log(stream_of(spark, [[]], READING), state, str(tmp_path / "log"))
    assert events.count() == 0 and last.count() == 1
