"""Streams over several batches, with a stop and a restart in between, against the whole."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import jobs

START = datetime(2025, 3, 1)


def put(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/.{name}")
    import glob
    import os

    for p in glob.glob(f"{folder}/.{name}/part-*.parquet"):
        os.rename(p, f"{folder}/{name}.parquet")


@pytest.fixture
def events():
    r = random.Random(3)
    return [(i, START + timedelta(minutes=r.randrange(6000)), r.choice("abc"), r.randrange(4), r.random()) for i in range(300)]


EVENTS = "event_id bigint, ts timestamp, kind string, user bigint, value double"


def staged(spark, tmp_path, rows, schema, job, parts=5):
    """Runs `job(stream, path)` over a part of the files, and again after the rest came, with one file per batch."""
    folder = str(tmp_path / "in")
    tmp_path.joinpath("in").mkdir()
    cut = [rows[i::parts] for i in range(parts)]
    for i, part in enumerate(cut):
        put(spark, folder, part, schema, f"f{i}")
        if i in (parts // 2, parts - 1):
            out = job(jobs.file_stream(spark, folder, files_per_batch=1), str(tmp_path / "out"))
    return out


def test_drained(spark, tmp_path, events):
    out = staged(spark, tmp_path, events, EVENTS, lambda s, p: jobs.drained(s.filter("value > 0.5").select("event_id"), p))
    assert sorted(r[0] for r in out.collect()) == [e[0] for e in events if e[4] > 0.5]


def test_upserted(spark, tmp_path):
    rows = [(f"k{i % 37}", i * 7 % 101) for i in range(200)]
    merge = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("k").agg(F.max("v").alias("v"))
    out = staged(spark, tmp_path, rows, "k string, v bigint", lambda s, p: jobs.upserted(s, ["k"], merge, p))
    assert {tuple(r) for r in out.collect()} == {(k, max(v for x, v in rows if x == k)) for k, _ in rows}


def test_windows(spark, tmp_path, events):
    out = staged(spark, tmp_path, events, EVENTS, lambda s, p: jobs.tumbling(s, "ts", "1 hour", "30 days", ["kind"], p))
    df = spark.createDataFrame(events, EVENTS)
    want = df.groupBy(F.window("ts", "1 hour").alias("w"), "kind").count().select("w.start", "kind", "count")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_sliding(spark, tmp_path, events):
    out = staged(spark, tmp_path, events, EVENTS, lambda s, p: jobs.sliding(s, "ts", "1 hour", "15 minutes", "30 days", p))
    want = spark.createDataFrame(events, EVENTS).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).count().select("w.start", "count")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_are_bridged_by_late_rows(spark, tmp_path, events):
    out = staged(spark, tmp_path, events, EVENTS, lambda s, p: jobs.sessions(s, "ts", "40 minutes", "user", p))
    want = spark.createDataFrame(events, EVENTS).groupBy("user", F.session_window("ts", "40 minutes").alias("w")).count().select("user", "w.start", "w.end", "count")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_days_over_the_limit_are_announced_once(spark, tmp_path):
    rows = [(i % 11, 24 * (i % 5) + i % 24, 0.1) for i in range(150)] + [(1, 0, 0.1)] * 3
    out = staged(spark, tmp_path, rows, "run_id bigint, hour bigint, cost double", lambda s, p: jobs.exceeded(s, F.floor(F.col("hour") / 24), ["run_id", "hour"], "cost", 1.05, p))
    days = {}
    for r in set(rows):
        days[r[1] // 24] = days.get(r[1] // 24, 0) + r[2]
    assert sorted(r[0] for r in out.collect()) == sorted(d for d, c in days.items() if c > 1.05) != []


def test_nothing(spark, tmp_path):
    put(spark, str(tmp_path), [], EVENTS, "none")
    stream = jobs.file_stream(spark, str(tmp_path))
    assert jobs.tumbling(stream, "ts", "1 hour", "1 day", ["kind"]).count() == 0 and jobs.sessions(stream, "ts", "1 hour", "user").count() == 0
