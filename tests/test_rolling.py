"""Rolling totals against a plain loop."""

import random

import pytest

from tessera.operators.rolling import project_usage, quiet_days, rolling_totals


def brute(rows, periods):
    sums, pos = {}, {}
    for e, d, a in rows:
        if e is not None and d is not None:
            sums[e, d] = sums.get((e, d), 0) + (a or 0)
            if (a or 0) > 0:
                pos.setdefault(e, set()).add(d)
    return {(e, d): tuple(round(sum(sums.get((e, x), 0) for x in range(d - p + 1, d + 1)), 6) for p in periods) for e, ds in pos.items() for d in range(min(ds), max(ds) + 1)}


@pytest.mark.parametrize("periods", [(7, 30), (1, 2, 21), (5,)])
def test_random_days(spark, periods):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(-300, 900)]), r.choice([None, 0.0, 1.5, 2.25])) for _ in range(400)]
    df = spark.createDataFrame(rows, "who string, day bigint, cost double")
    out = rolling_totals(df, "who", "day", "cost", periods).collect()
    assert {(x["who"], x["day"]): tuple(round(x[f"total_{p}"], 6) for p in periods) for x in out} == brute(rows, periods)
    assert all(abs(x[f"avg_{p}"] * p - x[f"total_{p}"]) < 1e-9 for x in out for p in periods)


def test_empty_and_zero_only(spark):
    df = spark.createDataFrame([], "e string, d bigint, a double")
    assert rolling_totals(df, "e", "d", "a").count() == 0
    assert rolling_totals(spark.createDataFrame([("x", 5, 0.0), ("x", 9, None)], df.schema), "e", "d", "a").count() == 0


def test_usage_counts_a_repeated_hour_once(spark):
    runs = spark.createDataFrame([(1, "p", 5, 1, "x"), (1, "p", 9, 2, "x"), (2, None, None, None, "y")], "id bigint, project string, end_ms bigint, turns bigint, extra string")
    hours = spark.createDataFrame([(1, 24, 1.0), (1, 24, 1.0), (1, 72, 2.0), (2, 24, 9.0), (7, 24, 9.0), (1, 30, None)], "run_id bigint, hour bigint, cost double")
    t = rolling_totals(project_usage(hours, runs), "project", "day", "cost")
    assert {(r["day"], r["total_7"]) for r in t.collect()} == {(1, 1.0), (2, 1.0), (3, 3.0)}
    assert {tuple(r) for r in quiet_days(t, "project").collect()} == {("p", 2, 7), ("p", 2, 30)}
