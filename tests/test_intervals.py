"""The sweep against a plain merge, with small blocks so that entities are split."""

import random

import pytest

from tessera.operators.intervals import busy_and_gaps, final_runs


def brute(rows):
    by = {}
    for e, a, z in rows:
        if None not in (e, a, z) and z >= a:
            by.setdefault(e, []).append((a, z))
    out = set()
    for e, spans in by.items():
        merged = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out |= {(e, "busy", a, z) for a, z in merged} | {(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("leaf", [1, 3, 50, 4096])
def test_random_intervals(spark, leaf):
    r = random.Random(leaf)
    rows = [(r.choice(["hot", "hot", "b", "c", None]), r.choice([None, *range(900)]), r.choice([None, 0, 0, 1, 2, 5, 40, -3])) for _ in range(500)]
    rows = [(e, a, None if a is None or n is None else a + n) for e, a, n in rows] + [("hot", 5, 5), ("hot", 5, 5)]
    out = busy_and_gaps(spark.createDataFrame(rows, "session string, s bigint, e bigint"), "session", "s", "e", leaf)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_touching_points_and_empty(spark):
    schema = "k string, s bigint, e bigint"
    rows = [("a", 0, 5), ("a", 5, 7), ("a", 9, 9), ("a", 12, 11), ("b", 1, None)]
    assert {tuple(x) for x in busy_and_gaps(spark.createDataFrame(rows, schema), "k", "s", "e").collect()} == {("a", "busy", 0, 7), ("a", "gap", 7, 9), ("a", "busy", 9, 9)}
    assert busy_and_gaps(spark.createDataFrame([], schema), "k", "s", "e").count() == 0


def test_final_runs(spark):
    rows = [(1, "s", 0, 5, 1), (1, "s", 0, 9, 2), (2, "s", 3, None, 1)]
    out = final_runs(spark.createDataFrame(rows, "id bigint, session string, start_ms bigint, end_ms bigint, turns bigint"))
    assert {tuple(x) for x in out.collect()} == {(1, "s", 0, 9), (2, "s", 3, None)}
