"""Histories against a plain loop, with small blocks so that entities are split."""

import random

import pytest

from tessera.operators.history import coalesce_versions, field_history


def brute(rows):
    by = {}
    for e, f, v in rows:
        by.setdefault(e, []).append((f, v))
    out = set()
    for e, vs in by.items():
        vs.sort()
        kept = [x for i, x in enumerate(vs) if i == 0 or x[1] != vs[i - 1][1]]
        out |= {(e, v, f, kept[i + 1][0] if i + 1 < len(kept) else -1) for i, (f, v) in enumerate(kept)}
    return out


@pytest.mark.parametrize("leaf", [1, 2, 7, 64, 4096])
def test_random_versions(spark, leaf):
    r = random.Random(leaf)
    rows = [("hot", f, r.choice(["a", "a", "a", "b", None])) for f in range(300)] + [(e, f, r.choice(["x", None])) for e in ("p", "q", None) for f in r.sample(range(99), 12)] + [("one", 3, "v")]
    rows += [("flat", f, "same") for f in range(40)]
    r.shuffle(rows)
    out = coalesce_versions(spark.createDataFrame(rows, "e string, f bigint, v string"), ["e"], "f", "v", leaf)
    got = [tuple(x) for x in out.select("e", "v", "valid_from", "valid_to").collect()]
    assert len(got) == len(set(got)) and set(got) == {(e, v, f, t) for e, v, f, t in brute([(e, f, v) for e, f, v in rows])}


CH, IS = "id string, project string, issue string, at bigint, field string, removed string, added string, author string", "id string, created bigint, updated bigint, note string"


def test_rules(spark):
    ch = [
        ("f2", "P", "A-1", 100, "State", "Open", "Review", None), ("f1", "P", "A-1", 100, "state", "New", "Done", None), ("f2", "P", "A-1", 100, "State", "Open", "Review", None),
        ("f3", "P", "A-1", 200, "STATE", "x", "Review", None), ("f4", "P", "A-1", 300, "state", None, None, None), ("f5", "P", "X-9", 50, "type", None, "Bug", None), (None, "P", None, 50, "type", None, "Bug", None),
    ]
    issues = [(" a-1 ", 10, 1, ""), ("A-1", 20, 2, ""), ("B", None, 1, "")]
    out = field_history(spark.createDataFrame(ch, CH), spark.createDataFrame(issues, IS))
    # At 100 the greatest id stands for what holds from there, the smallest for what held before.
    assert {tuple(r) for r in out.collect()} == {("A-1", "state", "New", 20, 100), ("A-1", "state", "Review", 100, 300), ("A-1", "state", None, 300, -1), ("X-9", "type", "Bug", 50, -1)}


def test_empty(spark):
    assert field_history(spark.createDataFrame([], CH), spark.createDataFrame([], IS)).count() == 0
