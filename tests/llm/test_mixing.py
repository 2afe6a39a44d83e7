"""Flows and mixes: caps hold, shares are met, nothing is used without need."""

import random

import pytest

from tessera.llm import mixing


def test_flow_prefers_unrepeated_tokens():
    a, ab = frozenset("a"), frozenset("ab")
    total, flow = mixing.route({a: 10, ab: 10}, {"a": 15, "b": 10}, {"a": 3, "b": 2})
    assert total == 25 and flow[ab, "b"] == 10 and flow[a, "a"] >= 10
    total, flow = mixing.route({a: 10, ab: 20}, {"a": 12, "b": 10}, {"a": 3, "b": 2})
    assert total == 22 and flow[a, "a"] <= 10


def test_largest_mix():
    p = {frozenset("a"): 100, frozenset("b"): 10}
    q, flow = mixing.largest_mix(p, {"a": 1, "b": 1, "none": 8}, {"a": 1, "b": 3, "none": 5})
    assert q == {"a": 30, "b": 30} and flow == {(frozenset("a"), "a"): 30, (frozenset("b"), "b"): 30}
    assert mixing.largest_mix(p, {"none": 1}, {"none": 1}) == ({}, {})


TEXTS, TARGETS = "doc_id bigint, key string, source string, tokens bigint, copies string", "mix_id int, source string, target_share double, max_repeats int"


@pytest.mark.parametrize("rows_per_bucket", [20_000, 10])
def test_mixed(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", rows_per_bucket)
    r = random.Random(4)
    rows = [(i, f"k{i}", r.choice(["a", "a", "a", "b", "c"]), r.choice([0, 1, 5, 9, 20]), "") for i in range(900)]
    rows += [(1000 + i, f"k{i}", "b", rows[i][3], "") for i in range(0, 300, 3)] + [(2000, None, "a", 5, ""), (2001, "n", None, 5, ""), (2002, "z", "a", None, "")]
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.25, 2), (1, "c", 0.25, 3), (2, "c", 1.0, 4), (2, "gone", 1.0, 2), (3, "a", None, 1), (3, None, 1.0, 1)], TARGETS)
    df = spark.createDataFrame(rows, TEXTS)
    mix = mixing.mixed(df, targets)
    got = mix.collect()
    cap = {(1, "a"): 1, (1, "b"): 2, (1, "c"): 3, (2, "c"): 4}
    by = {i: (s, n) for i, _, s, n, _ in rows}
    assert all(1 <= x["copies"] <= cap[x["mix_id"], x["source"]] and by[x["doc_id"]] == (x["source"], x["tokens"]) for x in got)
    assert len({(x["mix_id"], x["source"], x["doc_id"]) for x in got}) == len(got)
    s = {(x["mix_id"], x["source"]): x for x in mixing.shares(mix, targets).collect()}
    for source, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        assert abs(s[1, source]["actual_share"] - share) < 0.02
    assert s[2, "gone"]["tokens"] == 0 and s[2, "c"]["most_copies"] == 4
    assert {tuple(x) for x in mixing.mixed(df.repartition(7), targets).collect()} == {tuple(x) for x in got}


def test_empty(spark):
    t = spark.createDataFrame([(1, "a", 1.0, 1)], TARGETS)
    assert mixing.mixed(spark.createDataFrame([], TEXTS), t).count() == 0 and mixing.mixed(spark.createDataFrame([(1, "k", "a", 3, "")], TEXTS), t.limit(0)).count() == 0
    assert mixing.shares(mixing.mixed(spark.createDataFrame([], TEXTS), t), t).first()["tokens"] == 0


def test_a_shared_text_is_used_as_often_as_its_most_generous_source_allows():
    both = frozenset("ab")
    assert mixing.route({both: 100}, {"a": 100, "b": 100}, {"a": 1, "b": 1})[0] == 100
    assert mixing.route({both: 100}, {"a": 100, "b": 300}, {"a": 1, "b": 3})[0] == 300
    total, flows = mixing.route({both: 100}, {"a": 200, "b": 100}, {"a": 1, "b": 3})
    assert total == 200 and flows[both, "a"] == 100
