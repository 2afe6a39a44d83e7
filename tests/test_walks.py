"""Walks in memory against the walks over tables; what they reach is not kept anywhere."""

import os
import random

import pytest

from tessera.operators import graph as op
from tessera.operators import walks
from tessera.plans import graph

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select("start", "id", "depth").collect())


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_closure_is_that_of_tables(spark, kind):
    r = random.Random(3)
    name = (lambda i: f"n{i}") if kind == "string" else (lambda i: 10**10 + i)
    pairs = [(name(r.randrange(150)), name(r.randrange(150))) for _ in range(210)] + [(name(900 + i), name(901 + i)) for i in range(30)] + [(None, name(1)), (name(1), name(1))]
    e = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
    starts = spark.createDataFrame([(name(i),) for i in [*range(150), 900, 5000]], f"id {kind}")
    assert rows(walks.closure(starts, e)) == rows(op.reach(starts, e).filter("depth > 0")) != []
    assert rows(walks.closure(starts, e.limit(0))) == rows(walks.closure(starts.limit(0), e)) == []


def test_budgets_are_those_of_tables(spark):
    r = random.Random(4)
    e = spark.createDataFrame([(r.randrange(120), r.randrange(120)) for _ in range(1500)], "a bigint, b bigint")
    starts, keep = spark.range(130), spark.range(125).filter("id % 3 > 0")
    for depth, frontier, budget in ((3, 4, 30), (2, 40, 2000), (4, 2, 7)):
        want = op.reach(starts, e, depth, frontier, budget).filter("depth > 0").join(keep, "id", "left_semi")
        assert rows(walks.budgeted(starts, e, depth, frontier, budget, keep)) == rows(want) != []


def test_closures_are_not_kept(spark, monkeypatch):
    chain = spark.createDataFrame([(f"T{i:03}", f"T{i + 1:03}") for i in range(200)], "a string, b string")
    monkeypatch.setattr(graph, "supertype_edges", lambda s, d: chain)
    monkeypatch.setattr(op, "cut", lambda df: pytest.fail("a level was written"))
    assert walks.closure(chain.selectExpr("a AS id"), chain).rdd.getNumPartitions() == 4
    assert graph.g4_supertypes(spark, "").count() == graph.g5_subtypes(spark, "").count() == 200 * 201 // 2


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_reached_tests_are_not_kept(spark, monkeypatch):
    monkeypatch.setattr(op, "cut", lambda df: pytest.fail("a level was written"))
    assert graph.r14_test_selection(spark, D).count() > 0
    assert graph.g9_test_reach(spark, D).count() >= 0


def test_more_edges_than_a_worker_holds(spark, monkeypatch):
    monkeypatch.setattr(walks, "LIMIT", 5)
    chain = spark.createDataFrame([(f"T{i}", f"T{i + 1}") for i in range(9)], "a string, b string")
    assert walks.closure(chain.selectExpr("a AS id"), chain) is None
    assert graph.closed(chain).count() == 45


@pytest.mark.parametrize("seed", range(2))
def test_members_are_those_of_tables(spark, seed):
    from tessera.operators import resolve

    r = random.Random(seed)
    t = lambda: f"T{r.randrange(40)}"
    members = spark.createDataFrame([(i, t(), f"m{r.randrange(6)}", "fun", r.choice([0, 1, None])) for i in range(200)], "member bigint, type string, name string, kind string, arity int")
    supers = spark.createDataFrame([(t(), t()) for _ in range(45)], "a string, b string")
    types = spark.createDataFrame([(f"T{i}",) for i in range(0, 50, 2)] + [(None,)], "id string")
    uses = spark.createDataFrame([(i, t(), f"m{r.randrange(7)}") for i in range(150)], "use int, type string, name string")
    above = resolve.levels(supers, types)
    got = walks.overrides(members, supers, types).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, resolve.overrides(members, above).collect())) != []
    got = walks.member_lookup(uses, ["use"], members, supers, types).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, resolve.member_lookup(uses, members, above).collect())) != []
    assert walks.overrides(members.limit(0), supers, types).count() == walks.member_lookup(uses, ["use"], members, supers.limit(0), types.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", ["g6_overrides", "r3_member_lookup"])
def test_types_above_are_not_kept(spark, monkeypatch, name):
    monkeypatch.setattr(op, "cut", lambda df: pytest.fail("a level was written"))
    assert graph.QUERIES[name](spark, D).count() >= 0


@pytest.mark.parametrize("few", [20, 400])
def test_co_changes_are_counted_exactly(spark, few):
    r = random.Random(few)
    x = {(f"A-{r.randrange(60)}", f"p{int(r.random() ** 3 * few)}") for _ in range(600)}
    got = walks.co_changed(spark.createDataFrame(sorted(x), "task string, path string"), spark.createDataFrame([(f"A-{i}",) for i in range(0, 70, 2)], "id string"), 2, 5)
    want = set()
    for a in {t for t, _ in x if int(t[2:]) % 2 == 0}:
        own = {p for t, p in x if t == a}
        near = {t for t, p in x if p in own and t != a}
        for p in {p for _, p in x} - own:
            n = sum((t, p) in x for t in near)
            if n >= max(2, -(-len(near) // 5)):
                want.add((a, p, n))
    rows = [tuple(z) for z in got.collect()]
    assert set(rows) == want != set() and len(rows) == len(want)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_tasks_beside_are_not_paired(spark):
    from tessera.plans import aggregates

    plan = aggregates.a24_co_change(spark, D)._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].split("MapInArrow")[0]


def test_best_alike_are_those_of_all_pairs(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    placed = [(f"w{w}", f"I-{i}", r.randrange(2), r.choice([0.25, 0.5, r.random()])) for i in range(150) for w in r.sample(range(30), 6)]
    p = spark.createDataFrame(placed, "term string, id string, own int, part double")
    terms = spark.createDataFrame([(f"I-{q}", f"w{w}", w % 2) for q in [*range(9), 900] for w in r.sample(range(33), 5)], "q string, term string, src int")
    got = {}
    for x in walks.best_alike(p, terms, 10).collect():
        got.setdefault(x["q"], []).append((-round(x["score"], 6), x["id"], x["shared"], x["in_title"]))
    every = p.join(terms, "term").filter("q <> id").groupBy("q", "id").agg(F.sum("part").alias("score"), F.sum("own").alias("shared"), F.sum(F.when(F.col("src") == 0, F.col("own")).otherwise(0)).alias("in_title"))
    want = {}
    for x in every.collect():
        want.setdefault(x["q"], []).append((-round(x["score"], 6), x["id"], x["shared"], x["in_title"]))
    assert {q: sorted(v)[:10] for q, v in got.items()} == {q: sorted(v)[:10] for q, v in want.items()} and len(want) == 10
    assert max(map(len, got.values())) < max(map(len, want.values()))  # few are sent on


def test_budgets_by_name_are_those_of_edges(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(5)
    declared = spark.createDataFrame([(r.randrange(120), f"N{r.randrange(40)}") for _ in range(150)] + [(None, "N1"), (3, None), (3, "unused")], "a bigint, name string")
    used = spark.createDataFrame([(r.randrange(130), f"N{int(r.random() ** 2 * 45)}") for _ in range(700)] + [(None, "N1"), (5, None)], "b bigint, name string")
    e = declared.join(used, "name").filter("a <> b").select("a", "b").distinct()
    starts, keep = spark.range(140), spark.range(125).filter("id % 3 > 0")
    want = {x: rows(op.reach(starts, e, *x).filter("depth > 0").join(keep, "id", "left_semi")) for x in ((3, 4, 30), (2, 40, 2000), (4, 2, 7))}
    monkeypatch.setattr(walks, "LIMIT", declared.join(used, "name").filter("a <> b").distinct().count() - 1)  # the edges wouldn't fit
    for x in want:
        assert rows(walks.budgeted_by_name(starts, declared, used, *x, keep)) == want[x] != []
        n = walks.budgeted_by_name(starts, declared, used, *x, keep, True)
        assert sorted(map(tuple, n.collect())) == sorted(map(tuple, spark.createDataFrame(want[x], "start bigint, id bigint, d int").groupBy("start").agg(F.count("*")).collect()))
    assert rows(walks.budgeted_by_name(starts, declared.limit(0), used, 3, 4, 30, keep)) == rows(walks.budgeted_by_name(starts, declared, used.limit(0), 3, 4, 30, keep)) == []


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_tests_are_selected_without_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "reference_edges", lambda s, d: pytest.fail("edges were made"))
    assert graph.r14_test_selection(spark, D).count() > 0 and graph.g9_test_reach(spark, D).count() >= 0


@pytest.mark.parametrize("share", [10**6, 150])
def test_best_linked_are_those_of_all_pairs(spark, monkeypatch, share):
    import math

    monkeypatch.setattr(walks, "SHARE", share)
    r = random.Random(share)
    worth = {"file": ("file", 100), "symbol": ("symbol", 100), "named": ("symbol", 85), "caller": ("caller", 60), "task": ("task", 30)}
    ids = [f"I-{i}" for i in range(150)]
    docs = {i: (r.choice([0, 0, 4, 12]), r.choice([5, 6, None])) for i in ids}
    placed = {(f"w{w}", i): r.choice([0.25, 0.5, r.random()]) for i in ids for w in r.sample(range(30), 4)}
    links = {(i, r.choice(["file", "symbol", "named", "task"]), f"N{r.randrange(6)}") for i in ids for _ in range(r.choice([0, 0, 1, 2, 3]))} | {(i, k, "N1") for i in ("I-0", "I-100") for k in ("file", "symbol")}
    asked = {(q, "term", f"w{w}") for q in [*ids[:12], "I-900"] for w in r.sample(range(33), r.choice([1, 4]))} | {(q, k, w) for q, k, w in links if q in ids[:12:2] and k != "task"}
    declared = {(f"N{r.randrange(10)}", f"t{r.randrange(8)}") for _ in range(6)} | {(None, "t1"), ("N1", None)}
    used = {(f"t{r.randrange(9)}", f"N{r.randrange(10)}") for _ in range(12)} | {("t1", None)}
    df = lambda rows, schema: spark.createDataFrame(sorted(rows, key=str), schema)
    got = walks.best_linked(
        df([(i, *v) for i, v in docs.items()], "id string, more bigint, updated bigint"), df([(w, i, v) for (w, i), v in placed.items()], "term string, id string, part double"), df(links, "id string, kind string, what string"),
        df(asked, "q string, kind string, what string"), df(declared, "z string, t string"), df(used, "t string, x string"), worth, 10,
    )
    calls = {(z, x) for z, t in declared for u, x in used if None not in (z, t, x) and t == u and z != x}
    order = lambda x: (-x[1], -(x[3] or 0), x[0])
    want, found, most = {}, {}, 0
    for q in {a[0] for a in asked}:
        text = {i: round(sum(v for (w, j), v in placed.items() if j == i and (q, "term", w) in asked), 6) for i in ids if i != q}
        files = {w for p, k, w in asked if p == q and k == "file"}
        for i in text:
            kinds = {k for k in ("file", "symbol", "named") if any((i, k, w) in links for p, l, w in asked if p == q and l == k)}
            kinds |= {"task"} if any((i, "task", w) in links for w in files) else set()
            kinds |= {"caller"} if any((i, k, x) in links for z, x in calls if z in files for k in ("file", "named")) else set()
            tiers, share_of = {worth[k][0] for k in kinds}, math.floor(20 * text[i] / max(text.values()) + 0.5) if max(text.values()) else 0
            if tiers or share_of:
                code = 100 * (max(worth[k][1] for k in kinds) + 5 * (len(tiers) - 1)) if kinds else 0
                want.setdefault(q, []).append((i, code + share_of + docs[i][0], len(tiers), docs[i][1]))
    for x in got.collect():
        found.setdefault(x["q"], []).append(tuple(x)[1:])
        most = max(most, len(found[x["q"]]))
    assert {q: sorted(v, key=order)[:10] for q, v in found.items()} == {q: sorted(v, key=order)[:10] for q, v in want.items()} != {}
    assert most <= 10 * (1 if share > 150 else 4) < max(map(len, want.values()))  # few are sent on
    assert any(t > 1 for v in want.values() for _, _, t, _ in v) and any(len([1 for x in v if x[2]]) < 10 < len(v) for v in want.values())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_linked_issues_are_not_paired(spark):
    from tessera.plans import search

    plan = search.q10_tiers(spark, D)._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_all_users_are_reached_by_name(spark):
    r = random.Random(6)
    hub = [(f"H{i}", "hub") for i in range(130)]  # more than a level of 40, 64 starts and more than one word of bits
    declared = spark.createDataFrame([(f"M{r.randrange(120)}", f"N{r.randrange(40)}") for _ in range(150)] + [(i, f"{i}x") for i, _ in hub] + [("M0", "hub"), (None, "N1"), ("M3", None), ("M3", "unused")], "a string, name string")
    used = spark.createDataFrame([(f"M{r.randrange(130)}", f"N{int(r.random() ** 2 * 45)}") for _ in range(60)] + hub + [(f"T{i}", f"{i}x") for i, _ in hub] + [(None, "N1"), ("M5", None)], "b string, name string")
    e = declared.join(used, "name").filter("a <> b").select("a", "b").distinct()
    starts = spark.createDataFrame([(f"M{i}",) for i in range(140)] + [(i,) for i, _ in hub], "id string")
    keep = spark.createDataFrame([(f"M{i}",) for i in range(0, 125, 2)] + [(f"T{i}",) for i, _ in hub], "id string")
    for depth in (1, 2, 3, 5):
        want = op.reach(starts, e, depth).filter("depth > 0").join(keep, "id", "left_semi").groupBy("start").count()
        got = dict(map(tuple, walks.reached_by_name(starts, declared, used, depth, keep).collect()))
        assert got == dict(map(tuple, want.collect())) != {}
        assert got.get("M0", 0) >= 130 or depth == 1
    assert walks.reached_by_name(starts, declared.limit(0), used, 3, keep).count() == walks.reached_by_name(starts, declared, used.limit(0), 3, keep).count() == 0


@pytest.mark.parametrize("limit", [60_000_000, 5])
def test_no_test_of_a_file_is_dropped(spark, monkeypatch, limit):
    n = 60  # 60 files use the first; each is used by one test, those after the 40th as well
    files = [(0, "main")] + [(i, "main") for i in range(1, n + 1)] + [(100 + i, "test") for i in range(1, n + 1)]
    declared = [("Core", 0)] + [(f"Part{i}", i) for i in range(1, n + 1)]
    used = [(i, "Core") for i in range(1, n + 1)] + [(100 + i, f"Part{i}") for i in range(1, n + 1)]
    monkeypatch.setattr(walks, "LIMIT", limit)
    monkeypatch.setattr(graph.b, "files", lambda s, d: s.createDataFrame([(i, f"src/F{i}.kt", "m", x) for i, x in files], "id bigint, path string, module string, source_set string"))
    monkeypatch.setattr(graph, "type_files", lambda s, d: s.createDataFrame(declared, "name string, b bigint"))
    monkeypatch.setattr(graph, "used_names", lambda s, d: s.createDataFrame(used, "a bigint, name string"))
    monkeypatch.setattr(graph, "reference_edges", lambda s, d: graph.used_names(s, d).join(graph.type_files(s, d), "name").selectExpr("a", "b", "1.0 AS w").filter("a <> b"))
    got = {x["id"]: (x["scope"], x["tests"]) for x in graph.r14_test_selection(spark, "").collect()}
    assert got == {0: ("reached", n)} | {i: ("reached", 1) for i in range(1, n + 1)}
