"""Scopes, members, overrides, arguments, version matching and line differences on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import common_lines, line_diff
from tessera.operators import graph, outputs, resolve
from tessera.operators.tables import matched_versions

TYPES = [(1, "Box", "a.Box", "a", 10), (2, "Box", "b.Box", "b", 20), (3, "Lid", "a.Lid", "a", 10), (4, "Rim", "c.Rim", "c", 30), (5, "Pin", "b.Pin", "b", 20), (6, "Pin", "c.Pin", "c", 30), (7, "Only", "d.Only", "d", 40)]


@pytest.fixture(scope="module")
def tables(spark):
    types = spark.createDataFrame(TYPES, "target bigint, name string, fqn string, package string, home bigint")
    refs = spark.createDataFrame([(10, "Box"), (10, "Rim"), (11, "Lid"), (11, "Rim"), (11, "Pin"), (12, "Crate"), (12, "Box"), (12, "Only"), (12, "Nope"), (13, "Pin"), (13, None), (13, "Pin")], "file_id bigint, name string")
    imports = spark.createDataFrame([(12, "Crate", "b.Box"), (11, "Pin", "b.Pin"), (12, "Gone", "x.Gone")], "file_id bigint, name string, fqn string")
    stars = spark.createDataFrame([(11, "c"), (13, "b"), (13, "c")], "file_id bigint, package string")
    packages = spark.createDataFrame([(10, "a"), (11, "a"), (12, "e"), (13, None)], "file_id bigint, package string")
    return refs, types, imports, stars, packages


def test_scopes(tables):
    near = resolve.scoped(*tables)
    got = {(r["file_id"], r["name"]): (r["level"], set()) for r in near.collect()}
    for r in near.collect():
        got[r["file_id"], r["name"]][1].add(r["target"])
    assert got == {(10, "Box"): (0, {1}), (11, "Lid"): (2, {3}), (11, "Rim"): (3, {4}), (11, "Pin"): (1, {5}), (12, "Crate"): (1, {2}), (13, "Pin"): (3, {5, 6})}
    labels = {(r["file_id"], r["name"]): (r["target"], r["label"]) for r in resolve.labelled(tables[0], near, tables[1]).collect()}
    assert labels[13, "Pin"] == (5, "CANDIDATE") and labels[12, "Box"] == (1, "OTHER") and labels[10, "Rim"] == (4, "OTHER") and (12, "Nope") not in labels and labels[11, "Rim"] == (4, "EXACT")
    assert resolve.scoped(*(t.limit(0) for t in tables)).count() == 0


def test_promotion(spark, tables):
    rows = spark.createDataFrame([(12, "Only"), (12, "Box"), (10, "Rim")], "file_id bigint, name string")
    outside = spark.createDataFrame([("Rim",), (None,)], "name string")
    assert [tuple(r) for r in resolve.promoted(rows, tables[1], outside).collect()] == [(12, "Only", 7)]


def test_members_and_overrides(spark):
    supers = spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "I"), ("A", "B"), ("X", "External")], "a string, b string")
    types = spark.createDataFrame([(t,) for t in "ABCIX"], "id string")
    above = resolve.levels(supers, types)
    assert {(r["above"], r["level"]) for r in above.filter("type = 'C'").collect()} == {("C", 0), ("B", 1), ("I", 1), ("A", 2)}
    assert {r["above"] for r in above.filter("type = 'X'").collect()} == {"X", "External"}
    members = spark.createDataFrame([(1, "A", "run", "fun", 0), (2, "B", "run", "fun", 0), (3, "B", "run", "fun", 1), (4, "C", "run", "fun", 1), (5, "I", "stop", "fun", 0), (6, "C", "run", "val", 0)], "member bigint, type string, name string, kind string, arity int")
    uses = spark.createDataFrame([(100, "C", "run"), (101, "C", "stop"), (102, "A", "stop"), (103, None, "run")], "use bigint, type string, name string")
    hit = {tuple(r) for r in resolve.member_lookup(uses, members, above).collect()}
    assert {h for h in hit if h[0] == 100} == {(100, 4, 0, True), (100, 6, 0, True), (100, 2, 1, False), (100, 3, 1, False), (100, 1, 2, False)}
    assert {h for h in hit if h[0] > 100} == {(101, 5, 1, True)}
    assert {tuple(r) for r in resolve.overrides(members, above).collect()} == {(4, 3, 1), (2, 1, 1), (1, 2, 1)}


def test_argument_counts(spark):
    ps = '[{"name": "a", "type": "Int"}, {"name": "b", "type": "Int", "default": "true"}]'
    many = '[{"name": "a", "type": "Int"}, {"name": "v", "type": "Int", "vararg": "true"}]'
    df = spark.createDataFrame([(p, t, n) for p, t in ((ps, 2), (many, 2), (None, 0), ("[]", 0)) for n in range(4)], "p string, t int, n int")
    got = [r[0] for r in df.select(resolve.accepts(F.col("p"), F.col("t"), F.col("n"))).collect()]
    assert got == [False, True, True, False, False, True, True, True, True, False, False, False, True, False, False, False]


def _greedy(old, new):
    """Brute force: always the closest remaining pair, then the one that begins first."""
    out, o, n = set(), dict(old), dict(new)
    while o and n:
        _, _, a, z = min((abs(o[a] - n[z]), min(o[a], n[z]), a, z) for a in o for z in n)
        out.add((a, z))
        del o[a], n[z]
    return out | {(a, None) for a in o} | {(None, z) for z in n}


@pytest.mark.parametrize("seed", range(4))
def test_versions_matched_by_nearest(spark, seed):
    r = random.Random(seed)
    schema = "id bigint, kind string, same string, alike string, at bigint"
    places = r.sample(range(200), 30)  # distinct, so that nothing but distance decides
    old = [(i, "f", f"o{i}", None, p) for i, p in enumerate(places[:14])]
    new = [(100 + i, "f", f"n{i}", None, p) for i, p in enumerate(places[14:])]
    got = matched_versions(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["kind"], "same", "alike", "at").collect()
    assert {(x["old_id"], x["new_id"]) for x in got} == _greedy({x[0]: x[4] for x in old}, {x[0]: x[4] for x in new})


def test_version_passes(spark):
    schema = "id bigint, kind string, c string, same string, alike string, at bigint"
    old = spark.createDataFrame([(1, "f", None, "h1", "s1", 1), (2, "f", None, "h2", "s2", 5), (3, "f", "x", "h3", "s3", 9), (4, "g", None, "h4", "s4", None)], schema)
    new = spark.createDataFrame([(11, "f", None, "h1", "zz", 50), (12, "f", None, "hh", "s2", 5), (13, "f", "x", "q", "r", 9), (14, "g", "y", "h4", "s4", 1)], schema)
    got = {tuple(r) for r in matched_versions(old, new, ["kind", "c"], "same", "alike", "at").collect()}
    assert got == {(1, 11, "="), (2, 12, "~"), (3, 13, "^"), (4, None, "-"), (None, 14, "+")}
    assert matched_versions(old.limit(0), new.limit(0), ["kind", "c"], "same", "alike", "at").count() == 0


def _lcs(a, z):
    row = [0] * (len(z) + 1)
    for x in a:
        d = 0
        for j, y in enumerate(z, 1):
            d, row[j] = row[j], d + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_line_differences(spark):
    r = random.Random(5)
    for _ in range(300):
        a, z = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        assert common_lines(a, z) == _lcs(a, z)
    long = [f"line {i % 700}" for i in range(20_000)]
    assert common_lines(long, long[5:] + ["x"]) == len(long) - 5
    df = spark.createDataFrame([("a\nb", "b\nc"), (None, "a"), ("", ""), ("a", None)], "o string, n string")
    assert [tuple(x[0]) for x in df.select(line_diff(F.col("o"), F.col("n"))).collect()] == [(1, 1), (1, 1), (0, 0), (1, 1)]


def test_first_of_groups(spark):
    tasks = spark.createDataFrame([("a", "g", 1, 1), ("b", "g", 1, 2), ("c", "g", 5, 3), ("d", "g", 2, 4), ("x", "h", 1, 9), ("y", "h", 1, 8)], "id string, component string, rank int, num bigint")
    needs = spark.createDataFrame([("a", "c"), ("x", "y"), ("y", "x"), ("b", "zz")], "id string, need string")
    got = {(r["id"], r["place"]) for r in graph.first_of_groups(tasks, needs, 3).collect()}
    assert got == {("b", 1), ("d", 2), ("c", 3), ("y", 1), ("x", 2)}


def test_budgeted_reach(spark):
    edges = spark.createDataFrame([("s", f"n{i}") for i in range(9)] + [(f"n{i}", f"m{i}") for i in range(9)], "a string, b string")
    start = spark.createDataFrame([("s",)], "id string")
    assert graph.reach(start, edges, 2).count() == 19
    got = {r["id"] for r in graph.reach(start, edges, 2, frontier=3, budget=5).collect()}
    assert got == {"s", "n0", "n1", "n2", "n3", "n4", "m0", "m1", "m2"}


STATUS = "On branch main\nYour branch is up to date\n\nChanges not staged for commit:\n  (use \"git add\" to update)\n\tmodified:   a.kt\n" + "noise\n" * 30
GRADLE = "> Task :compileKotlin UP-TO-DATE\n" * 30 + "> Task :test FAILED\ne: a.kt:1: bad\nBUILD FAILED in 3s"


def test_output_families(spark):
    rows = [(1, STATUS), (2, GRADLE), (3, "short"), (4, "\n".join(f"line {i}" for i in range(50)) + "\nERROR x\n" + "z\n" * 50), (5, None), (6, "diff --git a b\n@@ 1 @@\n+x\n-y\n" + " same\n" * 40), (7, "")]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    fam = outputs.family(docs, "id", "text")
    assert {r["id"]: r["family"] for r in fam.collect()} == {1: "git status", 2: "gradle", 3: "generic", 4: "generic", 5: "generic", 6: "git diff", 7: "generic"}
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("id", (F.col("i") + 1).alias("line"), "text")
    kept = {}
    for r in sorted(outputs.compressed(lines, fam, "id").collect(), key=lambda r: (r["id"], r["line"])):
        kept.setdefault(r["id"], []).append(r["text"])
    assert kept[1] == ["On branch main", "Your branch is up to date", "Changes not staged for commit:", "\tmodified:   a.kt"]
    assert kept[2] == ["> Task :test FAILED", "e: a.kt:1: bad", "BUILD FAILED in 3s"] and kept[3] == ["short"] and kept[6][0] == "diff --git a b" and len(kept[6]) == 4
    assert "ERROR x" in kept[4] and len(kept[4]) == 16
