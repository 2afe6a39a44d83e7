"""Small cases of the table, number, filter, search and graph operators."""

import pyspark.sql.functions as F
import pytest
from pyspark.sql import Row

from tessera.functions import numbers, text, words
from tessera.operators import filters, graph, search, tables
from tessera.plans.windows import fold_status, folded_status, path_key


def col(df, name):
    return [r[name] for r in df.collect()]


def test_picked_quantiles(spark):
    df = spark.createDataFrame([([1],), ([1, 2],), ([1, 2, 3, 4],), ([5, 5, 9],), ([],)], "v array<int>")
    out = df.select(numbers.median(F.col("v")).alias("m"), numbers.upper_quartile(F.col("v")).alias("q"))
    assert [(r["m"], r["q"]) for r in out.collect()] == [(1, 1), (2, 2), (3, 4), (5, 9), (None, None)]


def test_rounding(spark):
    df = spark.createDataFrame([(-2.5, 1.15), (2.5, 1.25), (None, None)], "a double, b double")
    assert [(r[0], r[1]) for r in df.select(numbers.half_up(F.col("a")), numbers.exact_tenths(F.col("b"))).collect()] == [(-2, 1.1), (3, 1.3), (None, None)]


def test_stems(spark):
    df = spark.createDataFrame([("HTTPServer2x limits limited limiting",), ("classes foo_bar the of",), (None,), ("",)], "t string")
    assert col(df.select(words.stems(F.col("t")).alias("w")), "w") == [["http", "server", "limit", "limit", "limit"], ["class", "foo", "bar"], [], []]


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("c", 1, False)], "k string, v int, gone boolean")
    over = spark.createDataFrame([("b", 2, False), ("c", 2, True), ("d", 2, None)], base.schema)
    assert {(r["k"], r["v"]) for r in tables.overlay(base, over, "k", F.col("gone")).collect()} == {("a", 1), ("b", 2), ("d", 2)}
    assert tables.overlay(base, over.limit(0), "k", F.col("gone")).count() == 3


def test_narrowest(spark):
    ranges = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("f", 12, 22, "later"), ("g", 1, 5, "other"), ("f", None, 3, "bad")], "f string, s int, e int, n string")
    points = spark.createDataFrame([("f", 15), ("f", 99), ("f", 500), ("h", 1)], "f string, at int")
    out = tables.narrowest(points, ranges, "f", "at", "s", "e", ["n"], ["f", "at"])
    assert {(r["f"], r["at"], r["n"]) for r in out.collect()} == {("f", 15, "later"), ("f", 99, "outer"), ("f", 500, None), ("h", 1, None)}


def test_followed_bounds(spark):
    a = spark.createDataFrame([(1, "r", 0), (2, "r", 1000), (3, "q", 0)], "id int, g string, at bigint")
    z = spark.createDataFrame([("r", 180), ("r", 1000), ("r", 1181), ("q", 0)], "g string, at bigint")
    assert set(col(tables.followed(a, z, "g", "at", 180), "id")) == {1}
    assert set(col(tables.followed(a, z, "g", "at", 181), "id")) == {1, 2}


def test_status_folds(spark):
    df = spark.createDataFrame([(["A", "M"],), (["A", "D"],), (["D", "A"],), (["M", "D"],), ([],)], "m array<string>")
    assert col(df.select(fold_status(F.col("m")).alias("s")), "s") == ["A", "", "M", "D", ""]


@pytest.mark.parametrize("leaf", [1, 3, 4096])
def test_status_over_blocks(spark, leaf):
    import random

    r = random.Random(leaf)
    rows = [(r.choice("hhhk"), i, r.choice("AMMD")) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, m string")
    whole = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).select("k", fold_status(F.col("m")).alias("status"))
    assert {tuple(x) for x in folded_status(df, "k", ["i"], "m", leaf).collect()} == {tuple(x) for x in whole.collect()}


def test_upserts(spark):
    old = spark.createDataFrame([(1, None, 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", 5), (2, "x", 6), (3, "c", 7)], old.schema)
    assert {tuple(r) for r in tables.fill_only(old, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in tables.compared(old, new, ["k"], ["v"]).collect()} == {(1, "changed"), (2, "changed"), (3, "added")}
    assert {tuple(r) for r in tables.add_up(old.select("k", "n"), new.select("k", "n"), ["k"], ["n"]).collect()} == {(1, 6), (2, 8), (3, 7)}
    assert set(col(tables.absent(new.union(new), old, ["k"]), "k")) == {3}


def test_task_filter_and_condition(spark):
    df = spark.createDataFrame([("Open", None, 1, "fix it"), ("Done", "x", 2, "fix"), ("Review", "Minor", None, "other")], "state string, prio string, n int, s string")
    cols = {"state": F.col("state"), "prio": F.col("prio"), "n": F.col("n")}
    where, order = filters.task_filter('state: open, Review prio: -minor fix sort: -n', cols, {}, F.col("s"))
    assert col(df.filter(where).orderBy(*order), "state") == ["Open"]
    with pytest.raises(ValueError):
        filters.task_filter("nope: 1", cols, {}, F.col("s"))
    assert col(df.filter(filters.condition("n>=1 && n!=2 || n==7", cols)), "state") == ["Open"]
    with pytest.raises(ValueError):
        filters.condition("drop table", cols)


def test_commands_and_masks(spark):
    assert text.command_key("cd /x && git log --oneline -n 5 | head") == "git log --oneline -n <arg>"
    assert text.command_key("A=1 ./gradlew test --tests Foo") == "gradlew test --tests <arg>"
    assert text.command_key("cat <<EOF > x") == "heredoc cat" and text.command_key("rg 'unclosed") and text.command_key("") == ""
    df = spark.createDataFrame([("token=abc123 user hunter2 longhunter2",), (None,)], "t string")
    assert col(df.select(text.masked(F.col("t"), ["hunter2", "longhunter2"]).alias("m")), "m") == ["token=*** user *** ***", None]


def test_similar_sets_finds_every_link(spark):
    import random

    r = random.Random(5)
    base = [frozenset(r.sample("abcdefghij", r.randrange(0, 9))) for _ in range(60)]
    rows = [(i, sorted(w)) for i, w in enumerate(base + base[:10])]
    out = {x["k"]: x for x in search.similar_sets(spark.createDataFrame(rows, "k int, w array<string>"), "k", "w", 0.6).collect()}
    sets = {i: frozenset(w) for i, w in rows}
    for i, w in sets.items():
        assert out[i]["rep"] == (min(k for k, v in sets.items() if v == w) if w else i)
        assert out[i]["links"] == len({v for v in sets.values() if w and v != w and len(v & w) / len(v | w) >= 0.6})


def test_similar_sets_pair_only_what_can_be_alike(spark, monkeypatch):
    import random

    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(200):  # all hold the same rare words, but for pairs of neighbours all differ in number or in many words
        ws = ["rare", "odd", *r.sample(words, 20)] if i % 2 == 0 else [*rows[-1][1][:-1], f"x{i}"]
        rows.append((i, ws, str(i // 20) if i % 4 < 2 else None))
    df = spark.createDataFrame(rows, "k int, w array<string>, n string")
    met, whole = [], search.paired
    monkeypatch.setattr(search, "paired", lambda *a: met.append(whole(*a)) or met[-1])
    out = {x["k"]: x["links"] for x in search.similar_sets(df, "k", "w", 0.8, "n").collect()}
    alike = lambda v, w: len(set(v) & set(w)) / len(set(v) | set(w)) >= 0.8
    assert out == {i: sum(1 for j, v, m in rows if j != i and m == n and alike(v, w)) for i, w, n in rows}
    assert sum(out.values()) == 200 and met[0].count() <= 110


def test_page_rank_and_components(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "a", 5.0), ("a", "zz", 1.0)], "a string, b string, w double")
    for focus in (None, nodes.filter("id = 'a'"), nodes.filter("id = 'none'")):
        ranks = {r["id"]: r["rank"] for r in graph.page_rank(nodes, edges, focus).collect()}
        assert abs(sum(ranks.values()) - 1) < 1e-9
    assert graph.page_rank(nodes.limit(0), edges).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a int, b int")
    got = {r["id"]: r["component"] for r in graph.components(spark.range(62).selectExpr("cast(id as int) id"), chain).collect()}
    assert got == {i: i // 20 * 20 if i < 60 else i for i in range(62)}
    r = graph.reach(spark.createDataFrame([(0,)], "id int"), spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "a int, b int"))
    assert {(x["id"], x["depth"]) for x in r.collect()} == {(0, 0), (1, 1), (2, 1)}
    left = graph.settled(spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, 2), (2, 9)], "id int, need int"))
    assert set(col(left, "id")) == {3}


def test_path_order(spark):
    paths = ["b/A.kt", "b/a.kt", "b/_x.kt", "B/a.kt", "b-c/a.kt", "b/1.kt", "b/a.kts"]
    df = spark.createDataFrame([Row(p=p) for p in paths])
    assert col(df.orderBy(path_key(F.col("p"))), "p") == ["b-c/a.kt", "b/_x.kt", "b/1.kt", "b/a.kt", "b/A.kt", "B/a.kt", "b/a.kts"]


def test_thinned(spark):
    import random

    from tessera.plans.windows import thinned

    r = random.Random(4)
    rows = [(r.choice("ab"), r.randrange(3000), i) for i in range(400)] + [("c", 5, 1000), ("c", 5, 999), (None, 1, 1), ("d", None, 2)]
    got = {tuple(x) for x in thinned(spark.createDataFrame(rows, "g string, at bigint, id bigint"), "g", "at", "id", 50).collect()}
    want = set()
    for g in "abc":
        last = None
        for at, i in sorted((a, i) for x, a, i in rows if x == g):
            if last is None or at - last >= 50:
                want.add((g, at, i))
                last = at
    assert got == want and len(want) > 50
    assert thinned(spark.createDataFrame([], "g string, at bigint, id bigint"), "g", "at", "id", 50).count() == 0


def test_rolled_log(spark, tmp_path):
    from tessera.plans.scans import rolled

    (tmp_path / "log.1").write_text('{"n": 1}\n{"n": 2}\n')
    (tmp_path / "log").write_text('{"n": 3, "x": 1}\n{"n": 4')
    assert sorted(x["n"] for x in rolled(spark, [str(tmp_path / p) for p in ("log.1", "log", "log.2")], "n bigint").collect()) == [1, 2, 3]
    assert rolled(spark, [str(tmp_path / "none")], "n bigint").count() == 0


def test_rewrites(spark):
    from pyspark.sql import functions as F

    from tessera.plans.scans import rewrites

    files = spark.createDataFrame([(1, "abcdef"), (2, "abXdef"), (3, "ab"), (4, "abc"), (5, "new"), (6, "")], "id bigint, content string")
    seen = spark.createDataFrame([(1, 3, "abc"), (2, 3, "abc"), (3, 3, "abc"), (4, 3, "abc"), (6, 0, "")], "id bigint, read bigint, was string").select("id", "read", F.sha2("was", 256).alias("mark"))
    assert {r["id"]: r["state"] for r in rewrites(files, seen).collect()} == {1: "grown", 2: "rewritten", 3: "shrunk", 4: "same", 5: "new", 6: "same"}
