"""Forests against plain walks."""

import random

import pytest

from tessera.operators import hierarchy
from tessera.operators.hierarchy import Forest, decl_nodes, descendant_pairs, issue_nodes

SCHEMA = "t string, id string, ord bigint, up string"


def walk(parents, n):
    """(root, depth, path), or the circle's least node and -1."""
    path, at = [n], n
    while parents.get(at) in parents:
        at = parents[at]
        if at in path:
            ring = path[path.index(at) :]
            return min(ring, key=int), -1, None
        path.append(at)
    return path[-1], len(path) - 1, path[::-1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_forest(spark, seed):
    r = random.Random(seed)
    n = 220
    parents = {str(i): None if r.random() < 0.1 else str(r.choice([r.randrange(n), max(0, i - 1), 7, n + 5])) for i in range(n)}
    for i in range(20):  # a long chain and a circle with a tail
        parents[str(1000 + i)] = str(1000 + i - 1) if i else None
    parents |= {"2000": "2002", "2001": "2000", "2002": "2001", "2003": "2002", "2004": "2004"}
    f = Forest(spark.createDataFrame([("x", k, int(k), v) for k, v in parents.items()], SCHEMA))
    want = {k: walk(parents, k) for k in parents}
    assert {r["node"]: (r["root"], r["depth"]) for r in f.linked().collect()} == {k: want[k][:2] for k, v in parents.items() if v is not None}
    h = f.hierarchy()
    rows = {r["node"]: r for r in h.collect()}
    assert set(rows) == set(parents)
    below = {k: 0 for k in parents}
    for k, (_, _, path) in want.items():
        for a in (path or [])[:-1]:
            below[a] += 1
    for k, (root, depth, path) in want.items():
        assert (rows[k]["root"], rows[k]["depth"], rows[k]["path"]) == (root, depth, path)
        if depth >= 0:
            assert rows[k]["descendants"] == below[k]
            inside = {x for x, y in rows.items() if y["root"] == root and y["pre"] is not None and rows[k]["pre"] < y["pre"] <= rows[k]["pre"] + below[k]}
            assert inside == {x for x, (_, _, p) in want.items() if p and k in p[:-1]}
    pairs = {(r["ancestor"], r["node"], r["distance"]) for r in descendant_pairs(h).collect()}
    assert pairs == {(a, k, len(p) - 1 - i) for k, (_, _, p) in want.items() if p for i, a in enumerate(p[:-1])}


def test_empty_single_and_star(spark):
    assert Forest(spark.createDataFrame([], SCHEMA)).hierarchy().count() == 0
    one = Forest(spark.createDataFrame([("x", "a", 0, None), ("x", None, 0, "a"), ("y", "a", 0, "zz")], SCHEMA))
    assert {tuple(r) for r in one.linked().collect()} == {("y", "a", "a", 0)}
    star = Forest(spark.createDataFrame([("x", "hub", 0, None), *[("x", f"n{i}", 0, "hub") for i in range(500)]], SCHEMA))
    rows = star.hierarchy().collect()
    assert sorted(r["pre"] for r in rows) == list(range(501)) and max(r["descendants"] for r in rows) == 500


def test_chains_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 4)
    monkeypatch.setattr(hierarchy, "CHILDREN", 2)
    up = {i: i - 1 for i in range(1, 30)} | {100 + i: 5 + i for i in range(12)} | {200: 111, 201: 200}
    rows = Forest(spark.createDataFrame([("x", f"{n:03}", 0, f"{u:03}") for n, u in up.items()] + [("x", "000", 0, None)], SCHEMA)).hierarchy().collect()
    want = lambda n: [f"{n:03}"] if n not in up else [*want(up[n]), f"{n:03}"]
    assert {r["node"]: r["path"] for r in rows} == {f"{n:03}": want(n) for n in [0, *up]}
    assert sorted(r["pre"] for r in rows) == list(range(len(rows)))


def test_issue_and_decl_nodes(spark):
    issues = spark.createDataFrame([("A-1", " a-2 ", 5), ("A-1", None, 4), ("a-2", "", 1), ("B", "Q-1", 1), (None, "A-1", 1)], "id string, parent string, updated bigint")
    assert {(r["node"], r["root"], r["depth"]) for r in Forest(issue_nodes(issues)).linked().collect()} == {("A-1", "a-2", 1), ("B", "B", 0)}
    decls = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 99), (10, 9), (9, 10)], "id bigint, parent_id bigint")
    assert {(r["node"], r["root"], r["depth"]) for r in Forest(decl_nodes(decls)).linked().collect()} == {("2", "1", 1), ("3", "3", 0), ("9", "9", -1), ("10", "9", -1)}
