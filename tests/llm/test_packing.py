"""Plans and packings: whole, within capacity, and near the least number of containers."""

import random

import pytest

from tessera.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    r = random.Random(seed)
    cap = r.choice([7, 50, 512])
    h = {r.randint(1, cap): r.randint(1, 300) for _ in range(r.randint(1, 40))}
    used, ranks = {}, {}
    for length, rank, n, first, each in packing.plan(h, cap):
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + n
        for i in range(n):
            used[first + i // each] = used.get(first + i // each, 0) + length
    assert ranks == h and max(used.values()) <= cap and sorted(used) == list(range(len(used)))
    least = -(-sum(k * v for k, v in h.items()) // cap)
    assert len(used) <= 11 / 9 * max(least, sum(v for k, v in h.items() if 2 * k > cap)) + 1


ITEMS, PLANS = "doc_id bigint, tokens bigint, plan_id string", "plan_id int, capacity int"


def test_packed(spark):
    r = random.Random(2)
    items = [(i, r.choice([None, 0, 3, 3, 3, 9, 10, 11, 25, r.randint(1, 10)]), "x") for i in range(700)]
    plans = spark.createDataFrame([(1, 10), (2, 64), (2, 64), (3, 0), (4, None)], PLANS)
    placed = packing.packed(spark.createDataFrame(items, ITEMS), plans, "doc_id")
    rows = placed.collect()
    for plan, cap in ((1, 10), (2, 64)):
        mine = [x for x in rows if x["plan_id"] == plan]
        used, whole = {}, {}
        for x in mine:
            used[x["container"]] = used.get(x["container"], 0) + x["tokens"]
            whole.setdefault(x["doc_id"], []).append(x)
        assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
        for i, n, _ in items:
            assert sum(x["tokens"] for x in whole[i]) == (n or 0)
            assert len(whole[i]) == 1 or (n > cap and sorted(x["piece"] for x in whole[i]) == list(range(len(whole[i]))))
    assert {x["plan_id"] for x in rows} == {1, 2}
    assert all(f["free"] >= 0 and f["used"] + f["free"] in (10, 64) for f in packing.fill(placed, plans).collect())


def test_empty(spark):
    plans = spark.createDataFrame([(1, 10)], PLANS)
    assert packing.packed(spark.createDataFrame([], ITEMS), plans, "doc_id").count() == 0
    assert packing.packed(spark.createDataFrame([(1, 5, "")], ITEMS), plans.limit(0), "doc_id").count() == 0
