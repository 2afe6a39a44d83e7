"""Delivery vectors against a plain loop."""

import random

import pyspark.sql.functions as F
import pytest

from tessera.operators import delivery

SCHEMA = "seq bigint, id string, out bigint, _metadata2 string, all bigint, won string"


def expected(rows):
    best = {}
    for seq, i, out, *_ in rows:
        if i:
            key = (-1 if out is None else out, -seq)
            if i not in best or key > best[i][0]:
                best[i] = (key, seq)
    return {r[0] for r in rows if r[1] and best[r[1]][1] != r[0]}


def run(spark, path, rows, files=3):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("overwrite").parquet(path)
    return delivery.delivery_vectors(spark, path, F.col("id"), F.col("out"), F.col("seq"))


@pytest.mark.parametrize("groups", [delivery.GROUP_BYTES, 100])
def test_random_rows(spark, tmp_path, monkeypatch, groups):
    monkeypatch.setattr(delivery, "GROUP_BYTES", groups)
    r = random.Random(3)
    # A third of all rows has one id; ids may be null, empty or differ by a blank only; columns clash with inner names.
    rows = [(n, r.choice(["hot", "hot", "hot", None, "", "x ", "x", *map(str, range(9))]), r.choice([None, 1, 2, 2]), "m", n, "w") for n in range(3000)]
    v = run(spark, str(tmp_path / "a"), rows)
    gone = expected(rows)
    assert {x[0] for x in v.deleted(["seq"]).collect()} == gone
    kept = v.kept()
    assert kept.columns == ["seq", "id", "out", "_metadata2", "all", "won"]
    assert sorted(x[0] for x in kept.collect()) == sorted(n for n in range(3000) if n not in gone)


def test_partitions_and_odd_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delivery, "GROUP_BYTES", 100)
    path = str(tmp_path / "a b%c")
    spark.createDataFrame([(n, f"k{n % 40}", n % 3, "p%d" % (n % 4)) for n in range(200)], "seq bigint, id string, out bigint, part string").write.partitionBy("part").parquet(path)
    v = delivery.delivery_vectors(spark, path, F.col("id"), F.col("out"), F.col("seq"))
    rows = [(r["seq"], r["id"], r["out"]) for r in v.kept().collect()]
    assert len(v.groups) > 1 and len(rows) == 40 == len({r[1] for r in rows}) and v.kept(["part"]).distinct().count() == 4


def test_empty_and_whole_repeats(spark, tmp_path):
    v = run(spark, str(tmp_path / "e"), [])
    assert v.deleted(["seq"]).count() == 0 and v.kept().count() == 0
    v = run(spark, str(tmp_path / "r"), [(1, "a", 1, "", 0, ""), (1, "a", 1, "", 0, ""), (1, "a", 1, "", 0, "")])
    assert v.kept().count() == 1 and v.deleted(["seq"]).count() == 2


def test_long_ids_and_no_ids(spark, tmp_path):
    long = "y" * 100_000
    v = run(spark, str(tmp_path / "l"), [(1, long, None, "", 0, ""), (2, long, 0, "", 0, ""), (3, None, 5, "", 0, ""), (4, "", 5, "", 0, "")])
    assert {r[0] for r in v.deleted(["seq"]).collect()} == {1}
