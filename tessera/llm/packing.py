"""Filling containers of fixed capacity: planning on the histogram of lengths, then handing out the planned slots."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import written

ROWS_PER_BUCKET = 20_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: rows (length, first rank, items, first container, items per container).

    Items of one length are alike, so they are placed by the run: containers with equal room left are one group, and a length takes
    the group with the least room that still holds it, as many items to a container as fit. The plan has at most a few rows per
    length and group, whatever the number of items. Lengths lie between 1 and the capacity.
    """
    rooms: list[int] = []  # the rooms left that occur, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: runs of containers (first, number)
    out, used = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                out.append((length, rank, whole * each, first, each))
                put(room - each * length, first, whole)
                rank += whole * each
                left -= whole * each
            if left and whole < n:  # the rest of the items opens one more of these containers
                out.append((length, rank, left, first + whole, left))
                put(room - left * length, first + whole, 1)
                whole += 1
                left = 0
            put(room, first + whole, n - whole)
    return out


def packed(sizes: DataFrame, capacities: DataFrame, row_id: str) -> DataFrame:
    """(plan_id, container, item, piece, tokens): where each item of `sizes` (row_id, tokens) lies, for each (plan_id, capacity).

    Only an item longer than the capacity is divided: into full pieces, that fill a container each, and a rest. Items without
    tokens take no room: they lie in container 0. Capacities below 1 or null give no rows; repeated rows of an item id are packed
    as often as they occur. Containers are numbered from 0 within a plan.

    The driver sees the histogram of lengths only, at most `capacity` counts; full pieces are planned by arithmetic. Items take
    the planned slots by their rank within their length; the ranks go by hashed buckets, as many as the items need, so no length is one task's work.
    """
    spark = sizes.sparkSession
    plans = [(r["plan_id"], r["capacity"]) for r in capacities.select("plan_id", "capacity").distinct().collect() if r["capacity"] and r["capacity"] > 0]
    items = written(sizes.select(F.col(row_id).alias("item"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")))
    caps = F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in plans]) if plans else F.expr("cast(array() as array<struct<plan_id:int,capacity:bigint>>)")
    each = items.select("item", "tokens", F.explode(caps).alias("p")).select("item", "tokens", "p.*")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    rest = each.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    buckets = 1 << (items.count() // ROWS_PER_BUCKET).bit_length()  # so many that no length, be it that of all items, is one task's work
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    counts = written(rest.groupBy("plan_id", "rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full")))
    histogram: dict[int, dict[int, int]] = {p: {} for p, _ in plans}
    for r in counts.filter("rest > 0").groupBy("plan_id", "rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["plan_id"]][r["rest"]] = r["n"]
    tables = {}
    for p, c in plans:
        rows = sorted(plan(histogram[p], c))
        cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        # (length, rank) as one ascending key, so that a slot is one binary search
        tables[p] = (cols[0], cols[1], cols[3], cols[4], int(max((r[3] + -(-r[2] // r[4]) for r in rows), default=0)))
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("bigint")
    def slot(plan_id: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(plan_id), dtype=np.int64)
        ids, lengths, ranks = plan_id.to_numpy(), length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        for p in np.unique(ids):
            at = (ids == p) & (lengths > 0)
            if not at.any():
                continue
            key, base, first, per, _ = shared.value[p]
            wide = int(base.max()) + int(ranks.max()) + 2
            # Python integers would be slow; lengths are at most a capacity, so the product stays far below 2^63.
            i = np.searchsorted(key * wide + base, lengths[at] * wide + ranks[at], side="right") - 1
            out[at] = first[i] + (ranks[at] - base[i]) // per[i]
        return pd.Series(out)

    # Within (plan, length) the buckets follow one another; within a bucket the items are numbered.
    order = W.partitionBy("plan_id", "rest").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("plan_id", "rest", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    ranked = rest.filter("rest > 0").withColumn("r", F.row_number().over(W.partitionBy("plan_id", "rest", "bucket").orderBy("item")) - 1)
    ranked = ranked.join(bases, ["plan_id", "rest", "bucket"])
    opened = {p: t[4] for p, t in tables.items()}
    empty = rest.filter("tokens = 0").select("plan_id", F.lit(0).cast("bigint").alias("container"), "item", F.col("full").alias("piece"), F.col("rest").alias("tokens"))
    last = ranked.select("plan_id", slot("plan_id", "rest", (F.col("base") + F.col("r")).cast("bigint")).alias("container"), "item", F.col("full").alias("piece"), F.col("rest").alias("tokens"))
    # Full pieces come behind the planned containers, numbered in the same two steps.
    big = rest.filter("full > 0")
    sums = counts.filter("full > 0").groupBy("plan_id", "bucket").agg(F.sum("full").alias("full"))
    before = W.partitionBy("plan_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("plan_id", "bucket", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("full").over(W.partitionBy("plan_id", "bucket").orderBy("item", "rest").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in opened.items() for x in pair]), F.col("plan_id").cast("bigint")), F.lit(0)) if opened else F.lit(0)
    pieces = big.withColumn("in", inside).join(starts, ["plan_id", "bucket"]).select("plan_id", "capacity", "item", (shift + F.col("base") + F.col("in")).alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    pieces = pieces.select("plan_id", (F.col("start") + F.col("piece")).cast("bigint").alias("container"), "item", "piece", F.col("capacity").alias("tokens"))
    return last.unionByName(empty).unionByName(pieces).withColumnRenamed("item", row_id)


def fill(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(plan_id, container, items, used, free) of each container."""
    held = placed.groupBy("plan_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))
    caps = capacities.select("plan_id", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    return held.join(caps, "plan_id").select("plan_id", "container", "items", "used", (F.col("capacity") - F.col("used")).alias("free"))
