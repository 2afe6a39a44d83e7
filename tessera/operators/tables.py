"""Merging, upserting and comparing versions of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut


def overlay(base: DataFrame, over: DataFrame, key: str, deleted: Column) -> DataFrame:
    """The rows of `over` that aren't tombstones, and those of `base` whose key `over` doesn't name, tombstones included.

    Keys are compared exactly; base rows with a null key stay. Both have the same columns. An empty overlay gives the base.
    """
    return over.filter(~F.coalesce(deleted, F.lit(False))).unionByName(base.join(over.select(key).distinct(), key, "left_anti"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`; null keys are a group. The sort is within the key, after a partial cut by Spark."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def newest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the greatest `version` per key by partial aggregation only; ties by the greatest row. Null versions are oldest."""
    rest = [c for c in df.columns if c not in keys and c != version]
    best = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in (version, *rest)]).select(*df.columns)


def add_up(old: DataFrame, new: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Additive upsert: values of equal keys are added."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def fill_only(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Upsert that only fills: an old value stays, a null takes the new one, unknown keys are added. Null keys never meet."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    return both.select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in (*keys, *values)])


def absent(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: the rows of `new` whose key isn't known, one per key."""
    return new.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def reusable(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`new` with `reuse`: whether a known row has the same keys, so that nothing has to be derived again."""
    return new.join(known.select(*keys).distinct().withColumn("_k", F.lit(True)), list(keys), "left").withColumn("reuse", F.coalesce("_k", F.lit(False))).drop("_k")


def retained(df: DataFrame, key: str, at: str, newest: int, since: Column) -> DataFrame:
    """The newest rows per key that are also young enough."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))
    return df.withColumn("_rn", rank).filter((F.col("_rn") <= newest) & (F.col(at) >= since)).drop("_rn")


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, mark) of two keyed versions: added, removed or changed; equal rows, null equal to null, are left out."""
    o, n = old.withColumn("_o", F.lit(1)).alias("o"), new.withColumn("_n", F.lit(1)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    mark = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~same, "changed")
    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], mark.alias("mark")).filter("mark IS NOT NULL")


def narrowest(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, end: str, take: Sequence[str], point: Sequence[str]) -> DataFrame:
    """Each point with the columns `take` of the narrowest range of its group that holds it; null without one.

    Ties go to the range that starts last. Ranges are bucketed by fixed widths of 64 places, so that within a group a point meets
    only ranges of its own bucket; a long range stands in each bucket it covers.
    """
    width = 64
    r = ranges.filter(f"{start} IS NOT NULL AND {end} >= {start}").select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), *[F.col(c).alias(f"_t_{c}") for c in take])
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    p = points.withColumn("_b2", F.floor(F.col(at) / width))
    hit = p.join(r, (p[group] == r["_g"]) & (F.col("_b2") == F.col("_b")) & (F.col(at) >= F.col("_s")) & (F.col(at) <= F.col("_e")), "left")
    size = F.col("_e") - F.col("_s")
    best = F.min_by(F.struct(*[f"_t_{c}" for c in take]), F.struct(F.coalesce(size, F.lit(1 << 62)), -F.col("_s"), *[f"_t_{c}" for c in take])).alias("_x")
    return hit.groupBy(*point).agg(best).select(*point, *[F.col(f"_x._t_{c}").alias(c) for c in take])


def followed(first: DataFrame, then: DataFrame, group: str, at: str, within: int) -> DataFrame:
    """The rows of `first` that a row of `then` with the same group follows after more than 0 and at most `within` units.

    One window over both finds the next follower, so no pairs are made; a group's rows are sorted, never collected.
    """
    a, b = first.withColumn("_f", F.lit(False)), then.select(group, at).distinct().withColumn("_f", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    nxt = F.min(F.when(F.col("_f"), F.col(at))).over(W.partitionBy(group).orderBy(at).rangeBetween(1, within))
    return both.withColumn("_n", nxt).filter("NOT _f AND _n IS NOT NULL").drop("_f", "_n")


def islands(df: DataFrame, groups: Sequence[str], order: str, value: Column) -> DataFrame:
    """Runs of equal neighbouring values: adds `island`, counted from 1 within the group."""
    w = W.partitionBy(*groups).orderBy(order)
    new = (~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("island", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def matched_versions(old: DataFrame, new: DataFrame, group: Sequence[str], same: str, alike: str, at: str) -> DataFrame:
    """(old_id, new_id, mark) of two versions (id, group..., same, alike, at) matched one to one within their groups.

    First rows with equal `same` (mark =), then with equal `alike` (~), each in order of id; of the rest always the two nearest by `at`
    (^), ties to the one that comes first; what is left was added (+) or removed (-). Null group values are values of their own.
    Nearest pairs are found among neighbours along `at`, round by round, so no pairs of a group are listed.
    """
    fix = lambda df: df.select("id", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")).alias(g) for g in group], same, alike, at)
    old, new, found = fix(old), fix(new), []
    for key, mark in ((same, "="), (alike, "~")):
        keys = [*group, key]
        w = W.partitionBy(*keys).orderBy("id")
        number = lambda df, name: df.filter(F.col(key).isNotNull()).withColumn("r", F.row_number().over(w)).select(F.col("id").alias(name), *keys, "r")  # noqa: B023, E731
        m = cut(number(old, "old_id").join(number(new, "new_id"), [*keys, "r"]).select("old_id", "new_id", F.lit(mark).alias("mark")))
        found.append(m)
        old = old.join(m.select(F.col("old_id").alias("id")), "id", "left_anti")
        new = new.join(m.select(F.col("new_id").alias("id")), "id", "left_anti")
    rest = old.select("id", *group, F.col(at).alias("p"), F.lit(0).alias("side")).unionByName(new.select("id", *group, F.col(at).alias("p"), F.lit(1).alias("side")))
    rest = cut(rest)
    while True:
        one = rest.filter("p IS NOT NULL").groupBy(*group, "p", "side").agg(F.min("id").alias("id"))
        w = W.partitionBy(*group).orderBy("p", "side")
        past, coming = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
        other = lambda side, pick, frame: pick(F.when(F.col("side") == side, F.col("p")), ignorenulls=True).over(frame)
        left = F.col("p") - F.when(F.col("side") == 0, other(1, F.last, past)).otherwise(other(0, F.last, past))
        right = F.when(F.col("side") == 0, other(1, F.first, coming)).otherwise(other(0, F.first, coming)) - F.col("p")
        order = one.withColumns({"left": left, "right": right})
        gap = F.when(F.lead("side").over(w) != F.col("side"), F.lead("p").over(w) - F.col("p"))
        order = order.withColumns({"gap": gap, "next": F.lead("id").over(w), "beyond": F.lead("right").over(w)})
        best = order.filter("gap IS NOT NULL AND (left IS NULL OR gap < left) AND (beyond IS NULL OR gap <= beyond)")
        m = cut(best.select(F.when(F.col("side") == 0, F.col("id")).otherwise(F.col("next")).alias("old_id"), F.when(F.col("side") == 0, F.col("next")).otherwise(F.col("id")).alias("new_id"), F.lit("^").alias("mark")))
        if m.isEmpty():
            break
        found.append(m)
        gone = m.select(F.col("old_id").alias("id"), F.lit(0).alias("side")).unionByName(m.select(F.col("new_id").alias("id"), F.lit(1).alias("side")))
        rest = cut(rest.join(gone, ["id", "side"], "left_anti"))
    alone = rest.select(F.when(F.col("side") == 0, F.col("id")).alias("old_id"), F.when(F.col("side") == 1, F.col("id")).alias("new_id"), F.when(F.col("side") == 0, "-").otherwise("+").alias("mark"))
    out = alone
    for m in found:
        out = out.unionByName(m)
    return out
