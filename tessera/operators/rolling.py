"""Totals over trailing periods by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_DAYS = 256


def _shift(a: Column, n: int) -> Column:
    """The array moved `n` places to later positions, filled with 0."""
    zeros = F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros, F.slice(a, F.lit(1), F.size(a) - n))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def rolling_totals(usage: DataFrame, entity: str, day: str, amount: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and day between its first and last day with an amount above 0: own total and total and average of each period.

    Result: `entity`, `day`, `total_own` and, of each period P, `total_P` and `avg_P` (total by P days). Days without rows count as 0;
    null amounts count as 0; rows with a null entity or day are left out; an entity without any amount above 0 gives no rows.

    Rows are summed by entity and day before anything else is shuffled. A calendar is cut into blocks of 256 days, each with the
    days before it that the longest period needs, so an entity's task is bounded whatever its history. Within a block the sums of
    1, 2, 4, 8, ... days are arrays, each the one before plus itself shifted; a period is the sum of the blocks of its binary digits.
    """
    reach = max(periods) - 1
    daily = (
        usage.select(F.col(entity).alias("e"), F.col(day).cast("bigint").alias("d"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("a"))
        .filter("e IS NOT NULL AND d IS NOT NULL").groupBy("e", "d")
        .agg(F.sum("a").alias("a"), F.max(F.col("a") > 0).alias("pos"))
    )
    span = daily.filter("pos").groupBy("e").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    block = lambda c: F.floor(c / BLOCK_DAYS).cast("bigint")
    frames = span.select("e", "lo", "hi", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))).alias("b"))
    # A day belongs to its own block and, as part of the lead-in, to those after it that a period reaches.
    parts = daily.select("e", "d", "a", "pos", F.explode(F.sequence(block(F.col("d")), block(F.col("d") + reach))).alias("b"))
    held = parts.groupBy("e", "b").agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("a", "pos")))).alias("m"))
    first = F.col("b") * BLOCK_DAYS - reach
    days = F.sequence(first, F.col("b") * BLOCK_DAYS + BLOCK_DAYS - 1)
    at = lambda x: F.element_at(F.col("m"), x)
    wide = frames.join(held, ["e", "b"], "left").select(
        "e", "b", "lo", "hi",
        F.transform(days, lambda x: F.coalesce(at(x)["a"], F.lit(0.0))).alias("s1"),
        F.transform(days, lambda x: F.coalesce(at(x)["pos"], F.lit(False))).alias("pos"),
    )
    size = 1
    while size * 2 <= max(periods):
        wide = wide.withColumn(f"s{size * 2}", _plus(F.col(f"s{size}"), _shift(F.col(f"s{size}"), size)))
        size *= 2
    for p in periods:
        total, off, bit = None, 0, size
        while bit:
            if p & bit:
                piece = F.col(f"s{bit}") if not off else _shift(F.col(f"s{bit}"), off)
                total = piece if total is None else _plus(total, piece)
                off += bit
            bit //= 2
        wide = wide.withColumn(f"t{p}", total)
    names = ["s1", "pos", *[f"t{p}" for p in periods]]
    rows = wide.select("e", "lo", "hi", F.posexplode(F.arrays_zip(*names)).alias("i", "x"), first.alias("f"))
    d = (F.col("f") + F.col("i")).alias("day")
    out = [F.col("e").alias(entity), d, F.col("x.s1").alias("total_own"), F.col("x.pos").alias("active")]
    for p in periods:
        out += [F.col(f"x.t{p}").alias(f"total_{p}"), (F.col(f"x.t{p}") / p).alias(f"avg_{p}")]
    inside = (F.col("i") >= reach) & (F.col("f") + F.col("i") >= F.col("lo")) & (F.col("f") + F.col("i") <= F.col("hi"))
    return rows.filter(inside).select(*out)


def project_usage(usage_hours: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, day, cost) of each run hour once; hours of unknown runs and runs without a project are left out.

    (run_id, hour) is the key: of several rows the greatest cost counts. Of several versions of a run the one with most turns.
    """
    hours = usage_hours.groupBy("run_id", "hour").agg(F.max("cost").alias("cost"))
    owner = runs.groupBy("id").agg(F.max_by("project", F.struct("end_ms", "turns", "project")).alias("project"))
    joined = hours.join(owner, hours["run_id"] == owner["id"]).filter("project IS NOT NULL")
    return joined.select("project", F.floor(F.col("hour") / 24).cast("bigint").alias("day"), "cost")


def quiet_days(totals: DataFrame, entity: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """(entity, day, period): days without an amount above 0 whose trailing total is above 0."""
    cases = F.array(*[F.when(F.col(f"total_{p}") > 0, F.lit(p).cast("bigint")) for p in periods])
    return totals.filter("NOT active").select(entity, "day", F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("period"))
