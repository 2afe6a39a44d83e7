"""Covered periods and gaps of intervals by a sweep over their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.blocks import LEAF_ROWS, ordered_blocks
from tessera.session import cut


def final_runs(runs: DataFrame) -> DataFrame:
    """One row per run id: the version with the greatest end, then most turns; only what intervals need."""
    best = F.max(F.struct("end_ms", "turns", "start_ms", "session")).alias("x")
    return runs.groupBy("id").agg(best).select("id", "x.session", "x.start_ms", "x.end_ms")


def busy_and_gaps(intervals: DataFrame, entity: str, start: str, end: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(entity, state, from_ms, to_ms): the continuous `busy` periods of each entity and the `gap`s between neighbouring ones.

    Touching intervals are continuous; an interval with equal ends is a period of length 0. Intervals with a null entity or bound,
    or an end before their start, do not count. Repeated rows change nothing. An empty table gives no rows.

    Every boundary becomes an event, pre-aggregated by entity and instant. A prefix sum of starts less ends gives the number of
    open intervals; a period opens where it leaves 0 and closes where it is 0 again. An entity with very many instants is cut into
    ordered blocks whose sums are prefixed first, so no entity is one task's work.
    """
    spans = intervals.select(F.col(entity).alias("e"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("t"))
    spans = spans.filter("e IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND t >= s")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = F.explode(F.array(F.struct(F.col("s").alias("at"), one.alias("plus"), none.alias("minus")), F.struct(F.col("t").alias("at"), none.alias("plus"), one.alias("minus"))))
    events = spans.select("e", ends.alias("x")).groupBy("e", F.col("x.at").alias("at")).agg(F.sum("x.plus").alias("plus"), F.sum("x.minus").alias("minus"))
    events, split = ordered_blocks(events, ["e"], ["at"], leaf_rows)
    running = W.partitionBy("e", "_block").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("e").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)

    def carried(df: DataFrame, what: dict) -> DataFrame:
        """Adds, to each row, the sums of all earlier blocks of its entity."""
        if not split:
            return df.withColumns({n: F.lit(0).cast("bigint") for n in what})
        sums = df.groupBy("e", "_block").agg(*[F.sum(c).alias(n) for n, c in what.items()])
        before = sums.select("e", "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("bigint").alias(n) for n in what])
        return df.join(before, ["e", "_block"])

    counted = carried(events, {"base": F.col("plus") - F.col("minus")})
    after = F.col("base") + F.sum(F.col("plus") - F.col("minus")).over(running)
    counted = counted.withColumn("after", after).withColumn("before", F.col("after") - F.col("plus") + F.col("minus"))
    opens, closes = (F.col("before") == 0) & (F.col("plus") > 0), (F.col("after") == 0) & (F.col("minus") > 0)
    marks = counted.select("e", "_block", "at", opens.cast("bigint").alias("opens"), closes.cast("bigint").alias("closes")).filter("opens + closes > 0")
    if split:
        marks = cut(marks)
    marks = carried(marks, {"n0": F.col("opens")})
    k = F.col("n0") + F.sum("opens").over(running)
    marks = marks.withColumn("k", k)
    # The k-th period lies between the k-th opening and closing, the k-th gap between the k-th closing and the next opening.
    sides = F.filter(F.array(
        F.when(F.col("opens") == 1, F.struct(F.lit("busy").alias("state"), F.col("k").alias("k"), F.lit(True).alias("lo"))),
        F.when(F.col("closes") == 1, F.struct(F.lit("busy").alias("state"), F.col("k").alias("k"), F.lit(False).alias("lo"))),
        F.when(F.col("opens") == 1, F.struct(F.lit("gap").alias("state"), (F.col("k") - 1).alias("k"), F.lit(False).alias("lo"))),
        F.when(F.col("closes") == 1, F.struct(F.lit("gap").alias("state"), F.col("k").alias("k"), F.lit(True).alias("lo"))),
    ), lambda x: x.isNotNull())
    rows = marks.select("e", "at", F.explode(sides).alias("x"))
    pairs = rows.groupBy("e", F.col("x.state").alias("state"), F.col("x.k").alias("k")).agg(
        F.max(F.when(F.col("x.lo"), F.col("at"))).alias("from_ms"), F.max(F.when(~F.col("x.lo"), F.col("at"))).alias("to_ms")
    )
    # The first opening ends no gap and the last closing begins none.
    return pairs.filter("from_ms IS NOT NULL AND to_ms IS NOT NULL").select(F.col("e").alias(entity), "state", "from_ms", "to_ms")
