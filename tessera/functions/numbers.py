"""Numbers as the reports round them."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)


def median(sorted_values: Column) -> Column:
    """Of a sorted array: the middle, or the mean of the two middles rounded half up; null if empty."""
    n = F.size(sorted_values)
    low, high = F.get(sorted_values, F.floor((n - 1) / 2).cast("int")), F.get(sorted_values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, high.cast("double")).otherwise(half_up((low + high) / 2).cast("double")))


def upper_quartile(sorted_values: Column) -> Column:
    """Of a sorted array: the element at min(n - 1, floor(3 n / 4)), counted from 0; null if empty."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.least(n - 1, F.floor(n * 3 / 4)).cast("int")))


def picked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, p75, total) of an integer column by the rules of `median` and `upper_quartile`; nulls don't count.

    Values are counted before they are ranked, so that a hot group is combined before the shuffle and only its distinct values are
    ordered; no group is collected.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    c = c.withColumns({"_upto": F.sum("_n").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    low, high = at(F.floor((F.col("_all") - 1) / 2)), at(F.floor(F.col("_all") / 2))
    mid = F.when(F.max("_all") % 2 == 1, high.cast("double")).otherwise(half_up((low + high) / 2).cast("double"))
    return c.groupBy(*keys).agg(mid.alias("median"), at(F.least(F.col("_all") - 1, F.floor(F.col("_all") * 3 / 4))).alias("p75"), F.sum(F.col("_v") * F.col("_n")).alias("total"))


def exact_tenths(x: Column) -> Column:
    """One decimal, halves up by the exact binary value, so that 1.15 (which is a little less) gives 1.1."""

    @F.pandas_udf("double")
    def exact(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v != v or v in (float("inf"), float("-inf")) else float(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)))

    return exact(x)


def weighted_cost(fresh: Column, write_5m: Column, write_1h: Column, read: Column, output: Column) -> Column:
    """Tokens weighted by what their class costs beside fresh input: 1, 1.25, 2, 0.1 and 5."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(fresh) + zero(write_5m) * 1.25 + zero(write_1h) * 2 + zero(read) * 0.1 + zero(output) * 5
