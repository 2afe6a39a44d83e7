"""Splitting ordered groups into bounded, ordered blocks, so that no group is ever one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

LEAF_ROWS = 4096


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, bool]:
    """Adds `_block` to `df`: ordered blocks within each group of `keys`; also says whether any group has several.

    A group of at most `leaf_rows` rows is block 0. The rows of larger groups are range-partitioned by key *and* order, so a
    group with a third of all rows is spread over the cluster, and numbered in pieces of `leaf_rows` along that order.
    Rows tying on `order` may fall on either side of a block's end; callers pre-aggregate so that `order` is unique.
    Null keys form groups of their own.
    """
    keyed = df.groupBy(*keys).count()
    hot = cut(keyed.filter(F.col("count") > leaf_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    if hot.isEmpty():
        return df.withColumn("_block", F.lit(0).cast("bigint")), False
    same = None
    for k in keys:
        c = df[k].eqNullSafe(hot[f"_h_{k}"])
        same = c if same is None else same & c
    cold_rows = df.join(hot, same, "left_anti").withColumn("_block", F.lit(0).cast("bigint"))
    hot_rows = df.join(hot, same, "left_semi").repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = cut(hot_rows.withColumn("_block", F.floor(F.monotonically_increasing_id() / leaf_rows).cast("bigint")))
    return cold_rows.unionByName(numbered), True
