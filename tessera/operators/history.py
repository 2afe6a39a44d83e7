"""Histories of changing attributes by tree-reduction coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import LEAF_ROWS, ordered_blocks
from tessera.session import cut

OPEN = -1


def _tree(units: Column) -> Column:
    """Reduces an ordered array of (f, v) to its runs: neighbours are merged pairwise, in log2(n) rounds."""

    def merge(acc: Column, i: Column) -> Column:
        left, right = F.get(acc, i * 2), F.get(acc, i * 2 + 1)
        same = F.element_at(left, -1)["v"].eqNullSafe(F.get(right, F.lit(0))["v"])
        return F.when(right.isNull(), left).otherwise(F.concat(left, F.slice(right, F.when(same, 2).otherwise(1), F.size(right))))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(units))).cast("int")))
    return F.aggregate(
        rounds,
        F.transform(units, lambda x: F.array(x)),
        lambda acc, _: F.transform(F.sequence(F.lit(0), F.floor((F.size(acc) - 1) / 2).cast("int")), lambda i: merge(acc, i)),
        lambda acc: F.get(acc, F.lit(0)),
    )


def coalesce_versions(versions: DataFrame, entity: list[str], start: str, value: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The maximal runs of equal values per entity: `entity`, `value`, `valid_from`, `valid_to` (-1: still valid).

    `versions` holds one row per entity and `start`, a bigint; a version holds until the next one starts. Null equals null, as a
    value and as an entity. Every version is a unit interval; intervals of a block of at most `leaf_rows` are merged pairwise over
    logarithmic rounds, and so are, for entities of more blocks, the blocks: each round carries only a block's first and last run
    and emits the runs that became complete. An empty table gives no rows.
    """
    v = versions.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(entity)], F.col(start).cast("bigint").alias("f"), F.col(value).alias("v"))
    keys = [f"k{i}" for i in range(len(entity))]
    blocked, split = ordered_blocks(v, keys, ["f"], leaf_rows)
    leaves = blocked.groupBy(*keys, "_block").agg(_tree(F.sort_array(F.collect_list(F.struct("f", "v")))).alias("runs"))

    def to_rows(df: DataFrame, last_to: Column) -> DataFrame:
        n = F.size("runs")
        spans = F.transform("runs", lambda x, i: F.struct(x["f"].alias("f"), x["v"].alias("v"), F.when(i + 1 < n, F.get(F.col("runs"), i + 1)["f"]).otherwise(last_to).alias("t")))
        return df.select(*keys, F.explode(spans).alias("r")).select(*keys, "r.v", "r.f", "r.t")

    if not split:
        done = to_rows(leaves, F.lit(OPEN).cast("bigint"))
    else:
        leaves = cut(leaves)
        many = leaves.groupBy(*keys).agg(F.count("*").alias("blocks")).filter("blocks > 1")
        same = None
        for k in keys:
            c = leaves[k].eqNullSafe(many[k])
            same = c if same is None else same & c
        done = to_rows(leaves.join(many, same, "left_anti"), F.lit(OPEN).cast("bigint"))
        done = done.unionByName(_merge_blocks(leaves.join(many, same, "left_semi"), keys))
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(entity)], F.col("v").alias(value), F.col("f").alias("valid_from"), F.col("t").alias("valid_to"))


def _merge_blocks(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise rounds over the blocks of the large entities; a block's state is its first and last run and how many runs it has."""
    from pyspark.sql import Window as W

    runs, n = F.col("runs"), F.size("runs")
    spans = F.transform(runs, lambda x, i: F.struct(x["f"].alias("f"), x["v"].alias("v"), F.get(runs, i + 1)["f"].alias("t")))
    # Runs inside a block, neither first nor last, are complete at once.
    inner = leaves.filter(n > 2).select(*keys, F.explode(F.slice(spans, F.lit(2), n - 2)).alias("r")).select(*keys, "r.v", "r.f", "r.t")
    # The summary has one row per block of thousands of versions, so numbering them is light even for the largest entity.
    state = leaves.select(
        *keys, (F.row_number().over(W.partitionBy(*keys).orderBy("_block")) - 1).cast("bigint").alias("i"), (n == 1).alias("one"),
        F.get(runs, F.lit(0)).alias("a"), F.get(runs, F.lit(1))["f"].alias("a_to"), F.element_at(runs, -1).alias("z"),
    )
    state, out = cut(state), [inner]
    rounds = max(1, int(state.agg(F.max("i")).first()[0] or 0).bit_length())
    for _ in range(rounds):
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.struct("one", "a", "a_to", "z")))
        pair = state.groupBy(*keys, F.floor(F.col("i") / 2).cast("bigint").alias("i")).agg(side(0).alias("l"), side(1).alias("r"))
        alone, eq = F.col("r").isNull(), F.col("l.z.v").eqNullSafe(F.col("r.a.v"))
        l1, r1 = F.col("l.one"), F.col("r.one")
        run = lambda s, t: F.struct(F.col(f"{s}.v").alias("v"), F.col(f"{s}.f").alias("f"), t.alias("t"))
        joint_to, border = F.col("r.a_to"), F.col("r.a.f")
        # What is complete: the left's last run (joined with the right's first one or not), and a right first run that no longer is one.
        closed = F.filter(F.array(
            F.when(~alone & eq & ~l1 & ~r1, run("l.z", joint_to)),
            F.when(~alone & ~eq & ~l1, run("l.z", border)),
            F.when(~alone & ~eq & ~r1, run("r.a", joint_to)),
        ), lambda x: x.isNotNull())
        new = pair.select(
            *keys, "i", closed.alias("closed"),
            F.when(alone, l1).otherwise(eq & l1 & r1).alias("one"),
            F.col("l.a").alias("a"),
            F.when(alone | ~l1, F.col("l.a_to")).when(eq, joint_to).otherwise(border).alias("a_to"),
            F.when(alone | (eq & r1), F.col("l.z")).otherwise(F.col("r.z")).alias("z"),
        )
        new = cut(new)
        out.append(new.select(*keys, F.explode("closed").alias("r")).select(*keys, "r.v", "r.f", "r.t"))
        state = new.drop("closed")
    ends = F.filter(F.array(
        F.when(~F.col("one"), F.struct(F.col("a.v").alias("v"), F.col("a.f").alias("f"), F.col("a_to").alias("t"))),
        F.struct(F.col("z.v").alias("v"), F.col("z.f").alias("f"), F.lit(OPEN).cast("bigint").alias("t")),
    ), lambda x: x.isNotNull())
    out.append(state.select(*keys, F.explode(ends).alias("r")).select(*keys, "r.v", "r.f", "r.t"))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def field_history(changes: DataFrame, issues: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(issue, field, value, valid_from, valid_to) from field changes and the entities' creation times.

    `field` is compared in lower case. Of changes with the same issue, field and `at` the one with the greatest id stands. Its
    `added` holds from `at`. Before the first change (smallest `at`, then id) its `removed` holds from the issue's `created`, if
    that is known and earlier. Issue ids are compared without case and white space around them, and come out in the least of the
    spellings that the changes have for them. Changes with null issue, field or `at` are left out. Rows repeated whole count once.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    ch = changes.select("id", F.col("issue").alias("written"), bare("issue").alias("k"), F.lower("field").alias("field"), F.col("at").cast("bigint").alias("at"), "removed", "added")
    ch = ch.filter("k IS NOT NULL AND field IS NOT NULL AND at IS NOT NULL")
    named = F.min("written").alias("issue")
    stands = cut(ch.groupBy("k", "field", "at").agg(F.max(F.struct("id", "added")).alias("x"), F.min(F.struct("id", "removed")).alias("y"), named))
    firsts = stands.groupBy("k", "field").agg(F.min(F.struct("at", "y")).alias("first"), F.min("issue").alias("issue"))
    made = issues.select(bare("id").alias("k"), F.col("created").cast("bigint").alias("created"), F.col("updated").alias("u"))
    made = made.filter("k IS NOT NULL").groupBy("k").agg(F.max(F.struct("u", "created")).alias("m")).select("k", "m.created")
    before = firsts.join(made, "k").filter(F.col("created") < F.col("first.at")).select(
        "k", "field", F.col("created").alias("f"), F.col("first.y.removed").alias("value")
    )
    versions = stands.select("k", "field", F.col("at").alias("f"), F.col("x.added").alias("value")).unionByName(before)
    names = firsts.select("k", "field", "issue")
    runs = coalesce_versions(versions, ["k", "field"], "f", "value", leaf_rows)
    return runs.join(names, ["k", "field"]).select("issue", "field", "value", "valid_from", "valid_to")
