"""Iterative graph operators. Every loop is bounded and cuts its lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut


def page_rank(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, damping: float = 0.85, rounds: int = 40, epsilon: float = 1e-7, every: int = 4) -> DataFrame:
    """(id, rank) of weighted edges (a, b, w) among `nodes` (id); the ranks add up to 1.

    Rank of nodes without edges, and the jump, go to the focus, or to all nodes if there is none (or none is a node). Self-edges,
    edges to other nodes, and weights of 0 or less in sum don't count. Stops when a round moves less than `epsilon` in all. An
    empty graph gives no rows. Contributions are pre-aggregated by target; a round shuffles ranks and edges' shares only.
    """
    nodes = nodes.select("id").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    if focus is not None:
        focus = focus.select("id").distinct().join(nodes, "id", "left_semi")
        focus = None if focus.isEmpty() else focus
    if focus is None:
        base = nodes.withColumn("jump", F.lit(1.0 / n))
    else:
        k = focus.count()
        base = nodes.join(focus.withColumn("f", F.lit(1.0 / k)), "id", "left").select("id", F.coalesce("f", F.lit(0.0)).alias("jump"))
    inside = edges.filter("a <> b").join(nodes.withColumnRenamed("id", "a"), "a", "left_semi").join(nodes.withColumnRenamed("id", "b"), "b", "left_semi")
    inside = inside.groupBy("a", "b").agg(F.sum("w").alias("w"))
    total = inside.groupBy("a").agg(F.sum("w").alias("t")).filter("t > 0")
    # Edges lie by their source for all rounds, so that a round shuffles contributions and, after a cut, ranks.
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = cut(inside.join(total, "a").select("a", "b", (F.col("w") / F.col("t")).alias("s"))).repartition(width, "a").persist()
    base = cut(base.join(total.select(F.col("a").alias("id"), F.lit(True).alias("out")), "id", "left").select("id", "jump", F.coalesce("out", F.lit(False)).alias("out")))
    state = base.withColumn("rank", F.col("jump")).withColumn("moved", F.lit(None).cast("double"))
    for i in range(1, rounds + 1):
        lost = state.filter("NOT out").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = state.join(share, state["id"] == share["a"]).groupBy("b").agg(F.sum(F.col("rank") * F.col("s")).alias("g"))
        rank = damping * F.coalesce("g", F.lit(0.0)) + (damping * F.col("lost") + (1 - damping)) * F.col("jump")
        new = state.join(given, state["id"] == given["b"], "left").join(F.broadcast(lost), F.lit(True))  # one row
        # Each round is cut: the lost rank and the contributions both read the state, so uncut rounds would double the work each time.
        state = cut(new.select("id", "jump", "out", rank.alias("new"), F.abs(rank - F.col("rank")).alias("moved")).withColumnRenamed("new", "rank"))
        if i % every == 0:
            if epsilon and state.agg(F.sum("moved")).first()[0] < epsilon:
                break
    share.unpersist()
    return state.select("id", "rank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): connected components of undirected edges (a, b); a component is named by its least id.

    Each round moves every label to the least of its neighbours' and then to that label's own label, so long chains take a
    logarithmic number of rounds. Labels only; no group is collected.
    """
    both = cut(edges.filter("a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(nodes.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = state.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        state = cut(step.join(jump, "label").select("id", F.col("far").alias("label"), (F.col("far") != F.col("was")).alias("changed")))
        if state.filter("changed").isEmpty():
            return state.select("id", F.col("label").alias("component"))
        state = state.select("id", "label")


def reach(starts: DataFrame, edges: DataFrame, depth: int | None = None, frontier: int | None = None, budget: int | None = None) -> DataFrame:
    """(start, id, depth): what is reached from each start over (a, b), breadth first, each node once at its least depth.

    `frontier` and `budget` are features of budgeted searches: only that many nodes of least id are gone on from in each round of a
    start, and over that many edges, the least first. A column `step` of the edges, if there is one, names the first round in which
    an edge may be taken.
    """
    stepped = "step" in edges.columns
    edges = cut(edges.select("a", "b", *(["step"] if stepped else [])).distinct())
    level = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    seen = cut(level)
    level, i = seen, 0
    while depth is None or i < depth:
        i += 1
        if frontier is not None:
            level = level.withColumn("r", F.row_number().over(W.partitionBy("start").orderBy("id"))).filter(F.col("r") <= frontier).drop("r")
        way = edges.filter(F.col("step") <= i) if stepped else edges
        new = level.select("start", F.col("id").alias("a")).join(way, "a")
        if budget is not None:
            new = new.withColumn("r", F.row_number().over(W.partitionBy("start").orderBy("a", "b"))).filter(F.col("r") <= budget)
        level = cut(new.select("start", F.col("b").alias("id")).distinct().join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(i)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if i % 8 == 0:
            seen = cut(seen)
    return seen


def settled(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """The tasks (id) all of whose needs (id, need) are tasks that remain: others are removed until nothing changes."""
    left = cut(tasks.select("id").distinct())
    n = left.count()
    while True:
        unmet = needs.join(left.withColumnRenamed("id", "need"), "need", "left_anti").select("id").distinct()
        left = cut(left.join(unmet, "id", "left_anti"))
        was, n = n, left.count()
        if n == was:
            return left


def first_of_groups(tasks: DataFrame, needs: DataFrame, take: int) -> DataFrame:
    """(id, place): the first `take` of each group of tasks (id, component, rank, num) in dependency order, then by rank, number and id.

    A place goes to the first task whose needs within the group have theirs, or, on a circle, to the first of all. One round a place;
    no group is collected.
    """
    left, placed = tasks, None
    mine = cut(needs.join(tasks.select("id", "component"), "id").join(tasks.select(F.col("id").alias("need"), F.col("component").alias("c2")), "need").filter("component = c2").select("id", "need").distinct())
    for place in range(1, take + 1):
        open_ = mine if placed is None else mine.join(placed.select(F.col("id").alias("need")), "need", "left_anti")
        rows = left.join(open_.select("id", F.lit(1).alias("waits")).distinct(), "id", "left")
        best = rows.groupBy("component").agg(F.min(F.struct(F.coalesce("waits", F.lit(0)).alias("waits"), F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "num", "id")).alias("x"))
        now = cut(best.select(F.col("x.id").alias("id"), F.lit(place).alias("place")))
        placed = now if placed is None else placed.unionByName(now)
        left = left.join(now, "id", "left_anti")
    return placed
