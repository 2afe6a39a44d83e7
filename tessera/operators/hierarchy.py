"""Trees from parent-child rows: cycle separation, subtree sizes, heavy-path chains, paths and descendant intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut

CHILDREN = 16_384  # of one parent in a bucket, on the mean
BLOCK = 256  # nodes of a chain in a row


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _climb(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over (t, id, ord, up): (t, id, gain), the nodes below each node, and the nodes whose way up never ends.

    A round doubles the distance of each pointer; a node leaves once its pointer passes the root. Of each node the number of
    nodes less than 2^k below it is kept up by adding the counts of the nodes exactly 2^k below. When a round loses no node, none
    of the rest reaches a root, as depths have no holes.
    """
    active = edges.select("t", "id", "ord", F.col("up").alias("ptr"), F.lit(1).cast("bigint").alias("acc"))
    n, rounds = active.count(), []
    while n:
        rounds.append(active.select("t", F.col("ptr").alias("id"), F.col("acc").alias("gain")))
        gain = rounds[-1].groupBy("t", "id").agg(F.sum("gain").alias("gain"))
        jump = active.select("t", F.col("id").alias("ptr"), F.col("ptr").alias("far"))
        active = active.join(jump, ["t", "ptr"]).join(gain, ["t", "id"], "left")
        active = cut(active.select("t", "id", "ord", F.col("far").alias("ptr"), (F.col("acc") + F.coalesce("gain", F.lit(0))).alias("acc")))
        n, was = active.count(), n
        if n == was:
            break
    below = _union(rounds) if rounds else active.select("t", "id", F.col("acc").alias("gain"))
    return below.groupBy("t", "id").agg(F.sum("gain").alias("gain")), active.select("t", "id", "ord", "ptr")


def _circles(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """(t, id, root) of nodes on or under a circle; root is the least id on it, by (ord, id).

    `lost` are these nodes with far pointers. Pointers double until their images stop getting fewer: these are then the circles.
    On them the least id within 2^k steps doubles until it no longer changes.
    """
    hop, images = lost.select("t", "id", "ptr"), -1
    while True:
        n = hop.select("t", "ptr").distinct().count()
        if n == images or not n:
            break
        images = n
        far = hop.select("t", F.col("id").alias("ptr"), F.col("ptr").alias("far"))
        hop = cut(hop.join(far, ["t", "ptr"]).select("t", "id", F.col("far").alias("ptr")))
    if not n:
        return hop.select("t", "id", F.col("ptr").alias("root"))
    ring = hop.select("t", F.col("ptr").alias("id")).distinct()
    walk = cut(edges.join(ring, ["t", "id"]).select("t", "id", F.col("up").alias("ptr"), F.struct("ord", "id").alias("least"), F.lit(True).alias("changed")))
    while not walk.filter("changed").isEmpty():
        far = walk.select("t", F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("least").alias("l2"))
        walk = cut(walk.join(far, ["t", "ptr"]).select("t", "id", F.col("far").alias("ptr"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("changed")))
    roots = walk.select("t", F.col("id").alias("ptr"), F.col("least.id").alias("root"))
    return cut(hop.join(roots, ["t", "ptr"]).select("t", "id", "root"))


def _to_the_top(links: DataFrame, sums: list[str]) -> DataFrame:
    """Pointer doubling over (t, id, ptr, sums...), until each pointer stands on something that is no `id`; the sums add up."""
    state = links.select("t", "id", "ptr", *sums, F.lit(False).alias("end"))
    while True:
        far = state.select("t", F.col("id").alias("ptr"), F.col("ptr").alias("p2"), *[F.col(c).alias(f"{c}_2") for c in sums], F.col("end").alias("end_2"))
        open_, ended = state.filter("NOT end"), state.filter("end")
        step = open_.join(far, ["t", "ptr"], "left").select(
            "t", "id", F.coalesce("p2", "ptr").alias("ptr"), *[(F.col(c) + F.coalesce(f"{c}_2", F.lit(0))).alias(c) for c in sums],
            F.coalesce("end_2", F.lit(True)).alias("end"),
        )
        state = cut(ended.unionByName(step))
        if state.filter("NOT end").isEmpty():
            return state.drop("end")


def _chains(edges: DataFrame, size: DataFrame) -> DataFrame:
    """(t, id, head, pos): each node that continues a chain, with the chain's head and its place in it.

    Of a node's children the one with the largest subtree continues its chain; any way up passes at most log2(n) chains.
    """
    sized = edges.select("t", "id", "up").join(size, ["t", "id"], "left").withColumn("size", F.coalesce("gain", F.lit(0)) + 1)
    heavy = sized.groupBy("t", "up").agg(F.max(F.struct("size", "id")).alias("x"))
    heavy = cut(heavy.select("t", F.col("x.id").alias("id"), F.col("up").alias("ptr"), F.lit(1).cast("bigint").alias("pos")))
    return _to_the_top(heavy, ["pos"]).select("t", "id", F.col("ptr").alias("head"), "pos")


def _prefixed_lights(edges: DataFrame, size: DataFrame, member: DataFrame) -> DataFrame:
    """(t, head, up, before): chain heads below a node, with the sizes of the subtrees visited before them under that node.

    The prefix sums of a node's children go by buckets first, as many as its children need, so a node with very many children is
    not one task's work.
    """
    sized = edges.select("t", "id", "up").join(size, ["t", "id"], "left").withColumn("size", F.coalesce("gain", F.lit(0)) + 1)
    sized = sized.join(member.filter("pos > 0").select("t", "id", F.lit(True).alias("heavy")), ["t", "id"], "left")
    sized = sized.withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    most = edges.groupBy("t", "up").count().agg(F.max("count")).first()[0] or 0
    buckets = 1 << max(0, most // CHILDREN).bit_length()
    sized = cut(sized.withColumn("b", F.when(F.col("heavy"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets))).cast("int")))
    sums = sized.groupBy("t", "up", "b").agg(F.sum("size").alias("s"))
    sums = sums.select("t", "up", "b", F.coalesce(F.sum("s").over(W.partitionBy("t", "up").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("t", "up", "b").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lights = sized.filter("NOT heavy").withColumn("in", inside).join(sums, ["t", "up", "b"])
    return lights.select("t", F.col("id").alias("head"), "up", (F.col("base") + F.col("in")).alias("before"))


class Forest:
    """The hierarchy of `nodes`: (t, id, ord, up), ids unique within a tree set `t`.

    `up` is the written parent or null; parents that are not nodes make their child a root. Nodes on a circle or under one are
    kept apart: depth -1, root the least id on the circle by (ord, id). A self-link is a circle of one. Null ids are left out.
    """

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes = cut(nodes.filter("id IS NOT NULL").select("t", "id", "ord", "up"))
        ids = nodes.select("t", F.col("id").alias("up"))
        edges = cut(nodes.filter("up IS NOT NULL").join(ids, ["t", "up"], "left_semi").select("t", "id", "ord", "up"))
        below, lost = _climb(edges)
        self.circles = _circles(edges, lost)
        gone = lost.select("t", "id")
        self.edges = edges = cut(edges.join(gone, ["t", "id"], "left_anti"))
        self.size = cut(below.join(gone, ["t", "id"], "left_anti"))
        self.member = _chains(edges, self.size)

    def placed(self, intervals: bool = False) -> DataFrame:
        """(t, id, root, depth) of each node that has a parent and reaches a root; with `intervals` also `pre`, its place in pre-order."""
        if intervals:
            lights = _prefixed_lights(self.edges, self.size, self.member)
        else:
            heads = self.edges.join(self.member.select("t", "id"), ["t", "id"], "left_anti")
            lights = heads.select("t", F.col("id").alias("head"), "up", F.lit(0).cast("bigint").alias("before"))
        member = self.member.select("t", F.col("id").alias("up"), F.col("head").alias("above"), F.col("pos").alias("at"))
        # A node above a chain is in a chain itself, or is that chain's head.
        links = lights.join(member, ["t", "up"], "left").select(
            "t", "head", F.coalesce("above", "up").alias("ptr"), (F.coalesce("at", F.lit(0)) + 1).cast("bigint").alias("depth"),
            (F.coalesce("at", F.lit(0)) + 1 + F.col("before")).cast("bigint").alias("pre"),
        )
        chains = _to_the_top(cut(links.withColumnRenamed("head", "id")), ["depth", "pre"]).select("t", F.col("id").alias("head"), F.col("ptr").alias("root"), "depth", "pre")
        heads = chains.select("t", F.col("head").alias("id"), "root", "depth", "pre")
        rest = self.member.join(chains, ["t", "head"], "left").select(
            "t", "id", F.coalesce("root", "head").alias("root"), (F.coalesce("depth", F.lit(0)) + F.col("pos")).alias("depth"), (F.coalesce("pre", F.lit(0)) + F.col("pos")).alias("pre")
        )
        out = heads.unionByName(rest)
        return out if intervals else out.drop("pre")

    def linked(self) -> DataFrame:
        """(t, node, root, depth) of every node that names a parent."""
        up = self.nodes.filter("up IS NOT NULL").select("t", "id")
        known = self.placed().unionByName(self.circles.withColumn("depth", F.lit(-1).cast("bigint")))
        return up.join(known, ["t", "id"], "left").select("t", F.col("id").alias("node"), F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))

    def hierarchy(self) -> DataFrame:
        """(t, node, root, depth, descendants, pre, path): every node. `path` runs from the root to the node, an array; on circles null.

        The descendants of a node are the nodes of its root with `pre` in (pre, pre + descendants].
        """
        known = self.placed(intervals=True).unionByName(self.circles.withColumns({"depth": F.lit(-1).cast("bigint"), "pre": F.lit(None).cast("bigint")}))
        rows = self.nodes.select("t", "id").join(known, ["t", "id"], "left").join(self.size, ["t", "id"], "left").join(self.paths(), ["t", "id"], "left")
        ring = F.coalesce(F.col("depth") < 0, F.lit(False))
        zero = F.lit(0).cast("bigint")
        return rows.select(
            "t", F.col("id").alias("node"), F.coalesce("root", "id").alias("root"), F.coalesce("depth", zero).alias("depth"),
            F.when(~ring, F.coalesce("gain", zero)).alias("descendants"), F.when(~ring, F.coalesce("pre", zero)).alias("pre"),
            F.when(~ring, F.coalesce("path", F.array("id"))).alias("path"),
        )

    def paths(self) -> DataFrame:
        """(t, id, path) of nodes with a parent: the chains' segments, joined from the roots down.

        Chains are cut into blocks of 256 nodes, so that none is one row's work. The rounds number the chains on a way, at most
        log2(n), and the blocks of a long one; a path's length is the result's own.
        """
        heads = self.edges.join(self.member.select("t", "id"), ["t", "id"], "left_anti").select("t", F.col("id").alias("head"), "up")
        first = self.member.select("t", "head").distinct().unionByName(heads.select("t", "head")).distinct()
        nodes = self.member.select("t", "id", "head", "pos").unionByName(first.select("t", F.col("head").alias("id"), "head", F.lit(0).cast("bigint").alias("pos")))
        block = lambda pos: F.floor(F.col(pos) / BLOCK).cast("bigint")
        seg = nodes.groupBy("t", "head", block("pos").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("s"))
        seg = cut(seg.select("t", "head", "block", F.transform("s", lambda x: x["id"]).alias("seg")))
        member = self.member.select("t", F.col("id").alias("up"), F.col("head").alias("above"), F.col("pos").alias("at"))
        down = heads.join(member, ["t", "up"], "left").select("t", "head", F.lit(0).cast("bigint").alias("block"), F.coalesce("above", "up").alias("above"), F.coalesce("at", F.lit(0)).cast("bigint").alias("at"))
        down = down.select("t", "head", "block", "above", block("at").alias("above_block"), (F.col("at") % BLOCK).cast("int").alias("at"))
        along = seg.filter("block > 0").select("t", "head", "block", F.col("head").alias("above"), (F.col("block") - 1).alias("above_block"), F.lit(BLOCK - 1).alias("at"))
        links = cut(seg.join(down.unionByName(along), ["t", "head", "block"]))
        top = seg.filter("block = 0").join(heads.select("t", "head"), ["t", "head"], "left_anti")
        level = cut(top.select("t", "head", "block", F.slice("seg", 1, 0).alias("lead"), "seg"))
        full = []
        while not level.isEmpty():
            full.append(level)
            above = level.select("t", F.col("head").alias("above"), F.col("block").alias("above_block"), "lead", F.col("seg").alias("way"))
            lead = F.concat("lead", F.slice("way", F.lit(1), F.col("at") + 1))
            level = cut(links.join(above, ["t", "above", "above_block"]).select("t", "head", "block", lead.alias("lead"), "seg"))
        if not full:
            return self.edges.select("t", "id", F.array("id").alias("path"))
        rows = _union(full).select("t", "block", "lead", "seg", F.posexplode("seg").alias("i", "id"))
        return rows.filter(F.size("lead") + F.col("i") > 0).select("t", "id", F.concat("lead", F.slice("seg", F.lit(1), F.col("i") + 1)).alias("path"))


def issue_nodes(issues: DataFrame) -> DataFrame:
    """Nodes of `issues.parent`: the version with the greatest `updated` holds; ids meet without case and blanks around them.

    The nodes keep their ids as written in that version; an empty or blank parent is none.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    held = issues.select(bare(F.col("id")).alias("k"), F.struct("updated", "id", "parent").alias("x")).filter("k IS NOT NULL")
    held = held.groupBy("k").agg(F.max("x").alias("x")).select("k", "x.id", bare(F.col("x.parent")).alias("pk"), "x.parent")
    names = held.select(F.col("k").alias("pk"), F.col("id").alias("up"))
    named = F.when(F.col("pk") != "", F.coalesce("up", F.concat(F.lit("\u0000"), "parent")))  # not in the table: a name no node has
    return held.join(names, "pk", "left").select(F.lit("issues").alias("t"), "id", F.lit(0).cast("bigint").alias("ord"), named.alias("up"))


def decl_nodes(decls: DataFrame) -> DataFrame:
    """Nodes of `decls.parent_id`: null or 0 is none; of several rows with an id the one with the greatest parent holds."""
    one = decls.filter("id IS NOT NULL").groupBy("id").agg(F.max("parent_id").alias("p"))
    return one.select(F.lit("decls").alias("t"), F.col("id").cast("string").alias("id"), F.col("id").cast("bigint").alias("ord"), F.when(F.col("p") != 0, F.col("p").cast("string")).alias("up"))


def descendant_pairs(hierarchy: DataFrame) -> DataFrame:
    """(t, ancestor, node, distance): every pair of a node and one above it, from the paths; as many rows as the depths add up to."""
    above = hierarchy.filter("depth > 0").select("t", "node", "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("i", "ancestor"))
    return above.select("t", "ancestor", "node", (F.col("depth") - F.col("i")).cast("bigint").alias("distance"))
