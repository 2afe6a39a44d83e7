"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import written

ROWS_PER_BUCKET = 20_000


@dataclass
class Network:
    """Min-cost flow by successive cheapest paths; the graphs here have a node per source, pattern and repetition."""

    edges: list[list] = field(default_factory=list)  # to, capacity left, cost; its reverse is the edge with the number xor 1
    out: dict = field(default_factory=dict)

    def add(self, a, b, capacity: int, cost: int = 0) -> int:
        n = len(self.edges)
        self.edges += [[b, capacity, cost], [a, 0, -cost]]
        self.out.setdefault(a, []).append(n)
        self.out.setdefault(b, []).append(n + 1)
        return n

    def run(self, start, end) -> int:
        total = 0
        while True:
            far, via, todo = {start: 0}, {}, [start]
            while todo:
                nxt = []
                for a in todo:
                    for n in self.out.get(a, ()):
                        b, left, cost = self.edges[n]
                        if left > 0 and (b not in far or far[a] + cost < far[b]):
                            far[b], via[b] = far[a] + cost, n
                            nxt.append(b)
                todo = nxt
            if end not in far:
                return total
            push, b = None, end
            while b != start:
                n = via[b]
                push = self.edges[n][1] if push is None else min(push, self.edges[n][1])
                b = self.edges[n ^ 1][0]
            b = end
            while b != start:
                n = via[b]
                self.edges[n][1] -= push
                self.edges[n ^ 1][1] += push
                b = self.edges[n ^ 1][0]
            total += push


def route(patterns: dict[frozenset, int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[tuple[frozenset, str], int]]:
    """Tokens from each pattern of sources to each source's quota, repeating as little as possible: (total, flows).

    A pattern's tokens come in layers: the first use is free, the second costs 1, the third 2, so the cost is convex in the
    repetitions and texts of sources with much to spare are not repeated for others. A text is used at most as often as a source
    allows for that source, and, over all its sources together, at most as often as the most generous of them allows.
    """
    net, ways = Network(), {}
    for p, tokens in patterns.items():
        mine = [s for s in p if s in quotas]
        if not mine or tokens <= 0:
            continue
        for k in range(max(repeats[s] for s in mine)):
            net.add("start", ("p", p), tokens, k)
        for s in mine:
            ways[p, s] = net.add(("p", p), ("s", s), tokens * repeats[s])
    for s, q in quotas.items():
        net.add(("s", s), "end", q)
    total = net.run("start", "end")
    return total, {k: net.edges[n ^ 1][1] for k, n in ways.items() if net.edges[n ^ 1][1]}


def largest_mix(patterns: dict[frozenset, int], shares: dict[str, float], repeats: dict[str, int], limit: int | None = None) -> tuple[dict[str, int], dict]:
    """The greatest total, up to `limit`, of which every source can have its exact share, with its flows.

    Sources without any tokens, or without a share or a repeat, are left out and the shares of the rest are relative to one
    another; the target is reported beside what was reached, so nothing is hidden.
    """
    there = {s for p in patterns for s in p if patterns[p] > 0}
    live = {s: w for s, w in shares.items() if s in there and w > 0 and repeats[s] > 0}
    whole = sum(live.values())
    if not whole:
        return {}, {}
    lo, hi = 0, sum(t * max((repeats[s] for s in p if s in live), default=0) for p, t in patterns.items())
    hi = hi if limit is None else min(hi, limit)
    quotas = lambda total: {s: int(total * w / whole) for s, w in live.items()}
    while lo < hi:
        mid = (lo + hi + 1) // 2
        q = quotas(mid)
        lo, hi = (mid, hi) if route(patterns, q, repeats)[0] == sum(q.values()) else (lo, mid - 1)
    return quotas(lo), route(patterns, quotas(lo), repeats)[1]


def mixed(texts: DataFrame, targets: DataFrame, seed: int = 1, limit: int | None = None) -> DataFrame:
    """(mix_id, source, doc_id, copies, tokens): the documents of each mix with the times each is used for a source.

    `texts` holds (doc_id, key, source, tokens); equal keys are one text, which may belong to several sources. It is used for a
    source at most that source's `max_repeats` times, and in the whole mix at most the greatest of its sources' `max_repeats` times:
    a text of two sources that allow one use each is used once. A text stands in the result under its least doc_id of that source. Texts without
    tokens or source are not used. `targets` holds (mix_id, source, target_share, max_repeats), shares relative within a mix; null
    counts as 0. A source gets its share but for half a text at either end.

    Texts are summed by their pattern of sources, of which there are at most 2^(sources of all mixes) and in practice few; the
    driver sees only these sums. Each source takes an interval of a pattern's tape: the texts in seeded order, laid out again and
    again. A text's place on the tape comes from prefix sums in two steps, over buckets of the seeded order and within them.
    """
    spark = texts.sparkSession
    wanted: dict[int, dict[str, tuple[float, int]]] = {}
    for r in targets.groupBy("mix_id", "source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).collect():
        if r["source"] is not None:
            wanted.setdefault(r["mix_id"], {})[r["source"]] = (float(r["w"] or 0), int(r["m"] or 0))
    used = sorted({s for m in wanted.values() for s in m})
    schema = "mix_id int, source string, doc_id bigint, copies bigint, tokens bigint"
    if not used:
        return spark.createDataFrame([], schema)
    rows = texts.filter((F.col("tokens") > 0) & F.col("source").isin(used))
    # A text in very many copies is combined before the shuffle: its row is (key, source) with its least id.
    one = rows.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    one = one.groupBy("key").agg(F.max("tokens").alias("tokens"), F.map_from_entries(F.collect_set(F.struct("source", "doc_id"))).alias("ids"))
    one = one.withColumn("pattern", F.array_join(F.array_sort(F.map_keys("ids")), "\u0001")).withColumn("h", F.xxhash64(F.lit(seed), "key"))
    one = written(one)
    sums = {r["pattern"]: (r["t"], r["n"]) for r in one.groupBy("pattern").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    patterns = {frozenset(p.split("\u0001")): t for p, (t, _) in sums.items()}
    parts = []
    for mix, t in sorted(wanted.items()):
        repeats = {s: m for s, (_, m) in t.items()}
        _, flows = largest_mix(patterns, {s: w for s, (w, _) in t.items()}, repeats, limit)
        at: dict[frozenset, int] = {}
        for (p, s), f in sorted(flows.items(), key=lambda x: (sorted(x[0][0]), x[0][1])):
            parts.append((int(mix), "\u0001".join(sorted(p)), s, at.get(p, 0), at.get(p, 0) + f, patterns[p]))
            at[p] = at.get(p, 0) + f
    if not parts:
        return spark.createDataFrame([], schema)
    most = max(n for _, n in sums.values())
    buckets = 1 << max(0, (most // ROWS_PER_BUCKET).bit_length())
    bucket = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("bigint")
    placed = one.withColumn("bucket", bucket)
    sub = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("s"))
    base = sub.select("pattern", "bucket", F.coalesce(F.sum("s").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("pattern", "bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("in", inside).join(base, ["pattern", "bucket"]).withColumn("at", F.col("base") + F.col("in") + F.floor(F.col("tokens") / 2))
    # At most mixes x patterns x sources rows.
    takes = spark.createDataFrame(parts, "mix_id int, pattern string, source string, lo bigint, hi bigint, whole bigint")
    both = placed.join(F.broadcast(takes), "pattern")
    # The text's middle is at `at`, at + whole, at + 2 whole, ... ; its copies are those in [lo, hi).
    starts = lambda x: F.greatest(F.ceil((x - F.col("at")) / F.col("whole")).cast("bigint"), F.lit(0).cast("bigint"))
    copies = (starts(F.col("hi")) - starts(F.col("lo"))).cast("bigint")
    return both.withColumn("copies", copies).filter("copies > 0").select("mix_id", "source", F.element_at("ids", F.col("source")).cast("bigint").alias("doc_id"), "copies", F.col("tokens").cast("bigint").alias("tokens"))


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, texts, most_copies): what each source was to have and has."""
    got = mix.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    asked = targets.select("mix_id", "source", F.coalesce("target_share", F.lit(0.0)).alias("w"))
    both = asked.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "texts", "most_copies"])
    mine = W.partitionBy("mix_id")
    return both.select("mix_id", "source", F.round(F.col("w") / F.sum("w").over(mine), 6).alias("target_share"), F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(mine)), 6).alias("actual_share"), "tokens", "texts", "most_copies")
