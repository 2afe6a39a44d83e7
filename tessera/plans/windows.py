"""Windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import tables as op
from tessera.operators.blocks import LEAF_ROWS, ordered_blocks
from tessera.operators.graph import reach
from tessera.plans import base as b
from tessera.plans.joins import _TURNS, turns
from tessera.plans.scans import document_lines
from tessera.session import cut

query = b.Registry()
QUERIES, SQL = query.queries, query.sql
_LINES = "l AS (SELECT doc_id, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i))"


@query("SELECT file_id, start_line, id FROM de QUALIFY row_number() OVER (PARTITION BY file_id, start_line ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'fun' THEN 1 ELSE 2 END, id) = 1")
def w1_first_by_priority(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "fun", 1).otherwise(2)
    return op.latest(b.decls(s, d), ["file_id", "start_line"], [rank, F.asc("id")]).select("file_id", "start_line", "id")


@query("SELECT issue, field, at_ms, added FROM fc WHERE at_ms <= 1755000000000 QUALIFY row_number() OVER (PARTITION BY issue, field ORDER BY at_ms DESC, id DESC) = 1")
def w2_latest_at(s: SparkSession, d: str) -> DataFrame:
    c = b.changes(s, d).filter("at_ms <= 1755000000000").groupBy("issue", "field").agg(F.max(F.struct("at_ms", "id", "added")).alias("x"))
    return c.select("issue", "field", "x.at_ms", "x.added")


@query(f"WITH {_LINES}, h AS (SELECT *, sum(regexp_matches(text, '^#{{1,6}} ')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS sec FROM l) SELECT doc_id, line, sec::BIGINT AS sec, first_value(text) OVER (PARTITION BY doc_id, sec ORDER BY line) AS heading FROM h WHERE sec > 0")
def w3_sections(s: SparkSession, d: str) -> DataFrame:
    run = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = document_lines(s, d).withColumn("sec", F.sum(F.col("text").rlike("^#{1,6} ").cast("bigint")).over(run)).filter("sec > 0")
    return rows.select("doc_id", "line", "sec", F.first("text").over(W.partitionBy("doc_id", "sec").orderBy("line")).alias("heading"))


@query(f"WITH {_LINES}, x AS (SELECT *, CASE WHEN lag(text) OVER w IS NOT DISTINCT FROM text AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM x) SELECT doc_id, min(line) AS line, min(text) AS text, count(*) AS n FROM g GROUP BY doc_id, island")
def w4_folded_lines(s: SparkSession, d: str) -> DataFrame:
    rows = op.islands(document_lines(s, d), ["doc_id"], "line", F.col("text"))
    return rows.groupBy("doc_id", "island").agg(F.min("line").alias("line"), F.min("text").alias("text"), F.count("*").alias("n")).drop("island")


@query(f"WITH {_LINES}, e AS (SELECT doc_id, greatest(line - 2, 1) AS a, line + 4 AS z FROM l WHERE contains(text, 'ERROR')), x AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT doc_id, min(a) AS first_line, max(z) AS last_line FROM g GROUP BY doc_id, k")
def w5_error_windows(s: SparkSession, d: str) -> DataFrame:
    e = document_lines(s, d).filter(F.col("text").contains("ERROR")).select("doc_id", F.greatest(F.col("line") - 2, F.lit(1)).alias("a"), (F.col("line") + 4).alias("z"))
    w = W.partitionBy("doc_id").orderBy("a", "z")
    new = F.when(F.col("a") <= F.max("z").over(w.rowsBetween(W.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    g = e.withColumn("new", new).withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "k").agg(F.min("a").alias("first_line"), F.max("z").alias("last_line")).drop("k")


@query("SELECT seq, greatest(output - coalesce(max(output) OVER (PARTITION BY mid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS delta, CASE WHEN row_number() OVER (PARTITION BY mid ORDER BY seq) = 1 THEN input ELSE 0 END AS input FROM st WHERE mid <> '' AND output IS NOT NULL")
def w6_streamed_deltas(s: SparkSession, d: str) -> DataFrame:
    """The first line of a message counts whole, later ones only what the output grew."""
    w = W.partitionBy("mid").orderBy("seq")
    before = F.coalesce(F.max("output").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.steps(s, d).filter("mid <> '' AND output IS NOT NULL").select("seq", F.greatest(F.col("output") - before, F.lit(0)).alias("delta"), F.when(F.row_number().over(w) == 1, F.col("input")).otherwise(0).alias("input"))


@query(f"WITH {_TURNS} SELECT seq, turn FROM t")
def w7_turns(s: SparkSession, d: str) -> DataFrame:
    return turns(s, d).select("seq", "turn")


@query(f"WITH {_TURNS}, m AS (SELECT *, max(turn) OVER (PARTITION BY session) - turn AS later FROM t) SELECT seq, length(content) * greatest(later, 0) AS carried FROM m WHERE content IS NOT NULL")
def w8_carried(s: SparkSession, d: str) -> DataFrame:
    later = F.max("turn").over(W.partitionBy("session")) - F.col("turn")
    return turns(s, d).withColumn("later", later).filter("content IS NOT NULL").select("seq", (F.char_length("content") * F.greatest("later", F.lit(0))).alias("carried"))


@query("SELECT role, id, cost FROM ru QUALIFY row_number() OVER (PARTITION BY role ORDER BY cost DESC, id) <= 3")
def w9_top_per_group(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).withColumn("r", F.row_number().over(W.partitionBy("role").orderBy(F.desc("cost"), "id"))).filter("r <= 3").select("role", "id", "cost")


@query("SELECT event_type, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) GROUP BY 1", bare=True)
def w10_recent_calls(s: SparkSession, d: str) -> DataFrame:
    return b.events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).groupBy("event_type").agg(F.count("*").alias("n"))


def thinned(rows: DataFrame, group: str, at: str, row: str, gap: int) -> DataFrame:
    """(group, at, row) of the rows a greedy choice takes: the first of each group, then always the first at least `gap` later.

    Each row's next one comes of a range window; the rows that the chains from the first ones pass are then marked by doubling, so a
    group of any length takes a logarithmic number of rounds. Rows without group or place are left out; ties go by `row`.
    """
    one = rows.select(F.col(group).alias("g"), F.col(at).alias("at"), F.col(row).alias("id")).filter("g IS NOT NULL AND at IS NOT NULL")
    first = one.groupBy("g", "at").agg(F.min("id").alias("id"))
    w = W.partitionBy("g").orderBy("at")
    jump = cut(first.withColumn("to", F.min("at").over(w.rangeBetween(gap, W.unboundedFollowing))))
    taken = cut(first.groupBy("g").agg(F.min("at").alias("at")))
    hop = jump.select("g", "at", "to").filter("to IS NOT NULL")
    while not hop.isEmpty():
        taken = cut(taken.unionByName(taken.join(hop, ["g", "at"]).select("g", F.col("to").alias("at"))).distinct())
        hop = cut(hop.join(hop.select("g", F.col("at").alias("to"), F.col("to").alias("far")), ["g", "to"]).select("g", "at", F.col("far").alias("to")))
    return first.join(taken, ["g", "at"]).select(F.col("g").alias(group), F.col("at").alias(at), F.col("id").alias(row))


@query("WITH RECURSIVE e AS (SELECT user_id AS g, floor(epoch(ts))::BIGINT AS at_, min(event_id) AS id FROM events GROUP BY ALL), nx AS (SELECT g, at_, min(at_) OVER (PARTITION BY g ORDER BY at_ RANGE BETWEEN 86400 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e), t AS (SELECT g, min(at_) AS at_ FROM e WHERE g IS NOT NULL GROUP BY 1 UNION SELECT nx.g, nx.nxt FROM t JOIN nx ON nx.g = t.g AND nx.at_ = t.at_ WHERE nxt IS NOT NULL) SELECT e.id AS event_id, e.at_ AS at FROM t JOIN e ON e.g = t.g AND e.at_ = t.at_ QUALIFY row_number() OVER (PARTITION BY e.g ORDER BY e.at_ DESC) <= 240", bare=True)
def w11_downsampled(s: SparkSession, d: str) -> DataFrame:
    """Per user at most one event a day apart from the last one taken, newest 240."""
    e = b.events(s, d).select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    kept = thinned(e, "user_id", "at", "event_id", 86_400)
    return kept.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("at")))).filter("r <= 240").select("event_id", "at")


@query("SELECT session, lower(p) AS path, min(seq) AS seq FROM (SELECT session, seq, unnest(regexp_extract_all(content, '[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java)')) AS p FROM st) GROUP BY ALL")
def w12_first_touch(s: SparkSession, d: str) -> DataFrame:
    p = F.explode(F.regexp_extract_all("content", F.lit(r"[a-z]+/[A-Z][A-Za-z]+\.(?:kt|java)"), 0))
    return b.steps(s, d).select("session", "seq", p.alias("p")).groupBy("session", F.lower("p").alias("path")).agg(F.min("seq").alias("seq"))


@query(f"WITH {_LINES} SELECT doc_id, line, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS nth FROM l WHERE starts_with(text, '- ')")
def w13_occurrences(s: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("doc_id", "text").orderBy("line")).cast("bigint")
    return document_lines(s, d).filter(F.col("text").startswith("- ")).select("doc_id", "line", "text", nth.alias("nth"))


_STATUS = """e AS (SELECT user_id AS k, CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' ELSE 'M' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT k, i, s AS v FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, CASE WHEN c.v = '' THEN e.s WHEN c.v = 'A' AND e.s = 'D' THEN '' WHEN c.v = 'A' THEN 'A' WHEN e.s = 'D' THEN 'D' WHEN c.v = 'D' AND e.s = 'A' THEN 'M' ELSE c.v END FROM c JOIN e ON e.k = c.k AND e.i = c.i + 1)"""


def fold_status(marks: Column, before: str = "") -> Column:
    """The state of ordered marks: added then deleted is gone, deleted then added is modified, the first of the rest stays."""
    step = lambda a, m: F.when(a == "", m).when((a == "A") & (m == "D"), F.lit("")).when(a == "A", a).when(m == "D", m).when((a == "D") & (m == "A"), F.lit("M")).otherwise(a)
    return F.aggregate(marks, F.lit(before), step)


def folded_status(marks: DataFrame, key: str, order: list[str], mark: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, status) after all marks of a key in their order, empty for gone.

    A block of marks is a table from the state before to the state after; tables chain, so a key with very many marks is cut into
    blocks and only their tables meet.
    """
    states = ("", "A", "M", "D")
    blocked, _ = ordered_blocks(marks.select(key, *order, mark), [key], order, leaf_rows)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, mark))), lambda x: x[mark])
    leaves = blocked.groupBy(key, "_block").agg(ordered.alias("x"))
    after = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*[fold_status(F.col("x"), x) for x in states]))
    chain = leaves.select(key, "_block", after.alias("t")).groupBy(key).agg(F.collect_list(F.struct("_block", F.map_entries("t").alias("t"))).alias("b"))
    tables = F.transform(F.array_sort("b"), lambda x: F.map_from_entries(x["t"]))
    return chain.select(key, F.aggregate(tables, F.lit(""), lambda a, t: F.element_at(t, a)).alias("status"))


@query()
def w14_status_fold(s: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").otherwise("M")
    return folded_status(b.events(s, d).select("user_id", "ts", "event_id", mark.alias("m")), "user_id", ["ts", "event_id"], "m").filter("status <> ''")


SQL["w14_status_fold"] = b.PRELUDE + f", {_STATUS} SELECT k AS user_id, v AS status FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1) WHERE v <> ''"


@query(f"WITH {_TURNS}, m AS (SELECT seq, session, length(content) * (max(turn) OVER (PARTITION BY session) - turn + 1) AS w FROM t WHERE content IS NOT NULL) SELECT session, seq, w, len(list_filter([1000, 10000, 100000], lambda x: w >= x)) AS reached FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY w DESC, seq) <= 3")
def w15_heaviest(s: SparkSession, d: str) -> DataFrame:
    rows = turns(s, d).filter("content IS NOT NULL").withColumn("w", F.char_length("content") * (F.max("turn").over(W.partitionBy("session")) - F.col("turn") + 1))
    top = rows.withColumn("r", F.row_number().over(W.partitionBy("session").orderBy(F.desc("w"), "seq"))).filter("r <= 3")
    return top.select("session", "seq", "w", F.size(F.filter(F.array(*map(F.lit, (1000, 10000, 100000))), lambda x: F.col("w") >= x)).cast("bigint").alias("reached"))


ORDER = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789abcdefghijklmnopqrstuvwxyz"  # fixed value: marks, then digits, then letters


def path_key(path: Column) -> Column:
    """A key that sorts paths alike everywhere: marks before digits before letters, letters without case, then shorter, then lower case first."""
    targets = "".join(chr(0x100 + i) for i in range(len(ORDER)))
    return F.struct(F.translate(F.lower(path), ORDER, targets).alias("a"), F.translate(path, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").alias("b"))


_KEY = "translate(lower(path), '" + ORDER.replace("'", "''") + "', '" + "".join(chr(0x100 + i) for i in range(len(ORDER))) + "')"


@query(f"SELECT path, row_number() OVER (ORDER BY {_KEY}, path) AS place FROM (SELECT DISTINCT path FROM f)")
def o1_path_order(s: SparkSession, d: str) -> DataFrame:
    return placed(b.files(s, d).select("path").distinct(), path_key(F.col("path"))).select("path", "place")


def placed(df: DataFrame, order: Column) -> DataFrame:
    """`df` with `place`, from 1, in the whole order: range partitions are numbered by themselves, after the counts of those before."""
    rows = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row to a partition
    ahead = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead") + 1
    return rows.join(F.broadcast(ahead), "_part").withColumn("place", place.cast("bigint")).drop("_id", "_part", "_ahead")


@query("SELECT path, start_line, de.id FROM de JOIN f ON f.id = file_id")
def o2_by_path_and_line(s: SparkSession, d: str) -> DataFrame:
    f = b.files(s, d).select(F.col("id").alias("file_id"), "path")
    return b.decls(s, d).join(f, "file_id").select("path", "start_line", "id").orderBy("path", "start_line", "id")


@query("SELECT id, cost, (SELECT count(*) FROM ru) AS total FROM ru ORDER BY cost DESC, id DESC LIMIT 50 OFFSET 100")
def o3_page(s: SparkSession, d: str) -> DataFrame:
    r = b.runs(s, d).select("id", "cost")
    return r.orderBy(F.desc("cost"), F.desc("id")).offset(100).limit(50).join(r.agg(F.count("*").alias("total")), F.lit(True))


@query("SELECT * FROM (SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 100) ORDER BY event_id", bare=True)
def o4_newest_ascending(s: SparkSession, d: str) -> DataFrame:
    return b.events(s, d).select("event_id", "ts").orderBy(F.desc("event_id")).limit(100).orderBy("event_id")


@query("SELECT id FROM ru ORDER BY start_ms, id LIMIT 20 OFFSET 40")
def o5_offset_cursor(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).orderBy("start_ms", "id").select("id").offset(40).limit(20)


@query("SELECT seq, type FROM st WHERE seq > 500 ORDER BY seq LIMIT 100")
def o6_sequence_cursor(s: SparkSession, d: str) -> DataFrame:
    return b.steps(s, d).filter("seq > 500").select("seq", "type").orderBy("seq").limit(100)


@query("SELECT role, model, count(*) AS n, sum(cost)::BIGINT AS cost FROM ru GROUP BY ALL ORDER BY cost DESC, n DESC, role, model NULLS LAST LIMIT 10")
def o7_ranked_groups(s: SparkSession, d: str) -> DataFrame:
    g = b.runs(s, d).groupBy("role", "model").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    return g.orderBy(F.desc("cost"), F.desc("n"), "role", F.asc_nulls_last("model")).limit(10)


@query("SELECT project, doc_id FROM (SELECT project, doc_id, row_number() OVER w AS r, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS t FROM documents WHERE project IS NOT NULL WINDOW w AS (PARTITION BY project ORDER BY n_chars DESC, doc_id)) WHERE r = 1 OR t <= 20000", bare=True)
def o8_budget_cut(s: SparkSession, d: str) -> DataFrame:
    """Ranked blocks until a budget of characters is used; the first one always."""
    w = W.partitionBy("project").orderBy(F.desc("n_chars"), "doc_id")
    rows = b.documents(s, d).filter("project IS NOT NULL").withColumns({"r": F.row_number().over(w), "t": F.sum("n_chars").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return rows.filter("r = 1 OR t <= 20000").select("project", "doc_id")


@query("SELECT file_id, id FROM de QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY end_line - start_line DESC, id) <= 5")
def o9_nested_top(s: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("file_id").orderBy(F.desc(F.col("end_line") - F.col("start_line")), "id"))
    return b.decls(s, d).withColumn("r", r).filter("r <= 5").select("file_id", "id")


@query("SELECT id, priority_rank FROM iss ORDER BY coalesce(priority_rank, 999), id LIMIT 60")
def o10_priority_order(s: SparkSession, d: str) -> DataFrame:
    return b.issues(s, d).orderBy(F.asc_nulls_last("priority_rank"), "id").limit(60).select("id", "priority_rank")


@query("WITH RECURSIVE r AS (SELECT k AS epic, k AS id FROM iss WHERE k IN (SELECT pk FROM iss) UNION SELECT r.epic, i.k FROM r JOIN iss i ON i.pk = r.id) SELECT epic, id FROM r WHERE epic <> id".replace("WITH RECURSIVE ", "WITH "))
def u3_descendants(s: SparkSession, d: str) -> DataFrame:
    """All that lies below an issue, as a set, whatever circles the links run in."""
    i = b.issues(s, d).select("k", "pk")
    e = i.join(i.select(F.col("k").alias("pk")), "pk", "left_semi").select(F.col("pk").alias("a"), F.col("k").alias("b"))
    return reach(e.select(F.col("a").alias("id")).distinct(), e).filter("start <> id").select(F.col("start").alias("epic"), "id")


@query("SELECT id, 1 AS part FROM ru WHERE role = 'review' UNION ALL SELECT id, 2 FROM ru WHERE cost > 10000")
def u1_union_all(s: SparkSession, d: str) -> DataFrame:
    r = b.runs(s, d)
    return r.filter("role = 'review'").select("id", F.lit(1).alias("part")).unionByName(r.filter("cost > 10000").select("id", F.lit(2).alias("part")))


@query("SELECT name FROM de WHERE kind = 'class' UNION SELECT name FROM de WHERE kind = 'object'")
def u2_union_distinct(s: SparkSession, d: str) -> DataFrame:
    de = b.decls(s, d)
    return de.filter("kind = 'class'").select("name").union(de.filter("kind = 'object'").select("name")).distinct()


@query("WITH x AS (SELECT DISTINCT issue FROM fc) SELECT issue FROM x WHERE issue NOT IN (SELECT id FROM iss)")
def u4_difference(s: SparkSession, d: str) -> DataFrame:
    return b.changes(s, d).select("issue").distinct().subtract(b.issues(s, d).select(F.col("id").alias("issue")))


@query("WITH o AS (SELECT path, hash FROM f WHERE id % 4 <> 0), n AS (SELECT path, CASE WHEN id % 5 = 0 THEN 'x' || hash ELSE hash END AS hash FROM f WHERE id % 6 <> 0) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS mark FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.hash IS DISTINCT FROM n.hash")
def u5_key_difference(s: SparkSession, d: str) -> DataFrame:
    f = b.files(s, d).select("id", "path", "hash")
    new = f.filter("id % 6 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")))
    return op.compared(f.filter("id % 4 <> 0"), new, ["path"], ["hash"])


@query("SELECT k, coalesce(assignee, 'nobody') AS assignee, list_sort(list_distinct(list_concat(coalesce(from_json(json->'tags', '[\"VARCHAR\"]'), []), ['mirror']))) AS tags FROM iss")
def u6_merge_with_precedence(s: SparkSession, d: str) -> DataFrame:
    tags = F.coalesce(F.from_json("json", "tags array<string>").getField("tags"), F.array().cast("array<string>"))
    return b.issues(s, d).select("k", F.coalesce("assignee", F.lit("nobody")).alias("assignee"), F.sort_array(F.array_union(tags, F.array(F.lit("mirror")))).alias("tags"))


@query("SELECT f.path FROM f LEFT JOIN (SELECT path, CASE WHEN id % 8 = 0 THEN NULL ELSE mtime END AS m FROM f WHERE id % 9 <> 0) o ON f.path = o.path WHERE o.m IS DISTINCT FROM f.mtime")
def u7_moved_stamps(s: SparkSession, d: str) -> DataFrame:
    f = b.files(s, d).select("id", "path", "mtime")
    old = f.filter("id % 9 <> 0").withColumn("mtime", F.when(F.col("id") % 8 != 0, F.col("mtime")))
    return op.compared(old, f, ["path"], ["mtime"]).select("path")


@query("SELECT issue, at_ms, kind FROM (SELECT id AS issue, created AS at_ms, 'created' AS kind FROM iss UNION ALL SELECT issue, created, 'comment' FROM co UNION ALL SELECT issue, at_ms, field FROM fc) WHERE at_ms IS NOT NULL ORDER BY at_ms DESC, issue, kind LIMIT 200")
def u8_timeline(s: SparkSession, d: str) -> DataFrame:
    i = b.issues(s, d).select(F.col("id").alias("issue"), F.col("created").alias("at_ms"), F.lit("created").alias("kind"))
    c = b.comments(s, d).select("issue", F.col("created").alias("at_ms"), F.lit("comment").alias("kind"))
    rows = i.unionByName(c).unionByName(b.changes(s, d).select("issue", "at_ms", F.col("field").alias("kind"))).filter("at_ms IS NOT NULL")
    return rows.orderBy(F.desc("at_ms"), "issue", "kind").limit(200)
