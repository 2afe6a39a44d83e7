"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import tables as op
from tessera.plans import base as b

query = b.Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT f.id, count(de.id) AS n FROM f JOIN de ON f.id = de.file_id GROUP BY 1")
def j1_child_to_file(s: SparkSession, d: str) -> DataFrame:
    return b.decls(s, d).join(b.files(s, d).select(F.col("id").alias("file_id")), "file_id").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT project, role, count(*) AS n, round(sum(uh.cost), 6) AS cost FROM uh JOIN ru ON run_id = id GROUP BY ALL")
def j2_fact_to_dimension(s: SparkSession, d: str) -> DataFrame:
    r = b.runs(s, d).select(F.col("id").alias("run_id"), "project", "role")
    return b.hours(s, d).join(r, "run_id").groupBy("project", "role").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT c.id, c.parent AS blocker, CASE WHEN p.k IS NULL THEN '?' ELSE '' END AS mark FROM iss c LEFT JOIN iss p ON c.pk = p.k WHERE c.pk IS NOT NULL AND p.resolved IS NULL")
def j3_marked_outer(s: SparkSession, d: str) -> DataFrame:
    i = b.issues(s, d)
    p = i.select(F.col("k").alias("pk"), F.col("resolved").alias("done"), F.lit(True).alias("there"))
    joined = i.filter("pk IS NOT NULL").join(p, "pk", "left").filter("done IS NULL")
    return joined.select("id", F.col("parent").alias("blocker"), F.when(F.col("there").isNull(), "?").otherwise("").alias("mark"))


@query("WITH h AS (SELECT id AS file_id, line FROM ln WHERE contains(text, 'println')), x AS (SELECT h.file_id, h.line, de.fqn, de.kind, row_number() OVER (PARTITION BY h.file_id, h.line ORDER BY end_line - start_line NULLS LAST, start_line DESC, fqn) AS rn FROM h LEFT JOIN de ON de.file_id = h.file_id AND h.line BETWEEN start_line AND end_line) SELECT file_id, line, fqn, kind FROM x WHERE rn = 1")
def j4_narrowest_range(s: SparkSession, d: str) -> DataFrame:
    hits = b.lines(s, d).filter(F.col("text").contains("println")).select(F.col("id").alias("file_id"), "line")
    return op.narrowest(hits, b.decls(s, d), "file_id", "line", "start_line", "end_line", ["fqn", "kind"], ["file_id", "line"])


@query("SELECT id FROM co WHERE issue IN (SELECT id FROM iss WHERE state = 'Blocked')")
def j6_semi(s: SparkSession, d: str) -> DataFrame:
    return b.comments(s, d).join(b.issues(s, d).filter("state = 'Blocked'").select(F.col("id").alias("issue")), "issue", "left_semi").select("id")


@query("SELECT id FROM iss WHERE k NOT IN (SELECT pk FROM iss WHERE pk IS NOT NULL)")
def j7_leaves(s: SparkSession, d: str) -> DataFrame:
    i = b.issues(s, d)
    return i.join(i.select(F.col("pk").alias("k")), "k", "left_anti").select("id")


@query("SELECT id FROM iss WHERE EXISTS (SELECT 1 FROM fc WHERE fc.issue = iss.id AND field = 'priority' AND added = 'Critical')")
def j8_exists(s: SparkSession, d: str) -> DataFrame:
    c = b.changes(s, d).filter("field = 'priority' AND added = 'Critical'").select(F.col("issue").alias("id"))
    return b.issues(s, d).join(c, "id", "left_semi").select("id")


@query("SELECT model, max(start_ms) AS start_ms, count(*) AS n FROM ru WHERE start_ms = (SELECT max(start_ms) FROM ru r WHERE r.model IS NOT DISTINCT FROM ru.model) GROUP BY model")
def j9_null_safe_latest(s: SparkSession, d: str) -> DataFrame:
    r = b.runs(s, d).select("id", "model", "start_ms")
    top = r.groupBy(F.col("model").alias("m")).agg(F.max("start_ms").alias("last"))
    hit = r.join(top, r["model"].eqNullSafe(top["m"]) & (r["start_ms"] == top["last"]))
    return hit.groupBy("model").agg(F.max("start_ms").alias("start_ms"), F.count("*").alias("n"))


@query("SELECT seq, ru.role FROM st LEFT JOIN (SELECT session, min(role) AS role FROM ru GROUP BY 1) ru USING (session)")
def j10_natural_key(s: SparkSession, d: str) -> DataFrame:
    r = b.runs(s, d).groupBy("session").agg(F.min("role").alias("role"))
    return b.steps(s, d).select("seq", "session").join(r, "session", "left").select("seq", "role")


@query("SELECT event_id FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id = a.user_id AND epoch_us(c.ts) > epoch_us(a.ts) AND epoch_us(c.ts) <= epoch_us(a.ts) + 86400000000)", bare=True)
def j11_follows_within(s: SparkSession, d: str) -> DataFrame:
    e = b.events(s, d).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return op.followed(e.filter("event_type = 'view'").select("event_id", "user_id", "at"), e.filter("event_type = 'purchase'"), "user_id", "at", 86_400_000_000).select("event_id")


_TURNS = "t AS (SELECT seq, session, type, content, count(DISTINCT mid) FILTER (mid <> '') OVER (PARTITION BY session ORDER BY seq) AS turn FROM st)"


def turns(s: SparkSession, d: str) -> DataFrame:
    """Steps with their turn: the number of distinct messages so far."""
    rows = b.steps(s, d)
    first = F.when(F.col("mid").isNotNull() & (F.col("mid") != ""), F.row_number().over(W.partitionBy("session", "mid").orderBy("seq")))
    return rows.withColumn("new", (F.coalesce(first, F.lit(0)) == 1).cast("bigint")).withColumn("turn", F.sum("new").over(W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


_WORD = "[A-Z][a-z]+[A-Z][A-Za-z]+"


@query(f"WITH {_TURNS}, c AS (SELECT *, regexp_extract(content, '{_WORD}') AS token FROM t WHERE type = 'user'), n AS (SELECT c.seq, min(n.seq) AS next_seq FROM c JOIN t n ON n.session = c.session AND n.seq > c.seq AND n.turn <= c.turn + 2 AND c.token <> '' AND list_contains(regexp_extract_all(n.content, '{_WORD}'), c.token) GROUP BY 1) SELECT seq, next_seq FROM n")
def j12_next_mention(s: SparkSession, d: str) -> DataFrame:
    """Of each question the first later step, at most two turns on, that names the same symbol: an equi join on session and symbol."""
    t = turns(s, d).select("seq", "session", "type", "turn", "content")
    call = t.filter("type = 'user'").select("session", F.col("seq").alias("c"), F.col("turn").alias("ct"), F.regexp_extract("content", _WORD, 0).alias("token")).filter("token <> ''")
    named = t.select("session", "seq", "turn", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_WORD), 0))).alias("token"))
    hit = call.join(named, ["session", "token"]).filter("seq > c AND turn <= ct + 2")
    return hit.groupBy(F.col("c").alias("seq")).agg(F.min("seq").alias("next_seq"))


@query("SELECT c.id, iss.id AS issue FROM co c JOIN iss ON iss.id = c.issue WHERE regexp_matches(c.text, '(^|[^A-Za-z0-9_])' || iss.project || '-[0-9]+($|[^A-Za-z0-9_])')")
def j13_boundary_mention(s: SparkSession, d: str) -> DataFrame:
    i = b.issues(s, d).select(F.col("id").alias("issue"), "project")
    j = b.comments(s, d).join(i, "issue")
    return j.filter(F.expr("text RLIKE concat('(^|[^A-Za-z0-9_])', project, '-[0-9]+($|[^A-Za-z0-9_])')")).select("id", "issue")


_EDGES = """r AS (SELECT id AS file_id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9]*)\\b', 1)) AS name FROM ln), n AS (SELECT file_id, name, count(*) AS c FROM r GROUP BY ALL),
ety AS (SELECT DISTINCT name, file_id AS target FROM de WHERE kind IN ('class', 'interface', 'object', 'enum')), fan AS (SELECT name, count(*) AS k FROM ety GROUP BY 1),
ed AS (SELECT n.file_id AS a, ety.target AS b, sum(sqrt(c) / k) AS w FROM n JOIN ety USING (name) JOIN fan USING (name) WHERE n.file_id <> ety.target GROUP BY ALL)"""


_NAME = r"\b([A-Z][A-Za-z0-9]*)\b"


def used_names(s: SparkSession, d: str) -> DataFrame:
    """(a, name): file a has the capitalised name, each once. Names don't go over line ends, so contents needn't be cut into lines."""
    rows = b.files(s, d).filter("content IS NOT NULL")
    return rows.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_NAME), 1))).alias("name"))


def type_files(s: SparkSession, d: str) -> DataFrame:
    """(name, b): file b declares a type of that name."""
    return b.decls(s, d).filter("kind IN ('class', 'interface', 'object', 'enum')").select("name", F.col("file_id").alias("b")).distinct()


def reference_edges(s: SparkSession, d: str) -> DataFrame:
    """(a, b, w): file a names types of file b; the root of the count, shared by the files that declare the name."""
    refs = b.lines(s, d).select(F.col("id").alias("a"), F.explode(F.regexp_extract_all("text", F.lit(_NAME), 1)).alias("name"))
    counts = refs.groupBy("a", "name").agg(F.count("*").alias("c"))
    types = type_files(s, d)
    shared = types.join(types.groupBy("name").agg(F.count("*").alias("k")), "name")
    return counts.join(shared, "name").filter("a <> b").groupBy("a", "b").agg(F.sum(F.sqrt("c") / F.col("k")).alias("w"))


@query(f"WITH {_EDGES} SELECT a, b, round(w, 6) AS w FROM ed")
def j14_name_references(s: SparkSession, d: str) -> DataFrame:
    return reference_edges(s, d).withColumn("w", F.round("w", 6))


_LINKS = "lk AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z]{2,4}-[0-9]+')) AS task FROM documents), fl AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java|md)')) AS path FROM documents)"


def document_tasks(s: SparkSession, d: str) -> DataFrame:
    return b.documents(s, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,4}-[0-9]+"), 0))).alias("task"))


def document_files(s: SparkSession, d: str) -> DataFrame:
    return b.documents(s, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z]+/[A-Z][A-Za-z]+\.(?:kt|java|md)"), 0))).alias("path"))


def landed(s: SparkSession, d: str) -> DataFrame:
    """(path, task, at): the tasks that the 40 newest commits on a path name, and when the last of these was."""
    docs = b.documents(s, d).filter("source = 'commit_messages'").select("doc_id", "created")
    at = document_files(s, d).join(docs, "doc_id")
    newest = at.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc_nulls_last("created"), "doc_id"))).filter("r <= 40")
    return newest.join(document_tasks(s, d), "doc_id").groupBy("path", "task").agg(F.max("created").alias("at"))


@query(f"WITH {_LINKS} SELECT task, path, count(*) AS n FROM lk JOIN fl USING (doc_id) GROUP BY ALL")
def j15_bridge(s: SparkSession, d: str) -> DataFrame:
    return document_tasks(s, d).join(document_files(s, d), "doc_id").groupBy("task", "path").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT id, 'main/.../' || regexp_extract(path, '[^/]*$') AS elided FROM f WHERE id % 50 = 0) SELECT q.id, f.path FROM q JOIN f ON regexp_extract(f.path, '[^/]*$') = regexp_extract(elided, '[^/]*$') AND regexp_matches(f.path, '(^|/)main/(.*/)?[^/]*$')")
def j16_elided_path(s: SparkSession, d: str) -> DataFrame:
    """Paths written with `...`, of the files whose id is divisible by 50: joined on the file name, then the other parts must come in order."""
    f = b.files(s, d).select("id", "path", F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    asked = f.filter("id % 50 = 0").select(F.col("id").alias("q"), F.concat(F.lit("main/.../"), "name").alias("elided"), "name")
    in_order = F.expr("path RLIKE concat('(^|/)', replace(substring(elided, 1, length(elided) - length(name)), '.../', '(.*/)?'), '[^/]*$')")
    return asked.join(f.select("path", "name"), "name").filter(in_order).select(F.col("q").alias("id"), "path")


_CLASH = f"WITH {_LINKS}, x AS (SELECT DISTINCT task, split_part(path, '/', 1) AS dir FROM lk JOIN fl USING (doc_id) JOIN documents USING (doc_id) WHERE source = 'commit_messages')"


@query(_CLASH + " SELECT dir, count(*) AS tasks, min(task) AS first_task FROM x GROUP BY 1 HAVING count(*) > 1")
def j17_clashes(s: SparkSession, d: str) -> DataFrame:
    """Tasks that touch one directory, as groups with members' numbers, not as pairs."""
    docs = b.documents(s, d).filter("source = 'commit_messages'").select("doc_id")
    x = document_tasks(s, d).join(document_files(s, d), "doc_id").join(docs, "doc_id", "left_semi").select("task", F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).distinct()
    return x.groupBy("dir").agg(F.count("*").alias("tasks"), F.min("task").alias("first_task")).filter("tasks > 1")


@query("WITH o AS (SELECT id, state, priority, assignee FROM (SELECT DISTINCT * FROM issues) QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated) = 1), m AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN (o.state, o.priority, o.assignee) IS DISTINCT FROM (n.state, n.priority, n.assignee) THEN 'changed' END AS mark FROM o FULL JOIN iss n ON o.id = n.id) SELECT * FROM m WHERE mark IS NOT NULL")
def j19_versions(s: SparkSession, d: str) -> DataFrame:
    from tessera.session import table

    old = op.latest(table(s, d, "issues").distinct().withColumn("k", F.lower(F.trim("id"))), ["k"], [F.asc("updated")])
    return op.compared(old, b.issues(s, d), ["id"], ["state", "priority", "assignee"])


_VERSIONS = """ov AS (SELECT id, file_id, parent_id, kind, coalesce(container, '') AS c, name, sig, hash, start_line AS at_ FROM de WHERE local = 0 AND id % 13 <> 0),
nv AS (SELECT id, file_id, parent_id, kind, coalesce(container, '') AS c, name, CASE WHEN id % 7 = 0 THEN sig || '!' ELSE sig END AS sig, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'h' || hash ELSE hash END AS hash, start_line + id % 3 AS at_ FROM de WHERE local = 0 AND id % 17 <> 0)"""
_ROUNDS = 6
_MATCHED = f"""{_VERSIONS}, m0 AS MATERIALIZED (SELECT o.id AS oid, n.id AS nid FROM (SELECT *, row_number() OVER (PARTITION BY kind, c, name, hash ORDER BY id) AS r FROM ov) o JOIN (SELECT *, row_number() OVER (PARTITION BY kind, c, name, hash ORDER BY id) AS r FROM nv) n USING (kind, c, name, hash, r)),
m1 AS MATERIALIZED (SELECT o.id AS oid, n.id AS nid FROM (SELECT *, row_number() OVER (PARTITION BY kind, c, name, sig ORDER BY id) AS r FROM ov ANTI JOIN m0 ON ov.id = m0.oid) o JOIN (SELECT *, row_number() OVER (PARTITION BY kind, c, name, sig ORDER BY id) AS r FROM nv ANTI JOIN m0 ON nv.id = m0.nid) n USING (kind, c, name, sig, r)),
ro1 AS (SELECT kind, c, name, at_, id FROM ov ANTI JOIN m0 ON ov.id = m0.oid ANTI JOIN m1 ON ov.id = m1.oid), rn1 AS (SELECT kind, c, name, at_, id FROM nv ANTI JOIN m0 ON nv.id = m0.nid ANTI JOIN m1 ON nv.id = m1.nid)""" + "".join(
    f""", q{k} AS MATERIALIZED (SELECT oid, nid FROM (SELECT o.id AS oid, n.id AS nid, row_number() OVER (PARTITION BY o.id ORDER BY abs(o.at_ - n.at_), least(o.at_, n.at_)) AS x, row_number() OVER (PARTITION BY n.id ORDER BY abs(o.at_ - n.at_), least(o.at_, n.at_)) AS y FROM (SELECT kind, c, name, at_, min(id) AS id FROM ro{k} GROUP BY ALL) o JOIN (SELECT kind, c, name, at_, min(id) AS id FROM rn{k} GROUP BY ALL) n USING (kind, c, name)) WHERE x = 1 AND y = 1),
ro{k + 1} AS MATERIALIZED (SELECT * FROM ro{k} ANTI JOIN q{k} ON ro{k}.id = q{k}.oid), rn{k + 1} AS MATERIALIZED (SELECT * FROM rn{k} ANTI JOIN q{k} ON rn{k}.id = q{k}.nid)"""
    for k in range(1, _ROUNDS)
) + f", mt AS (SELECT oid AS old_id, nid AS new_id, '=' AS mark FROM m0 UNION ALL SELECT oid, nid, '~' FROM m1 UNION ALL " + " UNION ALL ".join(f"SELECT oid, nid, '^' FROM q{k}" for k in range(1, _ROUNDS)) + f" UNION ALL SELECT id, NULL, '-' FROM ro{_ROUNDS} UNION ALL SELECT NULL, id, '+' FROM rn{_ROUNDS})"


def two_versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An older and a newer snapshot of the declarations (id, file_id, parent_id, kind, c, name, sig, hash, at).

    The tables hold one snapshot, so both are edits of it: some declarations are only in one of them, of some the text, of some the
    signature differs, and some have moved by a line or two.
    """
    de = b.decls(s, d).filter("local = 0").select("id", "file_id", "parent_id", "kind", F.coalesce("container", F.lit("")).alias("c"), "name", "sig", "hash", F.col("start_line").alias("at"))
    new = de.filter("id % 17 <> 0").withColumns({
        "sig": F.when(F.col("id") % 7 == 0, F.concat("sig", F.lit("!"))).otherwise(F.col("sig")),
        "hash": F.when((F.col("id") % 5 == 0) | (F.col("id") % 7 == 0), F.concat(F.lit("h"), "hash")).otherwise(F.col("hash")),
        "at": F.col("at") + F.col("id") % 3,
    })
    return de.filter("id % 13 <> 0"), new


def version_matches(s: SparkSession, d: str) -> DataFrame:
    return op.matched_versions(*two_versions(s, d), ["kind", "c", "name"], "hash", "sig", "at")


@query(f"WITH {_MATCHED} SELECT * FROM mt WHERE mark <> '='")
def j20_version_matching(s: SparkSession, d: str) -> DataFrame:
    """One-to-one matching in three passes: equal text, equal signature, then the nearest within kind, container and name."""
    return version_matches(s, d).filter("mark <> '='")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' GROUP BY 1", bare=True)
def j21_dimensions(s: SparkSession, d: str) -> DataFrame:
    """Small dimensions; the optimiser decides how, by their sizes."""
    from tessera.session import table

    n = table(s, d, "nation").join(table(s, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT event_id FROM e a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM e c WHERE c.user_id = a.user_id AND c.event_type = 'click' AND c.turn > a.turn AND c.turn <= a.turn + 3)", bare=True)
def j22_read_then_edit(s: SparkSession, d: str) -> DataFrame:
    e = b.events(s, d).withColumn("turn", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")).select("event_id", "user_id", "event_type", "turn")
    return op.followed(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'click'"), "user_id", "turn", 3).select("event_id")


@query("WITH m AS (SELECT DISTINCT regexp_extract(path, '^[^/]*/') || module AS root FROM f) SELECT f.id, max(root) AS root FROM f LEFT JOIN m ON starts_with(f.path, root || '/') AND length(root) = (SELECT max(length(root)) FROM m WHERE starts_with(f.path, root || '/')) GROUP BY f.id")
def j23_deepest_prefix(s: SparkSession, d: str) -> DataFrame:
    """The deepest root that holds a path: each path's prefixes are exploded, so the join is on equality."""
    f = b.files(s, d).select("id", "path", "module")
    roots = f.select(F.concat(F.regexp_extract("path", "^[^/]*/", 0), "module").alias("root")).distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = f.select("id", F.explode(prefixes).alias("root")).join(roots, "root")
    best = hit.groupBy("id").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("root"))
    return f.select("id").join(best, "id", "left")


@query(f"WITH {_EDGES}, t AS (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY length(name) DESC, name) AS r FROM (SELECT DISTINCT file_id, name FROM de WHERE kind IN ('class', 'interface', 'object', 'enum'))) SELECT t.file_id AS id, n.file_id AS caller, sum(c)::BIGINT AS n FROM t JOIN n ON n.name = t.name AND n.file_id <> t.file_id WHERE r <= 4 GROUP BY ALL")
def j24_callers(s: SparkSession, d: str) -> DataFrame:
    """Files that name one of a file's (at most four longest) types."""
    types = b.decls(s, d).filter("kind IN ('class', 'interface', 'object', 'enum')").select(F.col("file_id").alias("id"), "name").distinct()
    top = types.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.length("name")), "name"))).filter("r <= 4").drop("r")
    refs = b.lines(s, d).select(F.col("id").alias("caller"), F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9]*)\b"), 1)).alias("name"))
    return top.join(refs.groupBy("caller", "name").agg(F.count("*").alias("c")), "name").filter("caller <> id").groupBy("id", "caller").agg(F.sum("c").alias("n"))


@query("WITH a AS (SELECT role, quantile_disc(cost, 0.5) AS m FROM ru WHERE start_ms < 1755000000000 GROUP BY 1), z AS (SELECT role, quantile_disc(cost, 0.5) AS m FROM ru WHERE start_ms >= 1755000000000 GROUP BY 1) SELECT role, CASE WHEN a.m <> 0 THEN floor(100.0 * (z.m - a.m) / a.m + 0.5)::BIGINT ELSE 0 END AS delta FROM a JOIN z USING (role)")
def j25_periods(s: SparkSession, d: str) -> DataFrame:
    r = b.runs(s, d)
    med = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cost)")
    a = r.filter("start_ms < 1755000000000").groupBy("role").agg(med.alias("a"))
    z = r.filter("start_ms >= 1755000000000").groupBy("role").agg(med.alias("z"))
    return a.join(z, "role").select("role", F.when(F.col("a") != 0, F.floor(100.0 * (F.col("z") - F.col("a")) / F.col("a") + 0.5)).otherwise(0).cast("bigint").alias("delta"))


@query("WITH g AS (SELECT id, name, container FROM de WHERE id % 9 = 0), h AS (SELECT name, container, count(*) AS n, min(id) AS there FROM de WHERE id % 9 <> 0 GROUP BY ALL) SELECT g.id, CASE WHEN n = 1 THEN there END AS moved_to FROM g LEFT JOIN h ON g.name = h.name AND g.container IS NOT DISTINCT FROM h.container")
def j26_moved_or_gone(s: SparkSession, d: str) -> DataFrame:
    de = b.decls(s, d)
    here = de.filter("id % 9 <> 0").groupBy("name", "container").agg(F.count("*").alias("n"), F.min("id").alias("there")).alias("h")
    gone = de.filter("id % 9 = 0").select("id", "name", "container").alias("g")
    j = gone.join(here, (F.col("g.name") == F.col("h.name")) & F.col("g.container").eqNullSafe(F.col("h.container")), "left")
    return j.select("id", F.when(F.col("n") == 1, F.col("there")).alias("moved_to"))
