"""Queries of the general data problems and what SQL says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.delivery import DeletionVectors, delivery_vectors
from tessera.operators.hierarchy import Forest, decl_nodes, descendant_pairs, issue_nodes
from tessera.operators.history import field_history
from tessera.operators.intervals import busy_and_gaps, final_runs
from tessera.operators.rolling import project_usage, quiet_days, rolling_totals
from tessera.session import table


def _vectors(spark: SparkSession, d: str) -> DeletionVectors:
    return delivery_vectors(spark, f"{d}/start_a.parquet", F.col("message.id"), F.col("message.usage.output_tokens"), F.col("seq"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).deleted(["seq"])


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    kept = _vectors(spark, d).kept()
    return kept.select("seq", "batch", "session", "project", "type", F.col("message.id").alias("message_id"), F.col("message.usage.output_tokens").alias("output_tokens"), F.col("message.content").alias("content"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(project_usage(table(spark, d, "usage_hours"), table(spark, d, "runs")), "project", "day", "cost")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quiet_days(_totals(spark, d), "project")


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _totals(spark, d).select("project", "day", r("total_own"), r("total_7"), r("avg_7"), r("total_30"), r("avg_30"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return field_history(table(spark, d, "field_changes"), table(spark, d, "issues"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_history(spark, d).drop("value")


def _forest(spark: SparkSession, d: str) -> Forest:
    return Forest(issue_nodes(table(spark, d, "issues")).unionByName(decl_nodes(table(spark, d, "decls"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).linked().withColumnRenamed("t", "tree")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = _forest(spark, d).hierarchy().drop("pre")
    return h.withColumn("path", F.concat_ws(" > ", "path")).withColumnRenamed("t", "tree")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendant_pairs(_forest(spark, d).hierarchy()).withColumnRenamed("t", "tree")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return busy_and_gaps(final_runs(table(spark, d, "runs")), "session", "start_ms", "end_ms")


QUERIES = {f.__name__: f for f in (p2_found, p2_messages, p3_found, p3_rolling, p5_found, p5_history, p6_found, p6_hierarchy, p6_descendants, p7_found)}

_P2 = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY message.id ORDER BY message.usage.output_tokens DESC NULLS LAST, seq) AS rn FROM start_a)
SELECT {} FROM r WHERE {}"""
_P3 = """WITH h AS (SELECT run_id, hour, max(cost) AS cost FROM usage_hours GROUP BY ALL), o AS (SELECT DISTINCT id, project FROM runs),
u AS (SELECT project, hour // 24 AS day, sum(coalesce(cost, 0)) AS c, max(coalesce(cost, 0)) > 0 AS pos FROM h JOIN o ON id = run_id WHERE project IS NOT NULL GROUP BY ALL),
b AS (SELECT project, min(day) AS lo, max(day) AS hi FROM u WHERE pos GROUP BY ALL),
g AS (SELECT project, unnest(generate_series(lo, hi)) AS day FROM b),
t AS (SELECT g.project, g.day, sum(CASE WHEN u.day = g.day THEN c ELSE 0 END) AS own, coalesce(bool_or(u.day = g.day AND pos), false) AS act,
 sum(CASE WHEN u.day > g.day - 7 THEN c ELSE 0 END) AS t7, coalesce(sum(c), 0) AS t30
 FROM g LEFT JOIN u ON u.project = g.project AND u.day BETWEEN g.day - 29 AND g.day GROUP BY ALL)
"""
_P5 = """WITH c AS (SELECT DISTINCT id, issue, lower(field) AS field, "at" AS a, removed, added FROM field_changes),
i AS (SELECT lower(trim(id)) AS k, arg_max(created, updated) AS created FROM (SELECT id, created, updated FROM issues WHERE created IS NOT NULL) GROUP BY 1),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY issue, field, a ORDER BY id DESC) = 1),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY issue, field ORDER BY a, id) = 1),
v AS (SELECT issue, field, a AS f, added AS value FROM s UNION ALL SELECT issue, field, created, removed FROM f JOIN i ON lower(trim(issue)) = k WHERE created < a),
n AS (SELECT *, row_number() OVER w = 1 OR lag(value) OVER w IS DISTINCT FROM value AS new FROM v WINDOW w AS (PARTITION BY issue, field ORDER BY f))
SELECT issue, field, {}f AS valid_from, coalesce(lead(f) OVER (PARTITION BY issue, field ORDER BY f), -1) AS valid_to FROM n WHERE new"""
_P6 = """WITH RECURSIVE iv AS (SELECT id, parent, lower(trim(id)) AS k FROM issues QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated DESC, id DESC, parent DESC NULLS LAST) = 1),
n AS (SELECT 'issues' AS tree, a.id AS node, 0::BIGINT AS ord, coalesce(b.id, CASE WHEN trim(a.parent) <> '' THEN '?' END) AS up FROM iv a LEFT JOIN iv b ON lower(trim(a.parent)) = b.k
 UNION ALL SELECT DISTINCT 'decls', id::VARCHAR, id, CASE WHEN parent_id <> 0 THEN parent_id::VARCHAR END FROM decls),
e AS (SELECT x.tree, x.node, x.up FROM n x SEMI JOIN n y ON x.tree = y.tree AND x.up = y.node),
d AS (SELECT tree, node, node AS root, 0::BIGINT AS depth, [node] AS path FROM n ANTI JOIN e USING (tree, node)
 UNION ALL SELECT e.tree, e.node, d.root, d.depth + 1, list_append(d.path, e.node) FROM d JOIN e ON d.tree = e.tree AND d.node = e.up),
lost AS (SELECT tree, node, up FROM e ANTI JOIN d USING (tree, node)),
w AS (SELECT tree, node, up AS at_, 1 AS k FROM lost UNION ALL SELECT w.tree, w.node, l.up, k + 1 FROM w JOIN lost l ON w.tree = l.tree AND w.at_ = l.node WHERE k < (SELECT least(count(*), 200) FROM lost)),
ring AS (SELECT DISTINCT tree, node FROM w WHERE node = at_),
rw AS (SELECT w.tree, w.node, arg_min(w.at_, (n.ord, w.at_)) AS root FROM w JOIN ring r ON r.tree = w.tree AND r.node = w.at_ JOIN n ON n.tree = w.tree AND n.node = w.at_ GROUP BY ALL),
a AS (SELECT tree, node, root, depth, path FROM d UNION ALL SELECT tree, node, root, -1, NULL FROM rw)
"""
_P7 = """WITH r AS (SELECT DISTINCT session, start_ms AS s, end_ms AS t FROM runs WHERE session IS NOT NULL AND end_ms >= start_ms),
n AS (SELECT *, coalesce(s > max(t) OVER (PARTITION BY session ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM r),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY session ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS p FROM n),
b AS (SELECT session, p, min(s) AS f, max(t) AS t FROM k GROUP BY ALL),
g AS (SELECT session, t AS f, lead(f) OVER (PARTITION BY session ORDER BY p) AS t FROM b)
SELECT session, 'busy' AS state, f AS from_ms, t AS to_ms FROM b UNION ALL SELECT session, 'gap', f, t FROM g WHERE t IS NOT NULL"""

SQL = {
    "p2_found": _P2.format("seq", "message.id <> '' AND rn > 1"),
    "p2_messages": _P2.format("seq, batch, session, project, type, message.id AS message_id, message.usage.output_tokens AS output_tokens, message.content AS content", "message.id IS NULL OR message.id = '' OR rn = 1"),
    "p3_found": _P3 + "SELECT project, day, unnest([7, 30])::BIGINT AS period FROM t WHERE NOT act AND t7 > 0 UNION ALL SELECT project, day, 30 FROM t WHERE NOT act AND t7 <= 0 AND t30 > 0",
    "p3_rolling": _P3 + "SELECT project, day, round(own, 6) AS total_own, round(t7, 6) AS total_7, round(t7 / 7, 6) AS avg_7, round(t30, 6) AS total_30, round(t30 / 30, 6) AS avg_30 FROM t",
    "p5_found": _P5.format(""),
    "p5_history": _P5.format("value, "),
    "p6_found": _P6 + "SELECT a.tree, a.node, a.root, a.depth FROM a JOIN n ON a.tree = n.tree AND a.node = n.node WHERE n.up IS NOT NULL",
    "p6_hierarchy": _P6 + ", x AS (SELECT tree, unnest(path) AS node FROM d), c AS (SELECT tree, node, count(*) - 1 AS descendants FROM x GROUP BY ALL) SELECT a.tree, a.node, a.root, a.depth, descendants, coalesce(array_to_string(path, ' > '), '') AS path FROM a LEFT JOIN c ON a.tree = c.tree AND a.node = c.node",
    "p6_descendants": _P6 + "SELECT tree, path[i + 1] AS ancestor, node, depth - i AS distance FROM (SELECT tree, path, node, depth, unnest(range(0, depth)) AS i FROM d)",
    "p7_found": _P7,
}
