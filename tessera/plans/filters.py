"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import filters as op
from tessera.operators.tables import narrowest
from tessera.plans import base as b

query = b.Registry()
QUERIES, SQL = query.queries, query.sql

RULES = [("^(work on|continue)", "work"), ("^(find|review|explain)", "read"), ("fail", "defect"), ("^(clean|add|fix|Fix)", "edit")]


@query("SELECT de.id FROM de JOIN f ON f.id = file_id WHERE kind IN ('fun', 'method') AND module = 'core' AND lower(source_set) NOT LIKE '%test%' AND local = 0")
def f1_declaration_filter(s: SparkSession, d: str) -> DataFrame:
    f = b.files(s, d).filter(~F.lower("source_set").contains("test") & (F.col("module") == "core")).select(F.col("id").alias("file_id"))
    return b.decls(s, d).filter("kind IN ('fun', 'method') AND local = 0").join(f, "file_id").select("id")


@query("SELECT id FROM f WHERE module = 'core' OR starts_with(module, 'core/') OR starts_with(path, 'core/') OR starts_with(path, 'core.')")
def f2_module_scope(s: SparkSession, d: str) -> DataFrame:
    return b.files(s, d).filter(op.module_scope(F.col("module"), F.col("path"), "core")).select("id")


@query("WITH x AS (SELECT id, name, CASE WHEN name = 'scan' THEN 1 WHEN name SIMILAR TO 'scan.*' THEN 2 WHEN contains(name, 'scan') THEN 3 END AS level FROM de) SELECT id, name, level FROM x WHERE level = (SELECT min(level) FROM x)")
def f3_name_lookup(s: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    rows = b.decls(s, d).select("id", "name", F.when(n == "scan", 1).when(op.glob(n, "scan*"), 2).when(n.contains("scan"), 3).alias("level")).filter("level IS NOT NULL")
    return rows.join(rows.agg(F.min("level").alias("level")), "level", "left_semi").select("id", "name", "level")


@query("SELECT id, fqn FROM de WHERE name GLOB 'fold*' AND id IN (SELECT id FROM de WHERE kind IN ('fun', 'method'))")
def f4_glob(s: SparkSession, d: str) -> DataFrame:
    return b.decls(s, d).filter(op.glob(F.col("name"), "fold*") & F.col("kind").isin("fun", "method")).select("id", "fqn")


@query("SELECT id FROM de WHERE container LIKE '%Part0' OR regexp_replace(fqn, '\\.[^.]*$', '') LIKE '%.Part0' OR receiver = 'Part0'")
def f5_qualifier(s: SparkSession, d: str) -> DataFrame:
    owner = F.regexp_replace("fqn", r"\.[^.]*$", "")
    hit = F.col("container").endswith("Part0") | owner.endswith(".Part0") | (F.col("receiver") == "Part0")
    return b.decls(s, d).filter(hit).select("id")


@query("SELECT id FROM de WHERE json_array_length(params) = 2 AND trim(regexp_replace(params->1->>'type', '<.*>', '')) = 'Map'")
def f6_parameters(s: SparkSession, d: str) -> DataFrame:
    types = F.transform(F.from_json("params", "array<struct<name:string,type:string>>"), lambda p: p["type"])
    return b.decls(s, d).filter(op.parameters_match(types, ["_", "Map"])).select("id")


_INNER = "h AS (SELECT id AS file_id, line FROM ln WHERE regexp_matches(text, '(?i)EMPTYLIST')), x AS (SELECT h.file_id, h.line, de.fqn, row_number() OVER (PARTITION BY h.file_id, h.line ORDER BY end_line - start_line NULLS LAST, start_line DESC, fqn) AS rn FROM h LEFT JOIN de ON de.file_id = h.file_id AND h.line BETWEEN start_line AND end_line)"


@query(f"WITH {_INNER} SELECT file_id, line, fqn FROM x WHERE rn = 1")
def f7_text_search(s: SparkSession, d: str) -> DataFrame:
    """Lines that match, each with the innermost declaration around it."""
    hits = b.lines(s, d).filter(F.col("text").rlike("(?i)EMPTYLIST")).select(F.col("id").alias("file_id"), "line")
    return narrowest(hits, b.decls(s, d), "file_id", "line", "start_line", "end_line", ["fqn"], ["file_id", "line"])


@query("SELECT id, state, updated FROM iss WHERE lower(state) IN ('open', 'review', 'blocked') AND NOT coalesce(lower(priority) IN ('minor'), false) AND resolved IS NULL ORDER BY updated DESC LIMIT 40")
def f8_task_query(s: SparkSession, d: str) -> DataFrame:
    rows = b.issues(s, d)
    fields = {c: F.col(c) for c in ("state", "priority", "project", "assignee", "updated")}
    where, order = op.task_filter("state: Open, Review, Blocked priority: -Minor #unresolved sort: -updated", fields, {"unresolved": F.col("resolved").isNull()}, F.col("summary"))
    return rows.filter(where).orderBy(*order).limit(40).select("id", "state", "updated")


@query("SELECT id FROM iss WHERE NOT coalesce(lower(assignee) LIKE 'a%', false)")
def f9_null_safe_exclusion(s: SparkSession, d: str) -> DataFrame:
    return b.issues(s, d).filter(~F.coalesce(F.lower("assignee").startswith("a"), F.lit(False))).select("id")


@query("SELECT id FROM iss WHERE list_contains(list_transform(from_json(json->'tags', '[\"VARCHAR\"]'), lambda x: lower(x)), 'vector')")
def f10_multi_value(s: SparkSession, d: str) -> DataFrame:
    tags = F.from_json("json", "tags array<string>").getField("tags")
    return b.issues(s, d).filter(F.array_contains(F.transform(tags, F.lower), "vector")).select("id")


@query("SELECT id FROM co WHERE contains(text, '100%') OR contains(text, '_') OR starts_with(text, '\\')")
def f11_literal_like(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return b.comments(s, d).filter(t.contains("100%") | t.contains("_") | t.startswith("\\")).select("id")


@query("SELECT id FROM ru WHERE start_ms >= 1750000000000 AND role = 'implement' AND (title ILIKE '%work%' OR ter ILIKE '%work%' OR project ILIKE '%work%' OR model ILIKE '%work%')")
def f12_runs_page(s: SparkSession, d: str) -> DataFrame:
    hit = F.lit(False)
    for c in ("title", "ter", "project", "model"):
        hit = hit | F.coalesce(F.col(c).ilike("%work%"), F.lit(False))
    return b.runs(s, d).filter((F.col("start_ms") >= 1750000000000) & (F.col("role") == "implement") & hit).select("id")


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{c}'" for p, c in RULES) + " ELSE 'other' END"


@query(f"SELECT {_CASE} AS category, count(*) AS n FROM ru GROUP BY 1")
def f13_categories(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).groupBy(op.first_rule(F.col("title"), RULES).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' OR event_type LIKE 'e%'")
def f14_event_types(s: SparkSession, d: str) -> DataFrame:
    return b.events(s, d).filter(op.event_types(F.col("event_type"), ["purchase", "e*"])).select("event_id")


@query("SELECT id FROM ru WHERE coalesce(tool_errors = 0, false) AND coalesce(tool_calls > 5, false) OR coalesce(peak >= 150000, false)")
def f15_condition(s: SparkSession, d: str) -> DataFrame:
    rows = b.runs(s, d)
    return rows.filter(op.condition("tool_errors==0 && tool_calls>5 || peak>=150000", {c: rows[c] for c in ("tool_errors", "tool_calls", "peak")})).select("id")


@query("SELECT doc_id FROM documents WHERE (source = 'facts' OR source = 'wiki_pages' AND project = 'amber-beacon-14') AND coalesce(lang, '') <> 'ru'")
def f16_scopes(s: SparkSession, d: str) -> DataFrame:
    scopes = [("facts", None), ("wiki_pages", "amber-beacon-14")]
    hit = F.lit(False)
    for source, target in scopes:
        hit = hit | ((F.col("source") == source) & (F.lit(True) if target is None else F.col("project") == target))
    return b.documents(s, d).filter(hit & (F.coalesce("lang", F.lit("")) != "ru")).select("doc_id")


_PATHS = "[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java)"


@query(f"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, '{_PATHS}'), lambda p: p = 'token/LimitShard.kt' OR p LIKE '%Shard.kt')) > 0")
def f17_anchors(s: SparkSession, d: str) -> DataFrame:
    """Whole paths or their tails; a cheap test of the text comes first."""
    anchors = F.regexp_extract_all("text", F.lit(_PATHS), 0)
    hit = F.exists(anchors, lambda p: (p == "token/LimitShard.kt") | p.endswith("Shard.kt"))
    return b.documents(s, d).filter(F.col("text").contains("Shard.kt")).filter(hit).select("doc_id")


@query("SELECT id FROM ru WHERE starts_with(path, '/transcripts/stone') OR path IN (SELECT path FROM ru WHERE role = 'review')")
def f18_account_scope(s: SparkSession, d: str) -> DataFrame:
    rows = b.runs(s, d)
    named = rows.filter("role = 'review'").select("path").distinct()
    mine = rows.filter(F.col("path").startswith("/transcripts/stone"))
    rest = rows.filter(~F.coalesce(F.col("path").startswith("/transcripts/stone"), F.lit(False))).join(named, "path", "left_semi")
    return mine.select("id").unionByName(rest.select("id"))


@query("SELECT de.id, kind || ' ' || coalesce(container || '.', '') || name || ' @' || path || ':' || start_line AS line FROM de JOIN f ON f.id = file_id")
def proj_one_line(s: SparkSession, d: str) -> DataFrame:
    f = b.files(s, d).select(F.col("id").alias("file_id"), "path")
    owner = F.coalesce(F.concat("container", F.lit(".")), F.lit(""))
    return b.decls(s, d).join(f, "file_id").select("id", F.concat("kind", F.lit(" "), owner, "name", F.lit(" @"), "path", F.lit(":"), F.col("start_line").cast("string")).alias("line"))


@query("SELECT doc_id, substr(text, greatest(1, p - 40), 110) AS snippet FROM (SELECT doc_id, text, instr(text, 'Lantern') AS p FROM documents) WHERE p > 0")
def proj_snippet(s: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", "Lantern")
    return b.documents(s, d).filter(at > 0).select("doc_id", F.substring("text", F.greatest(F.lit(1), at - 40), F.lit(110)).alias("snippet"))


@query("SELECT id, line FROM (SELECT id, line, text, count(*) OVER (PARTITION BY id) AS n FROM ln) WHERE line <= 10 OR line > n - 5 OR regexp_matches(text, '(?i)error')")
def proj_middle_out(s: SparkSession, d: str) -> DataFrame:
    """Head, tail and, of the middle, the lines that report an error."""
    rows = b.files(s, d).filter("content IS NOT NULL").select("id", F.split("content", r"\r\n|\r|\n").alias("a"))
    rows = rows.select("id", F.size("a").alias("n"), F.posexplode("a").alias("i", "text")).withColumn("line", (F.col("i") + 1).cast("bigint"))
    return rows.filter((F.col("line") <= 10) | (F.col("line") > F.col("n") - 5) | F.col("text").rlike("(?i)error")).select("id", "line")
