"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import exact_tenths, half_up, picked, weighted_cost
from tessera.operators import walks
from tessera.operators.filters import first_rule
from tessera.plans import base as b
from tessera.plans.filters import _CASE, RULES
from tessera.plans.joins import _LINKS, _TURNS, document_files, document_tasks, turns
from tessera.session import table

query = b.Registry()
QUERIES, SQL = query.queries, query.sql


def n_() -> Column:
    """The number of rows, as n."""
    return F.count("*").alias("n")


def count_if(c: Column) -> Column:
    """How often a condition holds, 0 for none."""
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0).cast("bigint"))


@query("SELECT name, least(count(*), 20) AS n FROM de GROUP BY name")
def a1_capped_count(s: SparkSession, d: str) -> DataFrame:
    return b.decls(s, d).groupBy("name").agg(F.least(F.count("*"), F.lit(20)).alias("n"))


_NAMED = "(?:^|[^\\p{L}\\p{N}_])([A-Z][A-Za-z0-9]*)"


@query(f"SELECT id AS file_id, name, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '{_NAMED}', 1)) AS name FROM ln) GROUP BY ALL")
def a2_references_by_file(s: SparkSession, d: str) -> DataFrame:
    return b.lines(s, d).select(F.col("id").alias("file_id"), F.explode(F.regexp_extract_all("text", F.lit(_NAMED), 1)).alias("name")).groupBy("file_id", "name").agg(n_())


_CARRY = f"{_TURNS}, c AS (SELECT *, length(content) AS chars, max(turn) OVER (PARTITION BY session) - turn AS later FROM t)"


@query(f"WITH {_CARRY} SELECT session, type, count(*) AS n, sum(chars)::BIGINT AS chars, sum(chars * later)::BIGINT AS carried, sum(floor(chars / 4.0 * (2 + 0.1 * later) + 0.5))::BIGINT AS attributed FROM c WHERE chars IS NOT NULL GROUP BY ALL")
def a3_category_cost(s: SparkSession, d: str) -> DataFrame:
    """What each kind of step costs a session; the attributed cost is rounded by row and then summed."""
    later = F.max("turn").over(W.partitionBy("session")) - F.col("turn")
    rows = turns(s, d).withColumns({"later": later, "chars": F.char_length("content")}).filter("chars IS NOT NULL")
    cost = half_up(F.col("chars") / 4.0 * (2 + 0.1 * F.col("later")))
    return rows.groupBy("session", "type").agg(n_(), F.sum("chars").alias("chars"), F.sum(F.col("chars") * F.col("later")).alias("carried"), F.sum(cost).alias("attributed"))


@query("SELECT ru.id, coalesce(u.n, 0) AS n, round(coalesce(u.cost, 0), 6) AS cost, coalesce(l.calls, 0) AS calls, coalesce(l.empty, 0) AS empty, coalesce(l.output, 0)::BIGINT AS output, coalesce(l.chars, 0)::BIGINT AS chars, round(ru.cost / nullif(sum(ru.cost) OVER (PARTITION BY ru.session), 0), 6) AS share FROM ru LEFT JOIN (SELECT run_id, count(*) AS n, sum(cost) AS cost FROM uh GROUP BY 1) u ON u.run_id = ru.id LEFT JOIN (SELECT path, count(*) FILTER (mid <> '') AS calls, count(*) FILTER (coalesce(chars, 0) = 0) AS empty, sum(output) AS output, sum(chars) AS chars FROM st GROUP BY 1) l ON l.path = ru.path")
def a4_run_rollup(s: SparkSession, d: str) -> DataFrame:
    """A run's hours and cost, what its transcript holds, and its share of the session's cost."""
    u = b.hours(s, d).groupBy(F.col("run_id").alias("id")).agg(n_(), F.sum("cost").alias("cost"))
    lines = b.steps(s, d).groupBy("path").agg(count_if(F.col("mid") != "").alias("calls"), count_if(F.coalesce("chars", F.lit(0)) == 0).alias("empty"), F.sum("output").alias("output"), F.sum("chars").alias("chars"))
    r = b.runs(s, d).select("id", "path", "session", F.col("cost").alias("own"))
    whole = r.groupBy("session").agg(F.sum("own").alias("whole"))
    rows = r.join(whole, r["session"].eqNullSafe(whole["session"]), "left").drop(whole["session"]).join(u, "id", "left").join(lines, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", zero("n"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"), zero("calls"), zero("empty"), zero("output"), zero("chars"), F.round(F.try_divide("own", "whole"), 6).alias("share"))


@query("SELECT session, epoch_ms(at_text::TIMESTAMP) // 3600000 AS hour, round(sum(input + coalesce(output, 0) * 5.0), 6) AS cost FROM st WHERE at_text IS NOT NULL AND mid <> '' GROUP BY ALL")
def a5_hour_buckets(s: SparkSession, d: str) -> DataFrame:
    at = F.unix_millis(F.to_timestamp("at_text"))
    none = F.lit(0)
    cost = weighted_cost(F.col("input"), none, none, none, F.col("output"))
    return b.steps(s, d).filter("at_text IS NOT NULL AND mid <> ''").groupBy("session", F.floor(at / 3_600_000).alias("hour")).agg(F.round(F.sum(cost), 6).alias("cost"))


SUMS = {
    "input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cw5m": "cache_creation.ephemeral_5m_input_tokens",
    "cw1h": "cache_creation.ephemeral_1h_input_tokens", "thinking": "output_tokens_details.thinking_tokens",
}


@query("SELECT epoch_ms(timestamp::TIMESTAMP) // 60000 AS minute, message.model AS model, " + ", ".join(f"coalesce(sum(message.usage.{f}), 0)::BIGINT AS {n}" for n, f in SUMS.items()) + " FROM start_a WHERE session IS NOT NULL AND timestamp IS NOT NULL AND message.id <> '' GROUP BY ALL")
def a6_minute_model(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "start_a").filter("session IS NOT NULL AND timestamp IS NOT NULL AND message.id <> ''")
    at = F.floor(F.unix_millis(F.to_timestamp("timestamp")) / 60_000)
    sums = [F.coalesce(F.sum(f"message.usage.{f}"), F.lit(0)).cast("bigint").alias(n) for n, f in SUMS.items()]
    return rows.groupBy(at.alias("minute"), F.col("message.model").alias("model")).agg(*sums)


@query("SELECT hour, round(sum(cost), 6) AS cost FROM uh WHERE hour BETWEEN 486000 AND 489000 AND run_id IN (SELECT id FROM ru WHERE starts_with(project, 'stone')) GROUP BY 1")
def a7_hour_range(s: SparkSession, d: str) -> DataFrame:
    mine = b.runs(s, d).filter(F.col("project").startswith("stone")).select(F.col("id").alias("run_id"))
    return b.hours(s, d).filter("hour BETWEEN 486000 AND 489000").join(mine, "run_id", "left_semi").groupBy("hour").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT kind, coalesce(model, 'other') AS model, count(*) AS n, max(start_ms) AS last_ms FROM ru WHERE role <> 'review' GROUP BY ALL")
def a8_coalesced_groups(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).filter("role <> 'review'").groupBy("kind", F.coalesce("model", F.lit("other")).alias("model")).agg(n_(), F.max("start_ms").alias("last_ms"))


_WEEK = "strftime(make_timestamp(start_ms * 1000), '%G-W%V')"


def iso_week(ms: Column) -> Column:
    """2026-W01 of epoch milliseconds, in UTC."""
    at = F.timestamp_millis(ms)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), at).cast("int"), F.weekofyear(at))


@query(f"WITH t AS (SELECT {_WEEK} AS week, role, title, count(*) AS n, min((start_ms, id)) AS first FROM ru WHERE title IS NOT NULL GROUP BY ALL) SELECT week, role, sum(n)::BIGINT AS n, list(title ORDER BY first)[:3] AS examples FROM t GROUP BY ALL")
def a9_weekly_examples(s: SparkSession, d: str) -> DataFrame:
    """With the three distinct titles seen first; a partial aggregate keeps only distinct ones."""
    r = b.runs(s, d).filter("title IS NOT NULL")
    by = r.groupBy(iso_week(F.col("start_ms")).alias("week"), "role", "title").agg(n_(), F.min(F.struct("start_ms", "id")).alias("first"))
    top = by.withColumn("i", F.row_number().over(W.partitionBy("week", "role").orderBy("first")))
    ordered = F.sort_array(F.collect_list(F.when(F.col("i") <= 3, F.struct("i", "title"))))
    return top.groupBy("week", "role").agg(F.sum("n").alias("n"), F.transform(ordered, lambda x: x["title"]).alias("examples"))


MEASURES = ("turns", "input", "cw5m", "cw1h", "cache_read", "output", "cost", "peak", "tool_calls", "tool_errors", "tool_ms", "duration_s", "result_attr", "share")
_PICK = "CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1]::DOUBLE ELSE floor((v[len(v) // 2] + v[len(v) // 2 + 1]) / 2.0 + 0.5) END AS median, v[least(len(v) - 1, 3 * len(v) // 4) + 1]::BIGINT AS p75"


@query("SELECT role, measure, " + _PICK + ", list_sum(v)::BIGINT AS total FROM (SELECT role, measure, list_sort(list(value)) AS v FROM (UNPIVOT (SELECT role, " + ", ".join(f"{m}::BIGINT AS {m}" for m in MEASURES) + " FROM ru) ON " + ", ".join(MEASURES) + " INTO NAME measure VALUE value) GROUP BY ALL)")
def a10_role_summary(s: SparkSession, d: str) -> DataFrame:
    """Median, upper quartile and sum of 14 measures by role."""
    r = b.runs(s, d).select("role", *[F.col(m).cast("bigint").alias(m) for m in MEASURES])
    return picked(r.unpivot("role", list(MEASURES), "measure", "value"), ["role", "measure"], "value")


@query("WITH g AS (SELECT role, kind, sum(cost) AS c, count(*) AS n FROM ru GROUP BY ALL) SELECT role, kind, round(100.0 * c / sum(c) OVER (PARTITION BY role), 4) AS cost_share, round(100.0 * n / sum(n) OVER (PARTITION BY role), 4) AS run_share FROM g")
def a11_shares(s: SparkSession, d: str) -> DataFrame:
    g = b.runs(s, d).groupBy("role", "kind").agg(F.sum("cost").alias("c"), n_())
    w = W.partitionBy("role")
    return g.select("role", "kind", F.round(100.0 * F.col("c") / F.sum("c").over(w), 4).alias("cost_share"), F.round(100.0 * F.col("n") / F.sum("n").over(w), 4).alias("run_share"))


@query("SELECT project, role, sum(cost)::BIGINT AS cost, grouping(project, role)::INT AS level FROM ru GROUP BY ROLLUP (project, role)")
def a12_two_level_totals(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).rollup("project", "role").agg(F.sum("cost").alias("cost"), F.grouping_id().cast("int").alias("level"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, round(avg((value > 90)::INT), 6) AS rate FROM events GROUP BY 1", bare=True)
def a13_nearest_rank(s: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return b.events(s, d).groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") > 90).cast("int")), 6).alias("rate"))


@query("SELECT role, count(DISTINCT project) AS projects, count(DISTINCT ter) AS tasks, count(DISTINCT session) FILTER (start_ms >= 1760000000000) AS recent FROM ru GROUP BY 1")
def a14_distinct_counts(s: SparkSession, d: str) -> DataFrame:
    recent = F.count_distinct(F.when(F.col("start_ms") >= 1760000000000, F.col("session")))
    return b.runs(s, d).groupBy("role").agg(F.count_distinct("project").alias("projects"), F.count_distinct("ter").alias("tasks"), recent.alias("recent"))


_SLICES = "x AS (SELECT {case} AS command, role, {week} AS week, id, session, title, cost, tool_errors FROM ru), k AS (SELECT command, unnest([{{'role': NULL, 'week': NULL, 'slice': 'all'}}, {{'role': role, 'week': NULL, 'slice': 'role'}}, {{'role': NULL, 'week': week, 'slice': 'week'}}]) AS g, id, session, title, cost, tool_errors FROM x)".format(case=_CASE, week=_WEEK)


@query(f"WITH {_SLICES}, s AS (SELECT command, g.slice AS slice, g.role AS role, g.week AS week, id, session, title, cost, tool_errors, row_number() OVER (PARTITION BY command, g.slice, g.role, g.week, session, title ORDER BY id) AS nth, row_number() OVER (PARTITION BY command, g.slice, g.role, g.week ORDER BY cost DESC NULLS LAST, id) AS place FROM k) SELECT command, slice, role, week, count(*) AS n, count(*) FILTER (nth > 1) AS repeats, sum(tool_errors)::BIGINT AS errors, sum(cost)::BIGINT AS cost, list(id ORDER BY place) FILTER (place <= 3) AS top_runs FROM s GROUP BY ALL")
def a15_command_groups(s: SparkSession, d: str) -> DataFrame:
    """Groups of commands in three slices at once, of all, by role and by week: calls, repeats within a session, errors, cost, and the three dearest runs."""
    x = b.runs(s, d).select(first_rule(F.col("title"), RULES).alias("command"), "role", iso_week(F.col("start_ms")).alias("week"), "id", "session", "title", "cost", "tool_errors")
    none = F.lit(None).cast("string")
    slices = F.array(*[F.struct(F.lit(n).alias("slice"), r.alias("role"), w.alias("week")) for n, r, w in (("all", none, none), ("role", F.col("role"), none), ("week", none, F.col("week")))])
    k = x.select("command", F.explode(slices).alias("g"), "id", "session", "title", "cost", "tool_errors").select("command", "g.*", "id", "session", "title", "cost", "tool_errors")
    keys = ["command", "slice", "role", "week"]
    # Repeats come of the counts by session and title, the dearest of a rank cut at three: no group is sorted whole.
    each = k.groupBy(*keys, "session", "title").agg(F.count("*").alias("c"), F.sum("tool_errors").alias("errors"), F.sum("cost").alias("cost"))
    sums = each.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeats"), F.sum("errors").alias("errors"), F.sum("cost").alias("cost"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last("cost"), "id"))
    top = k.withColumn("place", place).filter("place <= 3").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda v: v["id"]).alias("top_runs"))
    same = None
    for c in keys:
        same = sums[c].eqNullSafe(top[c]) if same is None else same & sums[c].eqNullSafe(top[c])
    return sums.join(top, same).select(*[sums[c] for c in keys], "n", "repeats", "errors", "cost", "top_runs")


@query("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY session, type, md5(content) ORDER BY seq) AS r FROM st WHERE content IS NOT NULL) WHERE r > 1")
def a16_repeats(s: SparkSession, d: str) -> DataFrame:
    rows = b.steps(s, d).filter("content IS NOT NULL").withColumn("h", F.sha2("content", 256))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("session", "type", "h").orderBy("seq"))).filter("r > 1").select("seq")


PRICES = [("quartz-2", 3.0, 15.0), ("flint-1", 1.0, 5.0), ("opal-4", 5.0, 25.0)]


@query("WITH p AS (SELECT * FROM (VALUES ('quartz-2', 3.0, 15.0), ('flint-1', 1.0, 5.0), ('opal-4', 5.0, 25.0)) v(m, i, o)), x AS (SELECT ru.*, coalesce(a.i, z.i) AS i, coalesce(a.o, z.o) AS o FROM ru LEFT JOIN p a ON a.m = ru.model LEFT JOIN p z ON z.m = regexp_replace(ru.model, '-(long|mini|[0-9]{8})$', '')) SELECT role, round(sum((input * i + output * o) / 1e6), 6) AS money, count(*) FILTER (i IS NULL) AS unpriced FROM x GROUP BY 1")
def a17_money(s: SparkSession, d: str) -> DataFrame:
    """Runs without a price are counted, not guessed; an id meets a price whole, or without its suffix."""
    p = s.createDataFrame(PRICES, "m string, i double, o double")
    bare = F.regexp_replace("model", "-(long|mini|[0-9]{8})$", "")
    x = b.runs(s, d).join(p.select(F.col("m").alias("model"), F.col("i").alias("i1"), F.col("o").alias("o1")), "model", "left")
    x = x.withColumn("bare", bare).join(p.select(F.col("m").alias("bare"), F.col("i").alias("i2"), F.col("o").alias("o2")), "bare", "left")
    i, o = F.coalesce("i1", "i2"), F.coalesce("o1", "o2")
    return x.groupBy("role").agg(F.round(F.sum((F.col("input") * i + F.col("output") * o) / 1e6), 6).alias("money"), count_if(i.isNull()).alias("unpriced"))


@query("SELECT id, round(count(*) FILTER (regexp_matches(text, '^(package|import|//|/\\*| \\*|\\s*$)')) / count(*), 6) AS share FROM ln GROUP BY 1")
def a18_boilerplate(s: SparkSession, d: str) -> DataFrame:
    plain = F.col("text").rlike(r"^(package|import|//|/\*| \*|\s*$)")
    return b.lines(s, d).groupBy("id").agg(F.round(count_if(plain) / F.count("*"), 6).alias("share"))


@query("SELECT role, kind, CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1]::DOUBLE ELSE floor((v[len(v) // 2] + v[len(v) // 2 + 1]) / 2.0 + 0.5) END AS median FROM (SELECT role, kind, list_sort(list(input)) AS v FROM ru WHERE input IS NOT NULL GROUP BY ALL)")
def a19_start_context(s: SparkSession, d: str) -> DataFrame:
    return picked(b.runs(s, d), ["role", "kind"], "input").select("role", "kind", "median")


@query("SELECT name, count(*) AS n, min(fqn) AS example FROM de GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, name LIMIT 25")
def a20_top_with_example(s: SparkSession, d: str) -> DataFrame:
    return b.decls(s, d).groupBy("name").agg(n_(), F.min("fqn").alias("example")).filter("n >= 3").orderBy(F.desc("n"), "name").limit(25)


@query("SELECT 'suffix' AS part, regexp_extract(name, '([A-Z][a-z]+)[0-9]*$', 1) AS word, count(*) AS n, min(fqn) AS example FROM de WHERE kind = 'class' AND regexp_extract(name, '([A-Z][a-z]+)[0-9]*$', 1) <> '' GROUP BY ALL HAVING count(*) >= 3 UNION ALL SELECT 'supertype', word, count(DISTINCT id), min(fqn) FROM (SELECT id, fqn, unnest(string_split(supertypes, ' ')) AS word FROM de WHERE supertypes <> '') WHERE word <> '' GROUP BY word HAVING count(DISTINCT id) >= 3")
def a21_conventions(s: SparkSession, d: str) -> DataFrame:
    """What types are called by their last word, and what they stand under, where three types at least do, with an example."""
    de = b.decls(s, d)
    suffix = F.regexp_extract("name", "([A-Z][a-z]+)[0-9]*$", 1)
    words = de.filter("kind = 'class'").select(F.lit("suffix").alias("part"), suffix.alias("word"), "id", "fqn")
    above = de.filter("supertypes <> ''").select(F.lit("supertype").alias("part"), F.explode(F.array_distinct(F.split("supertypes", " "))).alias("word"), "id", "fqn")
    return words.unionByName(above).filter("word <> ''").groupBy("part", "word").agg(n_(), F.min("fqn").alias("example")).filter("n >= 3")


_BOX = "[-*] +\\[([ xX])\\]"


@query(f"WITH c AS (SELECT *, regexp_extract_all(coalesce(json->>'description', ''), '{_BOX}', 1) AS boxes FROM iss) SELECT p.id, count(c.id) AS children, count(c.resolved) AS resolved, count(*) FILTER (c.state = 'Open') AS open, sum(len(list_filter(c.boxes, lambda x: x <> ' ')))::BIGINT AS checked, sum(len(c.boxes))::BIGINT AS criteria, list(c.id ORDER BY c.num, c.id) FILTER (c.resolved IS NULL)[:5] AS first_open FROM iss p JOIN c ON c.pk = p.k GROUP BY p.id")
def a22_epic_progress(s: SparkSession, d: str) -> DataFrame:
    """Children by state, checked criteria of their descriptions, and the first five that are not resolved."""
    i = b.issues(s, d)
    boxes = F.regexp_extract_all(F.coalesce(F.get_json_object("json", "$.description"), F.lit("")), F.lit(_BOX), 1)
    c = i.filter("pk IS NOT NULL").select("pk", "id", "num", "resolved", "state", boxes.alias("boxes"))
    sums = c.groupBy("pk").agg(
        F.count("*").alias("children"), F.count("resolved").alias("resolved"), count_if(F.col("state") == "Open").alias("open"),
        F.sum(F.size(F.filter("boxes", lambda x: x != " "))).alias("checked"), F.sum(F.size("boxes")).alias("criteria"),
    )
    left = c.filter("resolved IS NULL").withColumn("r", F.row_number().over(W.partitionBy("pk").orderBy("num", "id"))).filter("r <= 5")
    first = left.groupBy("pk").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("first_open"))
    return i.select("k", "id").join(sums.join(first, "pk", "left").withColumnRenamed("pk", "k"), "k").drop("k")


@query("SELECT module, count(*) FILTER (errors > 0) AS with_errors, count(*) AS n FROM f GROUP BY 1")
def a23_health_counts(s: SparkSession, d: str) -> DataFrame:
    return b.files(s, d).groupBy("module").agg(count_if(F.col("errors") > 0).alias("with_errors"), n_())


@query(f"WITH {_LINKS}, x AS (SELECT DISTINCT task, path FROM lk JOIN fl USING (doc_id)), q AS (SELECT task AS asked, path FROM x WHERE regexp_extract(task, '[0-9]+$')::BIGINT % 50 = 0), rel AS (SELECT DISTINCT asked, x.task FROM q JOIN x USING (path) WHERE x.task <> asked), t AS (SELECT asked, count(*) AS tasks FROM rel GROUP BY 1), c AS (SELECT rel.asked, x.path, count(*) AS n FROM rel JOIN x USING (task) GROUP BY ALL) SELECT asked, path, n FROM c JOIN t USING (asked) WHERE n >= greatest(2, ceil(tasks * 0.2)) AND (asked, path) NOT IN (SELECT (asked, path) FROM q)")
def a24_co_change(s: SparkSession, d: str) -> DataFrame:
    """What else changes with the files of a task: files that at least two, and a fifth, of the tasks on its files touch as well. Asked
    for the tasks whose number is divisible by 50."""
    x = document_tasks(s, d).join(document_files(s, d), "doc_id").select("task", "path").distinct()
    asked = document_tasks(s, d).select(F.col("task").alias("id")).distinct().filter(F.regexp_extract("id", "[0-9]+$", 0).cast("bigint") % 50 == 0)
    rows = walks.co_changed(x, asked, 2, 5)
    if rows is not None:
        return rows
    q = x.filter(F.regexp_extract("task", "[0-9]+$", 0).cast("bigint") % 50 == 0).withColumnRenamed("task", "asked")
    rel = q.join(x, "path").filter("task <> asked").select("asked", "task").distinct()
    c = rel.join(x, "task").groupBy("asked", "path").agg(n_()).join(rel.groupBy("asked").agg(F.count("*").alias("tasks")), "asked")
    return c.filter("n >= greatest(2, ceil(tasks * 0.2))").join(q, ["asked", "path"], "left_anti").select("asked", "path", "n")


_FILE = "[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java|md)"
_WEIGHT = "CASE priority WHEN 'Critical' THEN 3.0 WHEN 'Major' THEN 2.0 ELSE 1.0 END"


@query(f"WITH m AS (SELECT DISTINCT id, unnest(regexp_extract_all(coalesce(summary, '') || ' ' || coalesce(json->>'description', ''), '{_FILE}')) AS path, {_WEIGHT} AS w, coalesce(({b.NOW} - created) / 86400000.0, 90.0) AS age FROM iss), r AS (SELECT path, split_part(path, '/', 1) AS module, w * pow(0.5, age / 90.0) AS risk FROM m WHERE age >= 0) SELECT path, module, count(*) AS n, round(sum(risk), 6) AS risk, CASE WHEN sum(risk) >= 3 THEN 'high' WHEN sum(risk) >= 1 THEN 'some' ELSE 'low' END AS level FROM r GROUP BY GROUPING SETS ((path, module), (module))")
def a25_risk_decay(s: SparkSession, d: str) -> DataFrame:
    """How dense findings lie on a file and on a module: weights by severity that halve every 90 days; the undated count as one half-life old, future ones not at all."""
    text = F.concat_ws(" ", "summary", F.get_json_object("json", "$.description"))
    w = F.when(F.col("priority") == "Critical", 3.0).when(F.col("priority") == "Major", 2.0).otherwise(1.0)
    age = F.coalesce((F.lit(b.NOW) - F.col("created")) / 86_400_000, F.lit(90.0))
    m = b.issues(s, d).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_FILE), 0))).alias("path"), w.alias("w"), age.alias("age")).filter("age >= 0")
    rows = m.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("module"), (F.col("w") * F.pow(F.lit(0.5), F.col("age") / 90.0)).alias("x"))
    risk = F.sum("x")
    g = rows.groupingSets([["path", "module"], ["module"]], "path", "module")
    return g.agg(n_(), F.round(risk, 6).alias("risk"), F.when(risk >= 3, "high").when(risk >= 1, "some").otherwise("low").alias("level"))


@query("WITH m AS (SELECT role, avg(cost) AS mean FROM ru WHERE start_ms < 1755000000000 GROUP BY 1), t AS (SELECT run_id, sum(cost) AS total FROM uh GROUP BY 1) SELECT hour, round(sum(CASE WHEN total > 0 THEN uh.cost / total * (mean - ru.cost) END), 4) AS saved, count(*) FILTER (mean IS NULL) AS uncovered FROM uh JOIN t USING (run_id) JOIN ru ON ru.id = run_id LEFT JOIN m USING (role) GROUP BY 1")
def a26_savings(s: SparkSession, d: str) -> DataFrame:
    """Saving against a role's earlier mean, spread over a run's hours by their cost."""
    r = b.runs(s, d)
    mean = r.filter("start_ms < 1755000000000").groupBy("role").agg(F.avg("cost").alias("mean"))
    h = b.hours(s, d)
    total = h.groupBy("run_id").agg(F.sum("cost").alias("total"))
    x = h.join(total, "run_id").join(r.select(F.col("id").alias("run_id"), "role", F.col("cost").alias("spent")), "run_id").join(mean, "role", "left")
    part = F.when(F.col("total") > 0, F.col("cost") / F.col("total") * (F.col("mean") - F.col("spent")))
    return x.groupBy("hour").agg(F.round(F.sum(part), 4).alias("saved"), count_if(F.col("mean").isNull()).alias("uncovered"))


@query("SELECT hour // 24 AS day, round(sum(cost), 6) AS cost FROM uh GROUP BY 1 HAVING sum(cost) > 0.3")
def a27_over_budget(s: SparkSession, d: str) -> DataFrame:
    g = b.hours(s, d).groupBy(F.floor(F.col("hour") / 24).alias("day")).agg(F.sum("cost").alias("cost"))
    return g.filter("cost > 0.3").withColumn("cost", F.round("cost", 6))


_TOUCH = "tc AS (SELECT session, seq, unnest(regexp_extract_all(content, '[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java)')) AS path FROM st)"


@query(f"WITH {_TOUCH}, x AS (SELECT session, path, count(*) AS n FROM tc GROUP BY ALL) SELECT session, sum(n)::BIGINT AS reads, sum(n - 1)::BIGINT AS rereads, count(*) AS files FROM x GROUP BY 1")
def a28_rereads(s: SparkSession, d: str) -> DataFrame:
    p = F.explode(F.regexp_extract_all("content", F.lit(r"[a-z]+/[A-Z][A-Za-z]+\.(?:kt|java)"), 0)).alias("path")
    x = b.steps(s, d).select("session", p).groupBy("session", "path").agg(n_())
    return x.groupBy("session").agg(F.sum("n").alias("reads"), F.sum(F.col("n") - 1).alias("rereads"), F.count("*").alias("files"))


@query(f"WITH x AS (SELECT kind, {_CASE} AS reason, role, coalesce(model, 'none') AS program FROM ru) SELECT kind, reason, role, program, count(*) AS n FROM x GROUP BY GROUPING SETS ((kind), (kind, reason), (kind, role), (kind, program), (kind, reason, role, program))")
def a29_replay_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts by kind, and by kind with reason, role or program, or all of them, in one pass."""
    x = b.runs(s, d).select("kind", first_rule(F.col("title"), RULES).alias("reason"), "role", F.coalesce("model", F.lit("none")).alias("program"))
    sets = [["kind"], ["kind", "reason"], ["kind", "role"], ["kind", "program"], ["kind", "reason", "role", "program"]]
    return x.groupingSets(sets, "kind", "reason", "role", "program").agg(n_())


_LOOKS = "[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java|md)"


@query(f"WITH {_TURNS}, x AS (SELECT session, count(*) FILTER (turn <= 8) AS early, count(*) FILTER (turn <= 8 AND regexp_matches(content, '{_LOOKS}')) AS looks, coalesce(bool_or(type = 'attachment'), false) AS flagged FROM t GROUP BY 1) SELECT flagged, count(*) AS sessions, sum(early)::BIGINT AS early, sum(looks)::BIGINT AS looks, round(sum(looks) / nullif(sum(early), 0), 6) AS share FROM x GROUP BY 1")
def a30_orientation(s: SparkSession, d: str) -> DataFrame:
    """Steps of the first eight turns and those that look at a file, by whether the session has an attachment."""
    early = F.col("turn") <= 8
    flagged = F.max(F.coalesce(F.col("type") == "attachment", F.lit(False)))
    x = turns(s, d).groupBy("session").agg(count_if(early).alias("early"), count_if(early & F.col("content").rlike(_LOOKS)).alias("looks"), flagged.alias("flagged"))
    return x.groupBy("flagged").agg(F.count("*").alias("sessions"), F.sum("early").alias("early"), F.sum("looks").alias("looks"), F.round(F.try_divide(F.sum("looks"), F.sum("early")), 6).alias("share"))


@query(f"WITH {_TURNS}, c AS (SELECT session, seq, turn, coalesce(length(content), 0) AS chars, sum(coalesce(length(content), 0)) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ctx, max(turn) OVER (PARTITION BY session) AS turns FROM t), h AS (SELECT *, chars * (turns - turn + 1) AS carried, row_number() OVER (PARTITION BY session ORDER BY chars * (turns - turn + 1) DESC, seq) AS r FROM c) SELECT session, min(turn) FILTER (ctx >= 1000) AS at_1k, min(turn) FILTER (ctx >= 4000) AS at_4k, round(sum(carried) FILTER (r <= 3) / nullif(sum(carried), 0), 6) AS heaviest FROM h GROUP BY 1")
def a31_session_weight(s: SparkSession, d: str) -> DataFrame:
    """The turns at which a session's text reaches two sizes, and the share of the three steps that weigh most, each by the turns it is carried."""
    one = W.partitionBy("session")
    ctx = F.sum(F.coalesce(F.char_length("content"), F.lit(0))).over(one.orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    c = turns(s, d).withColumns({"ctx": ctx, "turns": F.max("turn").over(one), "chars": F.coalesce(F.char_length("content"), F.lit(0))})
    c = c.withColumn("carried", F.col("chars") * (F.col("turns") - F.col("turn") + 1))
    c = c.withColumn("r", F.row_number().over(one.orderBy(F.desc("carried"), "seq")))
    first = lambda k: F.min(F.when(F.col("ctx") >= k, F.col("turn")))
    return c.groupBy("session").agg(first(1000).alias("at_1k"), first(4000).alias("at_4k"), F.round(F.try_divide(F.sum(F.when(F.col("r") <= 3, F.col("carried"))), F.sum("carried")), 6).alias("heaviest"))


@query("SELECT c_mktsegment, count(DISTINCT o_custkey) AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", bare=True)
def a32_partial_and_final(s: SparkSession, d: str) -> DataFrame:
    from tessera.session import table

    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return o.join(li, "o_orderkey").groupBy("c_mktsegment").agg(F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("r"), 2).alias("revenue"))


_IDENT = "[A-Za-z_][A-Za-z0-9_]*"


@query(f"WITH e AS (SELECT author, issue, regexp_extract_all(removed, '{_IDENT}') AS o, regexp_extract_all(added, '{_IDENT}') AS n FROM fc WHERE removed IS NOT NULL AND added IS NOT NULL), z AS (SELECT author, issue, list_filter(list_zip(o, n), lambda x: x[1] <> x[2]) AS d FROM e WHERE len(o) = len(n)), r AS (SELECT DISTINCT author, issue, d[1][1] AS old, d[1][2] AS new FROM z WHERE len(list_distinct(d)) = 1) SELECT author, old, new, count(*) AS places FROM r GROUP BY ALL HAVING count(*) >= 3")
def a33_same_replacement(s: SparkSession, d: str) -> DataFrame:
    """One identifier, and only that, replaced by the same other one in three places at least by the same hand."""
    idents = lambda c: F.regexp_extract_all(c, F.lit(_IDENT), 0)
    e = b.changes(s, d).filter("removed IS NOT NULL AND added IS NOT NULL").select("author", "issue", idents("removed").alias("o"), idents("added").alias("n")).filter("size(o) = size(n)")
    both = F.array_distinct(F.filter(F.zip_with("o", "n", lambda x, y: F.struct(x.alias("old"), y.alias("new"))), lambda x: x["old"] != x["new"]))
    r = e.withColumn("d", both).filter("size(d) = 1").select("author", "issue", F.col("d")[0]["old"].alias("old"), F.col("d")[0]["new"].alias("new")).distinct()
    return r.groupBy("author", "old", "new").agg(F.count("*").alias("places")).filter("places >= 3")


@query("WITH x AS (SELECT user_id, ts, sum(value) OVER w AS total, count(*) FILTER (event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)) SELECT user_id, count(*) FILTER (total > 200 OR errors >= 3) AS over FROM x GROUP BY 1", bare=True)
def a34_moving_threshold(s: SparkSession, d: str) -> DataFrame:
    e = b.events(s, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-7 * 86_400_000_000, 0)
    x = e.withColumns({"total": F.sum("value").over(w), "errors": F.sum((F.col("event_type") == "error").cast("int")).over(w)})
    return x.groupBy("user_id").agg(count_if((F.col("total") > 200) | (F.col("errors") >= 3)).alias("over"))


@query("SELECT kind, role, round(avg((tool_errors > 0)::INT), 6) AS share, avg((tool_errors > 0)::INT) >= 0.3 AS go FROM ru GROUP BY GROUPING SETS ((), (kind), (role))")
def a35_independent_groupings(s: SparkSession, d: str) -> DataFrame:
    share = F.avg((F.col("tool_errors") > 0).cast("int"))
    g = b.runs(s, d).groupingSets([[], ["kind"], ["role"]], "kind", "role")
    return g.agg(F.round(share, 6).alias("share"), (share >= 0.3).alias("go"))


@query("SELECT module, count(*) FILTER (deleted = 1) AS deleted, count(*) FILTER (deleted = 0 AND errors > 0) AS errors, count(*) FILTER (deleted = 0 AND errors IS NULL) AS unknown, count(*) AS n, CASE min(CASE WHEN deleted = 1 THEN 0 WHEN errors > 0 THEN 1 WHEN errors IS NULL THEN 2 ELSE 3 END) WHEN 0 THEN 'deleted' WHEN 1 THEN 'errors' WHEN 2 THEN 'unknown' ELSE 'good' END AS worst FROM f GROUP BY 1")
def a36_worst_state(s: SparkSession, d: str) -> DataFrame:
    """Files of a module by state, and the worst state of all."""
    rank = F.min(F.when(F.col("deleted") == 1, 0).when(F.col("errors") > 0, 1).when(F.col("errors").isNull(), 2).otherwise(3))
    there = F.col("deleted") == 0
    counts = [count_if(F.col("deleted") == 1).alias("deleted"), count_if(there & (F.col("errors") > 0)).alias("errors"), count_if(there & F.col("errors").isNull()).alias("unknown"), n_()]
    return b.files(s, d).groupBy("module").agg(*counts, F.get(F.array(*map(F.lit, ("deleted", "errors", "unknown", "good"))), rank).alias("worst"))


@query("SELECT id, path, errors FROM f WHERE errors > 0 ORDER BY errors DESC, path, id LIMIT 100")
def a36_error_files(s: SparkSession, d: str) -> DataFrame:
    """The hundred files with most errors."""
    return b.files(s, d).filter("errors > 0").select("id", "path", "errors").orderBy(F.desc("errors"), "path", "id").limit(100)


NAMED_SOURCES = ("tracker_issues", "code_comments", "agent_answers")


@query("SELECT project, " + ", ".join(f"sum(CASE WHEN source = '{n}' THEN n_chars ELSE 0 END)::BIGINT AS {n}" for n in NAMED_SOURCES) + ", greatest(0, sum(coalesce(n_chars, 0)) - sum(CASE WHEN source IN ('" + "', '".join(NAMED_SOURCES) + "') THEN n_chars ELSE 0 END))::BIGINT AS rest, sum(coalesce(n_chars, 0))::BIGINT AS total FROM documents GROUP BY 1")
def a37_residual(s: SparkSession, d: str) -> DataFrame:
    """A total taken apart by named sources, with what none of them explains."""
    one = lambda n: F.sum(F.when(F.col("source") == n, F.col("n_chars")).otherwise(0))
    parts = b.documents(s, d).groupBy("project").agg(*[one(n).alias(n) for n in NAMED_SOURCES], F.sum(F.coalesce("n_chars", F.lit(0))).alias("total"))
    rest = F.col("total") - sum((F.col(n) for n in NAMED_SOURCES), F.lit(0))
    return parts.select("project", *NAMED_SOURCES, F.greatest(F.lit(0), rest).cast("bigint").alias("rest"), "total")


@query("WITH i AS (SELECT DISTINCT id, array_to_string(string_split(regexp_extract(text, '^import ([A-Za-z0-9_.]+)', 1), '.')[:2], '.') AS lib FROM ln WHERE starts_with(text, 'import ')) SELECT lib, count(*) AS files FROM i WHERE NOT starts_with(lib, 'java.') GROUP BY 1 HAVING count(*) >= 3")
def a38_library_use(s: SparkSession, d: str) -> DataFrame:
    lib = F.array_join(F.slice(F.split(F.regexp_extract("text", r"^import ([A-Za-z0-9_.]+)", 1), r"\."), 1, 2), ".")
    i = b.lines(s, d).filter(F.col("text").startswith("import ")).select("id", lib.alias("lib")).distinct()
    return i.filter(~F.col("lib").startswith("java.")).groupBy("lib").agg(F.count("*").alias("files")).filter("files >= 3")


@query("SELECT kind, word, count(*) AS n FROM (SELECT 'thrown' AS kind, unnest(regexp_extract_all(regexp_replace(text, '//.*$', ''), 'throw new ([A-Z][A-Za-z]+)', 1)) AS word FROM ln UNION ALL SELECT 'caught', unnest(regexp_extract_all(regexp_replace(text, '//.*$', ''), 'catch \\([a-z]+: ([A-Z][A-Za-z]+)', 1)) FROM ln UNION ALL SELECT 'helper', unnest(regexp_extract_all(regexp_replace(text, '//.*$', ''), '\\b(error|require|check)\\(', 1)) FROM ln) GROUP BY ALL")
def a39_error_style(s: SparkSession, d: str) -> DataFrame:
    code = F.regexp_replace("text", "//.*$", "")
    found = lambda kind, p: F.transform(F.regexp_extract_all(code, F.lit(p), 1), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    every = F.concat(found("thrown", "throw new ([A-Z][A-Za-z]+)"), found("caught", r"catch \([a-z]+: ([A-Z][A-Za-z]+)"), found("helper", r"\b(error|require|check)\("))
    return b.lines(s, d).select(F.explode(every).alias("x")).groupBy("x.kind", "x.word").agg(n_())


@query("SELECT CASE WHEN kind IN ('interface', 'object', 'enum') THEN kind WHEN modifiers LIKE '%data%' THEN 'data' WHEN modifiers LIKE '%static%' THEN 'static' ELSE 'plain' END AS shape, count(*) AS n, count(*) FILTER (modifiers LIKE '%private%') AS hidden FROM de WHERE kind IN ('class', 'interface', 'object', 'enum') GROUP BY 1")
def a40_type_shapes(s: SparkSession, d: str) -> DataFrame:
    m = F.col("modifiers")
    shape = F.when(F.col("kind") != "class", F.col("kind")).when(m.contains("data"), "data").when(m.contains("static"), "static").otherwise("plain")
    return b.decls(s, d).filter("kind IN ('class', 'interface', 'object', 'enum')").groupBy(shape.alias("shape")).agg(n_(), count_if(m.contains("private")).alias("hidden"))


@query("WITH x AS (SELECT f.id, regexp_extract(path, '([^/.]+)\\.[a-z]+$', 1) AS stem, list(de.name) FILTER (de.kind IN ('class', 'interface', 'object', 'enum') AND coalesce(parent_id, 0) = 0) AS t FROM f JOIN de ON de.file_id = f.id GROUP BY ALL) SELECT CASE WHEN coalesce(len(t), 0) = 0 THEN 'functions' WHEN len(t) > 1 THEN 'several' WHEN t[1] = stem THEN 'same name' ELSE 'other name' END AS shape, count(*) AS n FROM x GROUP BY 1")
def a41_file_shapes(s: SparkSession, d: str) -> DataFrame:
    top = F.col("kind").isin("class", "interface", "object", "enum") & (F.coalesce("parent_id", F.lit(0)) == 0)
    x = b.decls(s, d).groupBy("file_id").agg(count_if(top).alias("n"), F.max(F.when(top, F.col("name"))).alias("t"))
    f = b.files(s, d).select(F.col("id").alias("file_id"), F.regexp_extract("path", r"([^/.]+)\.[a-z]+$", 1).alias("stem"))
    shape = F.when(F.col("n") == 0, "functions").when(F.col("n") > 1, "several").when(F.col("t") == F.col("stem"), "same name").otherwise("other name")
    return x.join(f, "file_id").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT id, split_part(path, '/', 1) AS repo, package, source_set = 'test' AS test FROM f WHERE package IS NOT NULL) SELECT repo, round(count(*) FILTER (test AND (repo, package) IN (SELECT (repo, package) FROM p WHERE NOT test)) / nullif(count(*) FILTER (test), 0), 6) AS share FROM p GROUP BY 1")
def a42_layout(s: SparkSession, d: str) -> DataFrame:
    """Of a repository's test files, those in a package that its main code has as well."""
    p = b.files(s, d).filter("package IS NOT NULL").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), "package", (F.col("source_set") == "test").alias("test"))
    main = p.filter("NOT test").select("repo", "package", F.lit(True).alias("too")).distinct()
    x = p.join(main, ["repo", "package"], "left")
    return x.groupBy("repo").agg(F.round(F.try_divide(count_if(F.col("test") & F.coalesce("too", F.lit(False))), count_if(F.col("test"))), 6).alias("share"))


@query("WITH p AS (SELECT split_part(path, '/', 1) AS repo, package FROM f WHERE package <> ''), bs AS (SELECT repo, mode(split_part(package, '.', 1)) AS base FROM p GROUP BY 1 HAVING count(DISTINCT split_part(package, '.', 1)) = 1) SELECT repo, split_part(package, '.', 2) AS level, count(*) AS files FROM p JOIN bs USING (repo) WHERE split_part(package, '.', 2) <> '' GROUP BY ALL")
def a42_levels(s: SparkSession, d: str) -> DataFrame:
    """Files by the first package level under the base that all packages of a repository share."""
    p = b.files(s, d).filter("package <> ''").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), F.split_part("package", F.lit("."), F.lit(1)).alias("base"), F.split_part("package", F.lit("."), F.lit(2)).alias("level"))
    shared = p.groupBy("repo").agg(F.min("base").alias("lo"), F.max("base").alias("hi")).filter("lo = hi").select("repo")
    return p.join(shared, "repo", "left_semi").filter("level <> ''").groupBy("repo", "level").agg(F.count("*").alias("files"))


@query("WITH r AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9]*)\\b', 1)) AS name FROM ln), t AS (SELECT DISTINCT name, file_id FROM de WHERE kind IN ('class', 'object')) SELECT t.name, count(DISTINCT r.id) AS files FROM t JOIN r ON r.name = t.name AND r.id <> t.file_id GROUP BY 1")
def a43_shared_helpers(s: SparkSession, d: str) -> DataFrame:
    r = b.lines(s, d).select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9]*)\b"), 1)).alias("name")).distinct()
    t = b.decls(s, d).filter("kind IN ('class', 'object')").select("name", "file_id").distinct()
    return t.join(r, "name").filter("id <> file_id").groupBy("name").agg(F.count_distinct("id").alias("files"))


@query("SELECT module, count(DISTINCT id) AS files, count(*) AS lines FROM ln JOIN (SELECT id, module FROM f) USING (id) GROUP BY 1 ORDER BY lines DESC, module LIMIT 20")
def a44_largest_modules(s: SparkSession, d: str) -> DataFrame:
    n = F.size(F.split("content", r"\r\n|\r|\n")).cast("bigint")
    g = b.files(s, d).filter("content IS NOT NULL").groupBy("module").agg(F.count("*").alias("files"), F.sum(n).alias("lines"))
    return g.orderBy(F.desc("lines"), "module").limit(20)


@query()
def fn_exact_tenths(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).select("id", exact_tenths(F.col("cost") / 7.0).alias("tenths"))


@query("SELECT role, v[least(len(v) - 1, 3 * len(v) // 4) + 1] AS p75 FROM (SELECT role, list_sort(list(turns)) AS v FROM ru GROUP BY 1)")
def fn_upper_quartile(s: SparkSession, d: str) -> DataFrame:
    return picked(b.runs(s, d), ["role"], "turns").select("role", "p75")


@query("SELECT id, floor((cost - 10000) / 1000.0 + 0.5)::BIGINT AS half_up, (input + cw5m * 1.25 + cw1h * 2 + cache_read * 0.1 + output * 5)::DOUBLE AS weighted FROM ru")
def fn_rounding_and_weights(s: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("input", "cw5m", "cw1h", "cache_read", "output")]
    return b.runs(s, d).select("id", half_up((F.col("cost") - 10000) / 1000.0).alias("half_up"), weighted_cost(*c).alias("weighted"))
