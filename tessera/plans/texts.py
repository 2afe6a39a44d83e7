"""Scalar functions and operators on text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions.numbers import half_up
from tessera.operators import outputs
from tessera.operators import tables as op
from tessera.plans import base as b
from tessera.plans.aggregates import count_if, iso_week
from tessera.plans.joins import _LINKS, landed
from tessera.plans.scans import document_lines
from tessera.session import table

query = b.Registry()
QUERIES, SQL = query.queries, query.sql
_L = "l AS (SELECT doc_id, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i))"


@query("SELECT id, trim(regexp_replace(regexp_replace(returns, '<.*>', ''), '\\?$', '')) AS base FROM de WHERE returns IS NOT NULL")
def fn_base_type(s: SparkSession, d: str) -> DataFrame:
    from tessera.operators.filters import base_type

    return b.decls(s, d).filter("returns IS NOT NULL").select("id", base_type(F.col("returns")).alias("base"))


@query("SELECT id, trim(regexp_replace(lower(summary), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM iss")
def fn_slug(s: SparkSession, d: str) -> DataFrame:
    return b.issues(s, d).select("id", F.trim(F.regexp_replace(F.lower("summary"), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


@query("SELECT id, strftime(make_timestamp(start_ms * 1000), '%G-W%V') AS week FROM ru")
def fn_iso_week(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).select("id", iso_week(F.col("start_ms")).alias("week"))


@query("SELECT id, (make_timestamp(start_ms * 1000)::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Prague')::DATE AS day FROM ru")
def fn_local_day(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).select("id", fn.local_day(F.col("start_ms"), "Europe/Prague").alias("day"))


@query("WITH x AS (SELECT id, start_ms, make_timestamp(start_ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Prague' AS l FROM ru) SELECT id, epoch_ms(CASE WHEN date_trunc('day', l) + INTERVAL 20 HOUR > l THEN date_trunc('day', l) + INTERVAL 20 HOUR ELSE date_trunc('day', l) + INTERVAL 44 HOUR END AT TIME ZONE 'Europe/Prague') AS reset_ms FROM x")
def fn_next_reset(s: SparkSession, d: str) -> DataFrame:
    return b.runs(s, d).select("id", fn.next_reset(F.lit("limit reached, resets 8pm (Europe/Prague)"), F.col("start_ms")).alias("reset_ms"))


@query("SELECT id, list_last(regexp_extract_all(name, '[A-Z][a-z0-9]*')) AS word FROM de WHERE kind = 'class'")
def fn_last_hump(s: SparkSession, d: str) -> DataFrame:
    return b.decls(s, d).filter("kind = 'class'").select("id", fn.last_hump(F.col("name")).alias("word"))


@query("SELECT id, nullif(regexp_extract(path, '/src/([^/]+)/', 1), '') AS source_set FROM f")
def fn_source_set(s: SparkSession, d: str) -> DataFrame:
    return b.files(s, d).select("id", fn.source_set(F.col("path")).alias("source_set"))


@query("SELECT doc_id, regexp_replace(text, '\\b[A-Fa-f0-9]{40,64}\\b', '***', 'g') AS shown FROM documents WHERE regexp_matches(text, '\\b[A-Fa-f0-9]{40,64}\\b') AND NOT regexp_matches(text, '(?i)(bearer|basic|password|passwd|secret|token|key|://)')")
def fn_masked(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = b.documents(s, d).filter(t.rlike(r"\b[A-Fa-f0-9]{40,64}\b") & ~t.rlike("(?i)(bearer|basic|password|passwd|secret|token|key|://)"))
    return rows.select("doc_id", fn.masked(t).alias("shown"))


@query()
def fn_command_keys(s: SparkSession, d: str) -> DataFrame:
    """Run titles read as commands."""
    return b.runs(s, d).select("id", fn.command_keys(F.col("title")).alias("command"))


@query("SELECT id, sha1(content) AS sha1, left(sha256(content), 16) AS short FROM f WHERE content IS NOT NULL")
def fn_hashes(s: SparkSession, d: str) -> DataFrame:
    return b.files(s, d).filter("content IS NOT NULL").select("id", F.sha1("content").alias("sha1"), F.substring(F.sha2("content", 256), 1, 16).alias("short"))


@query("SELECT role, map_from_entries(list_sort(list((kind, n)))) AS kinds FROM (SELECT role, kind, count(*) AS n FROM ru GROUP BY ALL) GROUP BY 1")
def fn_maps(s: SparkSession, d: str) -> DataFrame:
    g = b.runs(s, d).groupBy("role", "kind").agg(F.count("*").alias("n"))
    return g.groupBy("role").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


@query("SELECT id, list_sort(list_intersect(w, ['the', 'for', 'and'])) AS common, len(list_distinct(w)) AS words, coalesce(list_bool_or(list_transform(w, lambda x: x = 'not')), false) AS negated FROM (SELECT id, string_split(lower(summary), ' ') AS w FROM iss)")
def fn_arrays(s: SparkSession, d: str) -> DataFrame:
    w = F.split(F.lower("summary"), " ")
    return b.issues(s, d).select("id", F.sort_array(F.array_intersect(w, F.array(*map(F.lit, ("the", "for", "and"))))).alias("common"), F.size(F.array_distinct(w)).cast("bigint").alias("words"), F.exists(w, lambda x: x == "not").alias("negated"))


@query("SELECT id, (json->>'votes')::BIGINT AS votes, json_array_length(json->'tags') AS tags FROM iss")
def fn_json(s: SparkSession, d: str) -> DataFrame:
    x = F.from_json("json", "votes bigint, tags array<string>")
    return b.issues(s, d).select("id", x.getField("votes").alias("votes"), F.size(x.getField("tags")).cast("bigint").alias("tags"))


_FAMILY = f"fa AS (SELECT doc_id, {outputs.family_sql('text')} AS family FROM documents), sz AS (SELECT doc_id, count(*) AS n, sum(length(text) + 1) AS chars FROM l GROUP BY 1)"


@query(f"WITH {_L}, {_FAMILY} SELECT doc_id, family, line, text FROM l JOIN sz USING (doc_id) JOIN fa USING (doc_id) WHERE {outputs.kept_sql()}")
def x1_compressed(s: SparkSession, d: str) -> DataFrame:
    """Outputs cut down by their family; short ones as they are."""
    return outputs.compressed(document_lines(s, d), outputs.family(b.documents(s, d), "doc_id", "text"), "doc_id")


@query(f"WITH {_L}, {_FAMILY}, k AS (SELECT doc_id, count(*) AS kept FROM l JOIN sz USING (doc_id) JOIN fa USING (doc_id) WHERE {outputs.kept_sql()} GROUP BY 1) SELECT family, source, count(*) AS outputs, sum(n)::BIGINT AS lines, sum(coalesce(kept, 0))::BIGINT AS kept FROM documents JOIN fa USING (doc_id) JOIN sz USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY ALL")
def x2_families(s: SparkSession, d: str) -> DataFrame:
    """How many outputs of each family and source there are, and what their compression leaves."""
    docs = b.documents(s, d)
    family, lines = outputs.family(docs, "doc_id", "text"), document_lines(s, d)
    kept = outputs.compressed(lines, family, "doc_id").groupBy("doc_id").agg(F.count("*").alias("k"))
    rows = lines.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id", "left").join(family, "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    return rows.groupBy("family", "source").agg(F.count("*").alias("outputs"), F.sum("n").alias("lines"), F.coalesce(F.sum("k"), F.lit(0)).alias("kept"))


@query(f"WITH {_L} SELECT doc_id, max_by(text, line) FILTER (contains(text, 'WARN')) AS last_warning, count(*) FILTER (contains(text, 'ERROR')) AS errors, min_by(text, line) FILTER (contains(text, 'ERROR')) AS first_error FROM l GROUP BY 1")
def x3_log_summary(s: SparkSession, d: str) -> DataFrame:
    hit = lambda w: F.col("text").contains(w)
    return document_lines(s, d).groupBy("doc_id").agg(
        F.max_by("text", F.when(hit("WARN"), F.col("line"))).alias("last_warning"), count_if(hit("ERROR")).alias("errors"), F.min_by("text", F.when(hit("ERROR"), F.col("line"))).alias("first_error")
    )


@query(f"WITH {_L}, h AS (SELECT doc_id, line, text, regexp_extract(text, '^(#+) ', 1) AS m FROM l WHERE regexp_matches(text, '^#+ ')) SELECT doc_id, line, length(m) AS level, substr(text, length(m) + 2) AS title FROM h")
def x4_outline(s: SparkSession, d: str) -> DataFrame:
    m = F.length(F.regexp_extract("text", "^(#+) ", 1))
    return document_lines(s, d).filter(F.col("text").rlike("^#+ ")).select("doc_id", "line", m.cast("bigint").alias("level"), F.substring("text", m + 2, F.lit(1 << 30)).alias("title"))


_DELTA_FIELDS = ("summary", "state", "type", "priority", "assignee", "parent")
_TEXT = "coalesce(json->>'description', '')"
_DELTA = f"""v AS (SELECT *, lower(trim(id)) AS k, array_to_string(regexp_extract_all({_TEXT}, '[-*] +\\[[ xX]\\][^\n]*'), ' | ') AS criteria, array_to_string(regexp_extract_all({_TEXT}, '(?m)^#+ .*$'), ' | ') AS sections, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated DESC) AS rn FROM (SELECT DISTINCT * FROM issues)), n AS (SELECT * FROM v WHERE rn = 1), o AS (SELECT * FROM v WHERE rn = 2)"""


@query(f"WITH {_DELTA}" + " UNION ALL ".join(f" SELECT n.id, '{f}' AS field, o.{f} AS before, n.{f} AS after FROM n JOIN o USING (k) WHERE n.{f} IS DISTINCT FROM o.{f}" for f in (*_DELTA_FIELDS, "criteria", "sections")) + " UNION ALL SELECT n.id, 'comments', '0', count(*)::VARCHAR FROM n JOIN o USING (k) JOIN co ON lower(trim(co.issue)) = n.k AND co.created > o.updated AND co.created <= n.updated GROUP BY n.id")
def x5_issue_delta(s: SparkSession, d: str) -> DataFrame:
    """What differs between an issue's last two versions: fields, link to the parent, criteria, sections, and comments in between."""
    text = F.coalesce(F.get_json_object("json", "$.description"), F.lit(""))
    found = lambda p: F.array_join(F.regexp_extract_all(text, F.lit(p), 0), " | ")
    v = table(s, d, "issues").withColumns({"k": F.lower(F.trim("id")), "criteria": found(r"[-*] +\[[ xX]\][^\n]*"), "sections": found(r"(?m)^#+ .*$")})
    v = v.dropDuplicates(["k", "updated"]).withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc("updated"))))
    fields = (*_DELTA_FIELDS, "criteria", "sections")
    o = v.filter("rn = 2").select("k", F.col("updated").alias("since"), *[F.col(f).alias(f"old_{f}") for f in fields])
    n = v.filter("rn = 1").join(o, "k")
    one = lambda f: F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("before"), F.col(f).alias("after")))
    rows = n.select("id", F.explode(F.filter(F.array(*map(one, fields)), lambda x: x.isNotNull())).alias("x")).select("id", "x.*")
    said = b.comments(s, d).select(F.lower(F.trim("issue")).alias("k"), "created").join(n.select("k", "id", "since", "updated"), "k").filter("created > since AND created <= updated")
    return rows.unionByName(said.groupBy("id").agg(F.count("*").cast("string").alias("after")).select("id", F.lit("comments").alias("field"), F.lit("0").alias("before"), "after"))


_PACK = f"""{_LINKS}, qi AS (SELECT id, k, summary, {_TEXT} AS d FROM iss WHERE num % 50 = 0), tp AS (SELECT DISTINCT k, id, unnest(regexp_extract_all(summary || ' ' || d, '[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java|md)')) AS path FROM qi),
nf AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '[0-9]+', '') AS file, count(*) AS n FROM f GROUP BY 1), ln2 AS (SELECT path, task, max(created) AS at_ FROM (SELECT path, doc_id, created FROM fl JOIN documents USING (doc_id) WHERE source = 'commit_messages' QUALIFY row_number() OVER (PARTITION BY path ORDER BY created DESC NULLS LAST, doc_id) <= 40) JOIN lk USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {_PACK} SELECT id, 'issue' AS part, summary AS what, NULL AS mark FROM qi UNION ALL SELECT id, 'touch', path, CASE WHEN n IS NULL THEN '+' WHEN n = 1 THEN '=' WHEN n <= 3 THEN '~' ELSE '?' END FROM tp LEFT JOIN nf ON nf.file = regexp_extract(path, '[^/]*$') UNION ALL SELECT id, 'prior', task, NULL FROM (SELECT id, task, max(at_) AS at_ FROM tp JOIN ln2 USING (path) WHERE lower(task) <> k GROUP BY id, task QUALIFY row_number() OVER (PARTITION BY id ORDER BY max(at_) DESC NULLS LAST, task) <= 6) UNION ALL SELECT id, 'child', c, NULL FROM (SELECT qi.id, i.id AS c FROM qi JOIN iss i ON i.pk = qi.k QUALIFY row_number() OVER (PARTITION BY qi.id ORDER BY i.num, i.id) <= 5) UNION ALL SELECT id, 'norm', b, NULL FROM (SELECT DISTINCT tp.id, ol.text AS b, doc_id, line FROM tp JOIN (SELECT * FROM l WHERE starts_with(text, '- ')) ol ON list_contains(regexp_extract_all(ol.text, '[A-Z][A-Za-z]+'), regexp_extract(path, '([A-Za-z]+)[.]', 1)) QUALIFY row_number() OVER (PARTITION BY tp.id ORDER BY doc_id, line) <= 6)".replace("WITH ", f"WITH {_L}, ", 1))
def x6_context_pack(s: SparkSession, d: str) -> DataFrame:
    """What a worker should know of an issue: itself, the files it will touch and how sure that is, earlier tasks on them, its children,
    and rules that name them. Asked for the issues whose number is divisible by 50."""
    i = b.issues(s, d)
    q = i.filter("num % 50 = 0").select("id", "k", "summary", F.coalesce(F.get_json_object("json", "$.description"), F.lit("")).alias("d"))
    part = lambda df, name, what, mark=None: df.select("id", F.lit(name).alias("part"), what.alias("what"), (F.lit(None).cast("string") if mark is None else mark).alias("mark"))
    touch = q.select("k", "id", F.explode(F.regexp_extract_all(F.concat_ws(" ", "summary", "d"), F.lit(r"[a-z]+/[A-Z][A-Za-z]+\.(?:kt|java|md)"), 0)).alias("path")).distinct()
    touch = touch.withColumn("file", F.regexp_extract("path", "[^/]*$", 0))
    known = b.files(s, d).groupBy(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), "[0-9]+", "").alias("file")).agg(F.count("*").alias("n"))
    mark = F.when(F.col("n").isNull(), "+").when(F.col("n") == 1, "=").when(F.col("n") <= 3, "~").otherwise("?")
    prior = touch.join(landed(s, d), "path").filter("lower(task) <> k").groupBy("id", "task").agg(F.max("at").alias("at"))
    prior = prior.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last("at"), "task"))).filter("r <= 6")
    child = q.select("id", "k").join(i.select(F.col("pk").alias("k"), F.col("id").alias("c"), "num"), "k")
    child = child.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("num", "c"))).filter("r <= 5")
    rules = document_lines(s, d).filter(F.col("text").startswith("- ")).withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]+"), 0))))
    norm = touch.withColumn("word", F.regexp_extract("path", "([A-Za-z]+)[.]", 1)).join(rules, "word").select("id", "text", "doc_id", "line").distinct()
    norm = norm.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("doc_id", "line"))).filter("r <= 6")
    out = part(q, "issue", F.col("summary")).unionByName(part(touch.join(known, "file", "left"), "touch", F.col("path"), mark))
    return out.unionByName(part(prior, "prior", F.col("task"))).unionByName(part(child, "child", F.col("c"))).unionByName(part(norm, "norm", F.col("text")))


SLOTS = 5
POOL = max(15, 4 * SLOTS)


@query(f"SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY coalesce(priority_rank, 999), num, id)::INT AS place FROM iss WHERE resolved IS NULL AND k NOT IN (SELECT pk FROM iss WHERE pk IS NOT NULL) QUALIFY place <= {POOL}")
def x7_candidate_pool(s: SparkSession, d: str) -> DataFrame:
    """Open leaves of the hierarchy, of each project the most urgent, four for each slot and 15 at least."""
    i = b.issues(s, d)
    leaves = i.filter("resolved IS NULL").join(i.filter("pk IS NOT NULL").select(F.col("pk").alias("k")), "k", "left_anti")
    r = F.row_number().over(W.partitionBy("project").orderBy(F.coalesce("priority_rank", F.lit(999)), "num", "id"))
    return leaves.withColumn("place", r).filter(F.col("place") <= POOL).select("project", "id", "place")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n, sum(floor(l_extendedprice * l_discount + 0.5))::BIGINT AS attributed FROM lineitem GROUP BY ALL", bare=True)
def a3_on_lineitem(s: SparkSession, d: str) -> DataFrame:
    """The category roll-up on the large star table: rounded by row, then summed."""
    li = table(s, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.sum(half_up(F.col("l_extendedprice") * F.col("l_discount"))).alias("attributed"))


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1", bare=True)
def j6_on_orders(s: SparkSession, d: str) -> DataFrame:
    big = table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM o WHERE r = 1", bare=True)
def w2_on_orders(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    best = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"))
    return best.select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2023-01-01'), n AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' ELSE 'removed' END AS mark FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL", bare=True)
def u5_on_orders(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return op.compared(o.filter("o_orderdate < TIMESTAMP_NTZ '2023-01-01 00:00:00'"), o.filter("o_orderkey % 3 <> 0"), ["o_orderkey"], ["o_totalprice"])
