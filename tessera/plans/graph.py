"""Graphs and the resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import graph as op
from tessera.operators import resolve, walks
from tessera.functions.text import line_diff
from tessera.operators.filters import base_type
from tessera.operators.tables import narrowest
from tessera.plans import base as b
from tessera.plans.joins import _EDGES, _LINKS, _MATCHED, _VERSIONS, document_files, document_tasks, landed, reference_edges, two_versions, type_files, used_names, version_matches
from tessera.plans.scans import document_lines
from tessera.session import table

query = b.Registry()
QUERIES, SQL = query.queries, query.sql
TYPES = "('class', 'interface', 'object', 'enum')"


def parent_edges(s: SparkSession, d: str) -> DataFrame:
    """(a, b): parent to child among the mirrored issues."""
    i = b.issues(s, d).select("k", "pk")
    return i.join(i.select(F.col("k").alias("pk")), "pk", "left_semi").select(F.col("pk").alias("a"), F.col("k").alias("b"))


@query()
def g1_descendants(s: SparkSession, d: str) -> DataFrame:
    """All below each issue that has no parent, as a set."""
    i = b.issues(s, d)
    roots = i.filter("pk IS NULL").select(F.col("k").alias("id"))
    return op.reach(roots, parent_edges(s, d)).filter("depth > 0").select("start", "id", F.col("depth").cast("bigint").alias("depth"))


SQL["g1_descendants"] = b.PRELUDE + ", r AS (SELECT k AS start, k AS id, 0::BIGINT AS depth FROM iss WHERE pk IS NULL UNION SELECT r.start, i.k, r.depth + 1 FROM r JOIN iss i ON i.pk = r.id) SELECT start, id, depth FROM r WHERE depth > 0"

_N, _EVERY = 40, 4


def _ranks(edges: str, nodes: str, focus: str | None) -> str:
    """PageRank in SQL, 40 rounds or fewer when they settle, one common table after the other, as recursion cannot aggregate."""
    jump = f"(1.0 / (SELECT count(*) FROM {nodes}))" if focus is None else f"(CASE WHEN id IN (SELECT id FROM {focus}) THEN 1.0 / (SELECT count(*) FROM {focus}) ELSE 0 END)"
    out = f", nd AS MATERIALIZED (SELECT id, {jump} AS jump, id IN (SELECT a FROM {edges}) AS out FROM {nodes}), sh AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS s FROM {edges}), p0 AS MATERIALIZED (SELECT id, jump AS rank FROM nd)"
    for i in range(1, _N + 1):
        out += f", p{i} AS MATERIALIZED (SELECT nd.id, 0.85 * coalesce(g, 0) + (0.85 * (SELECT coalesce(sum(rank), 0) FROM p{i - 1} JOIN nd USING (id) WHERE NOT out) + 0.15) * jump AS rank FROM nd LEFT JOIN (SELECT b, sum(rank * s) AS g FROM p{i - 1} JOIN sh ON sh.a = p{i - 1}.id GROUP BY 1) x ON x.b = nd.id)"
    checks = list(range(_EVERY, _N + 1, _EVERY))
    out += ", mv AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(abs(x.rank - y.rank)) FROM p{k} x JOIN p{k - 1} y USING (id)) AS moved" for k in checks) + f"), stp AS (SELECT coalesce(min(k) FILTER (moved < 1e-7), {_N}) AS k FROM mv)"
    return out + " SELECT id, round(rank, 6) AS rank FROM (" + " UNION ALL ".join(f"SELECT id, rank, {k} AS k FROM p{k}" for k in checks) + ") JOIN stp USING (k)"


@query(f"WITH {_EDGES}, nn AS (SELECT id FROM f)" + _ranks("ed", "nn", None))
def g2_page_rank(s: SparkSession, d: str) -> DataFrame:
    r = op.page_rank(b.files(s, d).select("id"), reference_edges(s, d), rounds=_N, every=_EVERY)
    return r.select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_EDGES}, nn AS (SELECT id FROM f), fo AS (SELECT id FROM f WHERE module = 'core' AND id % 5 = 0), eb AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM ed UNION ALL SELECT b, a, w * 0.5 FROM ed) GROUP BY ALL)" + _ranks("eb", "nn", "fo"))
def g3_focused_rank(s: SparkSession, d: str) -> DataFrame:
    """With a focus set, edges count half in the other direction as well."""
    e = reference_edges(s, d)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("w") * 0.5).alias("w")))
    f = b.files(s, d)
    r = op.page_rank(f.select("id"), both, f.filter("module = 'core' AND id % 5 = 0").select("id"), rounds=_N, every=_EVERY)
    return r.select("id", F.round("rank", 6).alias("rank"))


_SUPER = f"""sup AS (SELECT name AS a, trim(regexp_replace(s, '<.*>', '')) AS b FROM (SELECT name, unnest(string_split(supertypes, ' ')) AS s FROM de WHERE kind IN {TYPES} AND supertypes <> '') WHERE s <> ''
 UNION SELECT name, regexp_extract(container, '[^.]*$') FROM de WHERE kind IN {TYPES} AND container <> '')"""


def supertype_edges(s: SparkSession, d: str) -> DataFrame:
    """(a, b): a type's name and the types it stands under, its supertypes without arguments and the type around it; outside names are kept."""
    rows = b.decls(s, d).filter(F.col("kind").isin("class", "interface", "object", "enum"))
    named = rows.filter("supertypes <> ''").select(F.col("name").alias("a"), F.explode(F.split("supertypes", " ")).alias("s")).filter("s <> ''").select("a", base_type(F.col("s")).alias("b"))
    around = rows.filter("container <> ''").select(F.col("name").alias("a"), F.regexp_extract("container", "[^.]*$", 0).alias("b"))
    return named.unionByName(around).distinct()


@query("WITH " + _SUPER + ", cl(start, id, depth) USING KEY (start, id) AS (SELECT a, b, 1::BIGINT FROM sup UNION SELECT DISTINCT cl.start, sup.b, cl.depth + 1 FROM cl JOIN sup ON sup.a = cl.id LEFT JOIN recurring.cl AS seen ON seen.start = cl.start AND seen.id = sup.b WHERE seen.id IS NULL) SELECT start, id, depth FROM cl WHERE id <> start")
def g4_supertypes(s: SparkSession, d: str) -> DataFrame:
    return closed(supertype_edges(s, d))


@query("WITH " + _SUPER + ", cl(start, id, depth) USING KEY (start, id) AS (SELECT b, a, 1::BIGINT FROM sup UNION SELECT DISTINCT cl.start, sup.a, cl.depth + 1 FROM cl JOIN sup ON sup.b = cl.id LEFT JOIN recurring.cl AS seen ON seen.start = cl.start AND seen.id = sup.a WHERE seen.id IS NULL) SELECT start, id, depth FROM cl WHERE id <> start")
def g5_subtypes(s: SparkSession, d: str) -> DataFrame:
    return closed(supertype_edges(s, d).select(F.col("b").alias("a"), F.col("a").alias("b")))


def closed(e: DataFrame) -> DataFrame:
    """(start, id, depth): all that each node with edges (a, b) reaches, but itself."""
    starts = e.select(F.col("a").alias("id")).distinct()
    rows = walks.closure(starts, e)
    rows = op.reach(starts, e).filter("depth > 0") if rows is None else rows
    return rows.select("start", "id", F.col("depth").cast("bigint").alias("depth"))


def type_members(s: SparkSession, d: str) -> DataFrame:
    """(member, type, name, kind, arity): functions by the name of the type they stand in."""
    de = b.decls(s, d).filter("kind IN ('fun', 'method') AND container <> ''")
    return de.select(F.col("id").alias("member"), F.regexp_extract("container", "[^.]*$", 0).alias("type"), "name", "kind", F.col("param_count").alias("arity"))


_MEMBER = "mb AS (SELECT id AS member, regexp_extract(container, '[^.]*$') AS type, name, kind, param_count AS arity FROM de WHERE kind IN ('fun', 'method') AND container <> '')"
_ABOVE = "av(type, above, level) USING KEY (type, above) AS (SELECT a, a, 0::BIGINT FROM (SELECT DISTINCT name AS a FROM de WHERE kind IN ('class', 'interface', 'object', 'enum')) UNION SELECT DISTINCT av.type, sup.b, av.level + 1 FROM av JOIN sup ON sup.a = av.above LEFT JOIN recurring.av AS seen ON seen.type = av.type AND seen.above = sup.b WHERE seen.type IS NULL)"


def type_ids(s: SparkSession, d: str) -> DataFrame:
    return b.decls(s, d).filter(F.col("kind").isin("class", "interface", "object", "enum")).select(F.col("name").alias("id")).distinct()


def types_above(s: SparkSession, d: str) -> DataFrame:
    return resolve.levels(supertype_edges(s, d), type_ids(s, d))


@query(f"WITH {_SUPER}, {_ABOVE}, {_MEMBER} SELECT DISTINCT m.member, o.member AS overridden, level FROM mb m JOIN av ON av.type = m.type AND level > 0 JOIN mb o ON o.type = av.above AND o.name = m.name AND o.kind = m.kind AND o.arity = m.arity WHERE m.member <> o.member")
def g6_overrides(s: SparkSession, d: str) -> DataFrame:
    """Members that repeat one of the same name, kind and number of parameters in a type above theirs."""
    rows = walks.overrides(type_members(s, d), supertype_edges(s, d), type_ids(s, d))
    return resolve.overrides(type_members(s, d), types_above(s, d)) if rows is None else rows


_TREE = "s AS (SELECT id FROM f WHERE id % 50 = 0), e2 AS (SELECT a, b FROM ed QUALIFY row_number() OVER (PARTITION BY b ORDER BY w DESC, a) <= 12), e3 AS (SELECT a, b FROM ed JOIN ex USING (a, b) QUALIFY row_number() OVER (PARTITION BY b ORDER BY w DESC, a) <= 12), l1 AS (SELECT DISTINCT s.id AS root, e2.a AS id FROM s JOIN e2 ON e2.b = s.id WHERE e2.a <> s.id), l2 AS (SELECT DISTINCT root, e3.a AS id FROM l1 JOIN e3 ON e3.b = l1.id), l3 AS (SELECT DISTINCT root, e3.a AS id FROM l2 JOIN e3 ON e3.b = l2.id)"


def exact_edges(s: SparkSession, d: str) -> DataFrame:
    """(a, b): file a names a type of file b, and its scopes leave no doubt which."""
    home = b.decls(s, d).select(F.col("id").alias("target"), F.col("file_id").alias("b"))
    return references(s, d).filter("label = 'EXACT'").join(home, "target").select(F.col("file_id").alias("a"), "b").filter("a <> b").distinct()


def g7_call_tree(s: SparkSession, d: str) -> DataFrame:
    """Callers of the files whose id is divisible by 50, up to three steps up, twelve strongest to a file, beyond the first step by
    exact references only; breadth first, so a file has its least depth."""
    e = reference_edges(s, d)
    strongest = lambda x: x.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("w"), "a"))).filter("r <= 12").select(F.col("b").alias("a"), F.col("a").alias("b"))
    first, later = strongest(e), strongest(e.join(exact_edges(s, d), ["a", "b"], "left_semi"))
    starts = b.files(s, d).filter("id % 50 = 0").select("id")
    near = op.reach(starts, first, 1)
    # From the first step on only exact links lead further.
    step = near.filter("depth = 1").select("start", "id")
    far = op.reach(step.select("id").distinct(), later, 2).select(F.col("start").alias("via"), "id", (F.col("depth") + 1).alias("depth"))
    rows = near.unionByName(step.select("start", F.col("id").alias("via")).join(far, "via").select("start", "id", "depth")).filter("id <> start")
    return rows.groupBy(F.col("start").alias("root"), "id").agg(F.min("depth").cast("bigint").alias("depth"))


@query("WITH x AS (SELECT p.k AS start, c.k AS id, 1 AS depth FROM iss p JOIN iss c ON c.pk = p.k), y AS (SELECT x.start, c.k AS id, 2 AS depth FROM x JOIN iss c ON c.pk = x.id), z AS (SELECT y.start, c.k AS id, 3 AS depth FROM y JOIN iss c ON c.pk = y.id) SELECT start, id, 'children' AS link, min(depth)::BIGINT AS depth FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z) WHERE id <> start GROUP BY ALL UNION ALL SELECT id, start, 'parents', min(depth)::BIGINT FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z) WHERE id <> start GROUP BY ALL UNION ALL SELECT DISTINCT i.k, lower(m), 'mentions', 1 FROM (SELECT k, unnest(regexp_extract_all(summary || ' ' || coalesce(json->>'description', ''), '[A-Z]{2,4}-[0-9]+')) AS m FROM iss) i JOIN iss t ON t.k = lower(m) WHERE t.k <> i.k")
def g8_task_graph(s: SparkSession, d: str) -> DataFrame:
    """Typed links of tasks: children and parents as chains, each in its own direction, three deep, each task once at its least depth;
    mentions one step."""
    i, e = b.issues(s, d), parent_edges(s, d)
    down = op.reach(e.select(F.col("a").alias("id")).distinct(), e, 3).filter("depth > 0 AND id <> start")
    rows = down.select("start", "id", F.lit("children").alias("link"), F.col("depth").cast("bigint").alias("depth"))
    rows = rows.unionByName(down.select(F.col("id").alias("start"), F.col("start").alias("id"), F.lit("parents").alias("link"), F.col("depth").cast("bigint").alias("depth")))
    text = F.concat_ws(" ", "summary", F.coalesce(F.get_json_object("json", "$.description"), F.lit("")))
    said = i.select(F.col("k").alias("start"), F.explode(F.transform(F.regexp_extract_all(text, F.lit("[A-Z]{2,4}-[0-9]+"), 0), F.lower)).alias("id")).distinct()
    known = said.join(i.select(F.col("k").alias("id")), "id", "left_semi").filter("id <> start")
    return rows.unionByName(known.select("start", "id", F.lit("mentions").alias("link"), F.lit(1).cast("bigint").alias("depth")))


FRONTIER, REFERENCES = 40, 2000
_REACH = "er AS (SELECT DISTINCT b AS a2, a AS b2 FROM ed), lev0 AS (SELECT id AS start, id, 0 AS depth FROM f WHERE source_set = 'main'), seen0 AS (SELECT * FROM lev0)" + "".join(
    f", fr{k} AS (SELECT start, id FROM lev{k - 1} QUALIFY row_number() OVER (PARTITION BY start ORDER BY id) <= {FRONTIER}), ee{k} AS (SELECT start, b2 AS id FROM fr{k} JOIN er ON a2 = fr{k}.id QUALIFY row_number() OVER (PARTITION BY start ORDER BY a2, b2) <= {REFERENCES}), lev{k} AS MATERIALIZED (SELECT DISTINCT start, id, {k} AS depth FROM ee{k} ANTI JOIN seen{k - 1} USING (start, id)), seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT * FROM lev{k})"
    for k in (1, 2, 3)
)
_REACHED = "rt AS (SELECT start, id, depth::BIGINT AS depth FROM seen3 WHERE depth > 0 AND id IN (SELECT id FROM f WHERE source_set = 'test'))"


@query(f"WITH {_EDGES}, {_REACH}, {_REACHED} SELECT * FROM rt")
def g9_test_reach(s: SparkSession, d: str) -> DataFrame:
    """Test files within three steps of users of each main file, going on from 40 files over 2 000 references in each step."""
    starts, declared, used, tests = reach_tables(s, d)
    r = walks.budgeted_by_name(starts, declared, used, 3, FRONTIER, REFERENCES, tests)
    if r is None:
        r = op.reach(starts, user_edges(s, d), 3, FRONTIER, REFERENCES).filter("depth > 0").join(tests, "id", "left_semi")
    return r.select("start", "id", F.col("depth").cast("bigint").alias("depth"))


def reach_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Main files (id), files that declare a type's name (a, name) or use a name (b, name), test files (id)."""
    f = b.files(s, d)
    declared, used = type_files(s, d).withColumnRenamed("b", "a"), used_names(s, d).withColumnRenamed("a", "b")
    return f.filter("source_set = 'main'").select("id"), declared, used, f.filter("source_set = 'test'").select("id")


def user_edges(s: SparkSession, d: str) -> DataFrame:
    """(a, b): file b names a type of file a."""
    return reference_edges(s, d).select(F.col("b").alias("a"), F.col("a").alias("b"))


def tests_reached(s: SparkSession, d: str) -> DataFrame:
    """(start, n): how many test files are among the users of a main file and theirs, three steps up, all of them followed."""
    starts, declared, used, tests = reach_tables(s, d)
    r = walks.reached_by_name(starts, declared, used, 3, tests)
    if r is not None:
        return r
    r = op.reach(starts, user_edges(s, d), 3).filter("depth > 0").join(tests, "id", "left_semi")
    return r.groupBy("start").agg(F.count("*").alias("n"))


_TOUCHES = f"{_LINKS}, tx AS (SELECT DISTINCT task, path FROM lk JOIN fl USING (doc_id) JOIN documents USING (doc_id) WHERE source = 'commit_messages' AND NOT path LIKE '%.md')"


def touches(s: SparkSession, d: str) -> DataFrame:
    """(task, path): what the commits that name a task touch; prose files never block."""
    docs = b.documents(s, d).filter("source = 'commit_messages'").select("doc_id")
    return document_tasks(s, d).join(document_files(s, d), "doc_id").join(docs, "doc_id", "left_semi").select("task", "path").distinct().filter(~F.col("path").endswith(".md"))


def conflict_edges(t: DataFrame) -> DataFrame:
    """(a, b) that join tasks of one directory: each with the directory's least task, a star and not all pairs."""
    dirs = t.select("task", F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).distinct()
    least = dirs.groupBy("dir").agg(F.min("task").alias("a"))
    return dirs.join(least, "dir").select("a", F.col("task").alias("b")).distinct()


@query(f"WITH {_TOUCHES}, dr AS (SELECT DISTINCT task, split_part(path, '/', 1) AS dir FROM tx), rc AS (SELECT task AS start, task AS id FROM dr UNION SELECT rc.start, y.task FROM rc JOIN dr x ON x.task = rc.id JOIN dr y ON y.dir = x.dir) SELECT start AS id, min(id) AS component FROM rc GROUP BY 1")
def g10_conflict_groups(s: SparkSession, d: str) -> DataFrame:
    t = touches(s, d)
    return op.components(t.select(F.col("task").alias("id")), conflict_edges(t))


SLOTS, BATCH = 4, 3
_COMPONENTS = f"{_TOUCHES}, dr AS (SELECT DISTINCT lower(task) AS task, split_part(path, '/', 1) AS dir FROM tx), rc AS (SELECT task AS start, task AS id FROM dr UNION SELECT rc.start, y.task FROM rc JOIN dr x ON x.task = rc.id JOIN dr y ON y.dir = x.dir), cp AS (SELECT start AS id, min(id) AS component FROM rc GROUP BY 1)"
_PLAN = f"""{_COMPONENTS}, tk AS (SELECT cp.id, component, coalesce(priority_rank, 1 << 30) AS rank, coalesce(num, 0) AS num FROM cp LEFT JOIN iss ON iss.k = cp.id), nd AS (SELECT t.id, i.pk AS need FROM tk t JOIN iss i ON i.k = t.id JOIN tk u ON u.id = i.pk AND u.component = t.component)""" + "".join(
    f", pl{k} AS (SELECT id, {k} AS place FROM tk WHERE " + " AND ".join(["true"] + [f"id NOT IN (SELECT id FROM pl{x})" for x in range(1, k)]) + " QUALIFY row_number() OVER (PARTITION BY component ORDER BY CASE WHEN id IN (SELECT id FROM nd WHERE " + " AND ".join(["true"] + [f"need NOT IN (SELECT id FROM pl{x})" for x in range(1, k)]) + ") THEN 1 ELSE 0 END, rank, num, id) = 1)"
    for k in range(1, BATCH + 1)
)


@query(f"WITH {_PLAN}, gr AS (SELECT component, row_number() OVER (ORDER BY min(rank), min(num), component)::INT AS slot FROM tk GROUP BY 1), al AS (" + " UNION ALL ".join(f"SELECT * FROM pl{k}" for k in range(1, BATCH + 1)) + f") SELECT component, tk.id, CASE WHEN slot > {SLOTS} THEN 'no free window' WHEN place IS NULL THEN 'after the batch' ELSE 'window' END AS state, place, CASE WHEN slot <= {SLOTS} THEN slot END AS slot FROM tk LEFT JOIN al USING (id) JOIN gr USING (component)")
def g10_dispatch(s: SparkSession, d: str) -> DataFrame:
    """Groups of conflicting or dependent tasks as windows, the most urgent first, for four slots: of each group a batch of three in
    dependency order, the rest after it."""
    t = touches(s, d).select(F.lower("task").alias("task"), "path").distinct()
    groups = op.components(t.select(F.col("task").alias("id")), conflict_edges(t))
    i = b.issues(s, d).select(F.col("k").alias("id"), F.col("priority_rank").alias("rank"), "num", "pk")
    tasks = groups.join(i, "id", "left").select("id", "component", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), F.coalesce("num", F.lit(0)).alias("num"))
    placed = op.first_of_groups(tasks, i.filter("pk IS NOT NULL").select("id", F.col("pk").alias("need")), BATCH)
    order = tasks.groupBy("component").agg(F.min("rank").alias("r"), F.min("num").alias("n"))
    best = order.orderBy("r", "n", "component").limit(SLOTS)  # only these get a number by order among themselves
    window = best.withColumn("slot", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("r", "n", "component"))).select("component", "slot")
    rows = tasks.select("component", "id").join(placed, "id", "left").join(F.broadcast(window), "component", "left")
    state = F.when(F.col("slot").isNull(), "no free window").when(F.col("place").isNull(), "after the batch").otherwise("window")
    return rows.select("component", "id", state.alias("state"), "place", "slot")


@query("WITH ns AS (SELECT k AS id, pk AS need FROM iss WHERE pk IS NOT NULL), t0 AS (SELECT k AS id FROM iss), " + ", ".join(f"t{i} AS (SELECT id FROM t{i - 1} WHERE id NOT IN (SELECT id FROM ns WHERE need NOT IN (SELECT id FROM t{i - 1})))" for i in range(1, 16)) + " SELECT id FROM t15")
def g11_unmet_fixpoint(s: SparkSession, d: str) -> DataFrame:
    """Tasks whose parents, and theirs, are all in the mirror."""
    i = b.issues(s, d)
    return op.settled(i.select(F.col("k").alias("id")), i.filter("pk IS NOT NULL").select(F.col("k").alias("id"), F.col("pk").alias("need")))


_IMPORT = r"^import +(static +)?([A-Za-z0-9_.]+?)(\.\*)?( +as +([A-Za-z0-9_]+))? *;?$"
_RES = f"""il AS (SELECT id AS file_id, regexp_extract(text, '{_IMPORT}', 2) AS fqn, regexp_extract(text, '{_IMPORT}', 3) AS star, regexp_extract(text, '{_IMPORT}', 5) AS alias FROM ln WHERE starts_with(text, 'import ')),
im AS (SELECT DISTINCT file_id, fqn, coalesce(nullif(alias, ''), regexp_extract(fqn, '[^.]*$')) AS name FROM il WHERE star = '' AND fqn <> ''), sr AS (SELECT DISTINCT file_id, fqn AS package FROM il WHERE star <> ''),
rf AS (SELECT DISTINCT id AS file_id, unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9]+')) AS name FROM ln WHERE NOT starts_with(text, 'import ')),
ty AS (SELECT DISTINCT de.id, name, fqn, package, file_id FROM de JOIN (SELECT id AS fid, package FROM f) ON fid = file_id WHERE kind IN {TYPES}),
cand AS (SELECT rf.file_id, rf.name, ty.id AS target, 0 AS level FROM rf JOIN ty ON ty.name = rf.name AND ty.file_id = rf.file_id
 UNION ALL SELECT rf.file_id, rf.name, ty.id, 1 FROM rf JOIN im USING (file_id, name) JOIN ty ON ty.fqn = im.fqn
 UNION ALL SELECT rf.file_id, rf.name, ty.id, 2 FROM rf JOIN f ON f.id = rf.file_id JOIN ty ON ty.package = f.package AND ty.name = rf.name
 UNION ALL SELECT rf.file_id, rf.name, ty.id, 3 FROM rf JOIN sr USING (file_id) JOIN ty ON ty.package = sr.package AND ty.name = rf.name),
ne AS (SELECT DISTINCT file_id, name, target, level FROM cand QUALIFY level = min(level) OVER (PARTITION BY file_id, name)),
lb AS (SELECT rf.file_id, rf.name, coalesce(k.near, a.target) AS target, CASE WHEN k.k = 1 THEN 'EXACT' WHEN k.k > 1 THEN 'CANDIDATE' ELSE 'OTHER' END AS label FROM rf LEFT JOIN (SELECT file_id, name, min(target) AS near, count(*) AS k FROM ne GROUP BY ALL) k USING (file_id, name) LEFT JOIN (SELECT name, min(id) AS target FROM ty GROUP BY 1) a ON a.name = rf.name WHERE coalesce(k.near, a.target) IS NOT NULL)"""
SQL["g7_call_tree"] = b.PRELUDE + f", {_EDGES}, {_RES}, ex AS (SELECT DISTINCT lb.file_id AS a, de.file_id AS b FROM lb JOIN de ON de.id = lb.target WHERE label = 'EXACT' AND lb.file_id <> de.file_id), {_TREE} SELECT root, id, min(depth)::BIGINT AS depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) WHERE id <> root GROUP BY ALL"
QUERIES["g7_call_tree"] = g7_call_tree


def import_lines(s: SparkSession, d: str) -> DataFrame:
    """(file_id, fqn, star, name): what a file imports, and by which name."""
    part = lambda n: F.regexp_extract("text", _IMPORT, n)
    rows = b.lines(s, d).filter(F.col("text").startswith("import ")).select(F.col("id").alias("file_id"), part(2).alias("fqn"), (part(3) != "").alias("star"), part(5).alias("alias"))
    return rows.filter("fqn <> ''").select("file_id", "fqn", "star", F.coalesce(F.nullif("alias", F.lit("")), F.regexp_extract("fqn", "[^.]*$", 0)).alias("name"))


def type_names(s: SparkSession, d: str) -> DataFrame:
    """(file_id, name): the words of a file that may be names of types, but for its imports."""
    ln = b.lines(s, d).filter(~F.col("text").startswith("import "))
    return ln.select(F.col("id").alias("file_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z0-9]+"), 0)).alias("name")).distinct()


def declared_types(s: SparkSession, d: str) -> DataFrame:
    """(target, name, fqn, package, home)"""
    f = b.files(s, d).select(F.col("id").alias("file_id"), "package")
    types = b.decls(s, d).filter(F.col("kind").isin("class", "interface", "object", "enum")).join(f, "file_id")
    return types.select(F.col("id").alias("target"), "name", "fqn", "package", F.col("file_id").alias("home")).distinct()


def resolved(s: SparkSession, d: str) -> DataFrame:
    """(file_id, name, target, level): the declarations that a type name may mean by its nearest scope."""
    imports = import_lines(s, d)
    stars = imports.filter("star").select("file_id", F.col("fqn").alias("package"))
    packages = b.files(s, d).select(F.col("id").alias("file_id"), "package")
    return resolve.scoped(type_names(s, d), declared_types(s, d), imports.filter("NOT star"), stars, packages)


def references(s: SparkSession, d: str) -> DataFrame:
    return resolve.labelled(type_names(s, d), resolved(s, d), declared_types(s, d))


@query(f"WITH {_RES} SELECT file_id, name, target, label FROM lb")
def r1_resolution(s: SparkSession, d: str) -> DataFrame:
    return references(s, d)


@query(f"WITH {_RES} SELECT file_id, name, target, level FROM ne WHERE level > 0")
def r2_visibility(s: SparkSession, d: str) -> DataFrame:
    """What a file sees beyond its own declarations: by explicit import, else in its package, else by an import of a whole package."""
    return resolved(s, d).filter("level > 0")


_CALLS = "ca AS (SELECT id AS file_id, line, c, regexp_extract(c, '[A-Za-z0-9_]+') AS name FROM (SELECT id, line, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.])[a-z][A-Za-z0-9_]*\\([^()]*\\)')) AS c FROM ln WHERE NOT regexp_matches(text, '(^|[^A-Za-z0-9_])fun ')))"
_IN_TYPE = "ct AS (SELECT ca.*, regexp_extract(de.container, '[^.]*$') AS type FROM ca JOIN de ON de.file_id = ca.file_id AND ca.line BETWEEN start_line AND end_line WHERE kind IN ('fun', 'method') AND container <> '' QUALIFY row_number() OVER (PARTITION BY ca.file_id, ca.line, c ORDER BY end_line - start_line, start_line DESC, type) = 1)"


def call_lines(s: SparkSession, d: str) -> DataFrame:
    """(file_id, line, c, name, args): calls without a receiver and without calls in their arguments."""
    ln = b.lines(s, d).filter(~F.col("text").rlike("(^|[^A-Za-z0-9_])fun "))
    c = ln.select(F.col("id").alias("file_id"), "line", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_.])[a-z][A-Za-z0-9_]*\([^()]*\)"), 0)).alias("c"))
    inner = F.regexp_extract("c", r"\(([^()]*)\)", 1)
    return c.withColumns({"name": F.regexp_extract("c", "[A-Za-z0-9_]+", 0), "args": F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))})


def calls_in_types(s: SparkSession, d: str) -> DataFrame:
    """`call_lines` with the type of the innermost function around, one row for each call written on a line."""
    funs = b.decls(s, d).filter("kind IN ('fun', 'method') AND container <> ''").withColumn("type", F.regexp_extract("container", "[^.]*$", 0))
    return narrowest(call_lines(s, d).distinct(), funs, "file_id", "line", "start_line", "end_line", ["type"], ["file_id", "line", "c", "name", "args"]).filter("type IS NOT NULL")


@query(f"WITH {_SUPER}, {_ABOVE}, {_MEMBER}, {_CALLS}, {_IN_TYPE}, h AS (SELECT DISTINCT file_id, line, ct.name, member, level FROM ct JOIN av ON av.type = ct.type JOIN mb ON mb.type = av.above AND mb.name = ct.name) SELECT *, level = min(level) OVER (PARTITION BY file_id, line, name) AS nearest FROM h")
def r3_member_lookup(s: SparkSession, d: str) -> DataFrame:
    """What a call inside a type means: a member of the type, or of a type above it; the nearest level wins, the others are kept."""
    key = ["file_id", "line", "name"]
    uses = calls_in_types(s, d).select(*key, "type").distinct()
    rows = walks.member_lookup(uses, key, type_members(s, d), supertype_edges(s, d), type_ids(s, d))
    if rows is not None:
        return rows
    uses = uses.select(F.struct(*key).alias("use"), "type", "name")
    return resolve.member_lookup(uses, type_members(s, d), types_above(s, d)).select("use.*", "member", "level", "nearest")


_REQUIRED = "len(list_filter(from_json(coalesce(params, '[]'), '[\"JSON\"]'), lambda x: coalesce(x->>'default', 'false') NOT IN ('true', '1') AND coalesce(x->>'vararg', 'false') NOT IN ('true', '1')))"
_MANY = "coalesce(len(list_filter(from_json(coalesce(params, '[]'), '[\"JSON\"]'), lambda x: coalesce(x->>'vararg', 'false') IN ('true', '1'))) > 0, false)"
_ARGS = "CASE WHEN trim(regexp_extract(c, '\\(([^()]*)\\)', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(c, '\\(([^()]*)\\)', 1), ',')) END"


@query(f"WITH {_CALLS}, x AS (SELECT DISTINCT file_id, line, c, name, {_ARGS} AS args FROM ca), p AS (SELECT id, file_id, name, param_count AS total, {_REQUIRED} AS required, {_MANY} AS many FROM de WHERE kind IN ('fun', 'method')) SELECT x.file_id, line, trim(c) AS call, p.id, required <= args AND (many OR args <= total) AS fits FROM x JOIN p ON p.file_id = x.file_id AND p.name = x.name")
def r4_argument_count(s: SparkSession, d: str) -> DataFrame:
    """Calls of the functions of a file, and whether the number of arguments fits: defaults may be left out, a vararg takes any number."""
    p = b.decls(s, d).filter("kind IN ('fun', 'method')").select("id", "file_id", "name", F.col("param_count").alias("total"), "params")
    x = call_lines(s, d).distinct().join(p, ["file_id", "name"])
    return x.select("file_id", "line", F.trim("c").alias("call"), "id", resolve.accepts(F.col("params"), F.col("total"), F.col("args")).alias("fits"))


@query(f"WITH {_RES}, o AS (SELECT file_id, name FROM lb WHERE label = 'OTHER'), xt AS (SELECT DISTINCT name FROM im WHERE fqn NOT IN (SELECT fqn FROM ty)), one AS (SELECT name, min(id) AS target FROM ty GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT file_id, name, target FROM o JOIN one USING (name) ANTI JOIN xt USING (name)")
def r5_promotion(s: SparkSession, d: str) -> DataFrame:
    """A name outside every scope means the only declaration of that name, unless some file takes the name from elsewhere."""
    types = declared_types(s, d)
    outside = import_lines(s, d).filter("NOT star").join(types.select("fqn"), "fqn", "left_anti").select("name")
    return resolve.promoted(references(s, d).filter("label = 'OTHER'"), types, outside)


@query("WITH " + _SUPER + ", t0 AS (SELECT DISTINCT name AS id, name AS at_ FROM de WHERE kind IN ('class', 'object')), " + ", ".join(f"t{i} AS (SELECT t.id, coalesce(m.b, t.at_) AS at_ FROM t{i - 1} t LEFT JOIN (SELECT a, min(b) AS b FROM sup GROUP BY 1) m ON m.a = t.at_)" for i in range(1, 7)) + " SELECT id, at_ AS spec FROM t6")
def r6_type_specs(s: SparkSession, d: str) -> DataFrame:
    """A type followed to its first supertype, six steps at most; what names no further type stays."""
    t = b.decls(s, d).filter("kind IN ('class', 'object')").select(F.col("name").alias("id")).distinct().withColumn("spec", F.col("id"))
    up = supertype_edges(s, d).groupBy(F.col("a").alias("spec")).agg(F.min("b").alias("next"))
    for _ in range(6):
        t = t.join(up, "spec", "left").select("id", F.coalesce("next", "spec").alias("spec"))
    return t


_LAMBDA = r"^(?:suspend )?(?:([A-Za-z0-9_.<>?]+)\.)?\(([^()]*)\) -> (.+)$"


@query(f"WITH {_RES}, pr AS (SELECT id, file_id, p->>'name' AS param, p->>'type' AS type FROM (SELECT id, file_id, unnest(from_json(params, '[\"JSON\"]')) AS p FROM de WHERE params LIKE '%->%')), x AS (SELECT id, file_id, param, regexp_extract(type, '{_LAMBDA}', 1) AS receiver, regexp_extract(type, '{_LAMBDA}', 3) AS result FROM pr WHERE regexp_matches(type, '{_LAMBDA}')) SELECT x.id, param, receiver, result, min(ty.id) AS target FROM x LEFT JOIN ty ON ty.name = regexp_replace(receiver, '<.*>|\\?', '', 'g') AND receiver <> '' GROUP BY ALL")
def r7_lambda_types(s: SparkSession, d: str) -> DataFrame:
    """Parameters that take a function: its receiver, with the declaration of that name, and its result."""
    de = b.decls(s, d).filter(F.col("params").contains("->")).select("id", F.explode(F.from_json("params", "array<map<string,string>>")).alias("p"))
    t = F.col("p")["type"]
    x = de.filter(t.rlike(_LAMBDA)).select("id", F.col("p")["name"].alias("param"), F.regexp_extract(t, _LAMBDA, 1).alias("receiver"), F.regexp_extract(t, _LAMBDA, 3).alias("result"))
    types = resolve.anywhere(declared_types(s, d)).select("name", "target")
    named = x.withColumn("name", F.when(F.col("receiver") != "", F.regexp_replace("receiver", r"<.*>|\?", "")))
    return named.join(types, "name", "left").select("id", "param", "receiver", "result", "target")


_LINE_OF = "at_ AS (SELECT id AS file_id, line FROM ln UNION SELECT file_id, start_line::BIGINT FROM de), aq AS (SELECT f.id AS file_id, f.path || ':' || line AS asked, line FROM at_ JOIN f ON f.id = at_.file_id), nl AS (SELECT file_id, start_line, end_line, fqn FROM de WHERE local = 0)"


@query(f"WITH {_LINE_OF}, ins AS (SELECT asked, fqn FROM aq JOIN de USING (file_id) WHERE line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY asked ORDER BY end_line - start_line, start_line DESC, fqn) = 1), oth AS (SELECT aq.* FROM aq ANTI JOIN ins USING (asked)), af AS (SELECT asked, fqn FROM oth JOIN nl USING (file_id) WHERE start_line > line QUALIFY row_number() OVER (PARTITION BY asked ORDER BY start_line, start_line - end_line, fqn) = 1), bf AS (SELECT asked, fqn FROM oth JOIN nl USING (file_id) WHERE end_line < line QUALIFY row_number() OVER (PARTITION BY asked ORDER BY end_line DESC, start_line - end_line, fqn) = 1) SELECT * FROM ins UNION ALL SELECT * FROM af UNION ALL SELECT bf.* FROM bf ANTI JOIN af USING (asked)")
def r9_symbol_at(s: SparkSession, d: str) -> DataFrame:
    """`path:line` to the innermost declaration there, for every line of every file and every line on which a declaration begins.

    Outside all declarations it is the first that begins after the line and is not local, or else the last that ends before it.
    """
    de = b.decls(s, d)
    at = b.lines(s, d).select(F.col("id").alias("file_id"), "line").unionByName(de.select("file_id", F.col("start_line").cast("bigint").alias("line"))).distinct()
    asked = at.join(b.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("file_id", F.concat_ws(":", "path", "line").alias("asked"), "line")
    found = narrowest(asked, de, "file_id", "line", "start_line", "end_line", ["fqn"], ["asked"])
    rest = asked.join(found.filter("fqn IS NULL"), "asked", "left_semi").join(de.filter("local = 0").select("file_id", "start_line", "end_line", "fqn"), "file_id")
    wide = F.col("start_line") - F.col("end_line")
    after = F.min(F.when(F.col("start_line") > F.col("line"), F.struct("start_line", wide.alias("wide"), "fqn")))
    before = F.min(F.when(F.col("end_line") < F.col("line"), F.struct((-F.col("end_line")).alias("end"), wide.alias("wide"), "fqn")))
    near = rest.groupBy("asked").agg(F.coalesce(after["fqn"], before["fqn"]).alias("fqn"))
    return found.select("asked", "fqn").filter("fqn IS NOT NULL").unionByName(near.filter("fqn IS NOT NULL"))


_TYPES_OF = "CASE WHEN coalesce(params, '') = '' OR param_count = 0 THEN '' ELSE array_to_string(list_transform(from_json(params, '[\"JSON\"]'), lambda x: x->>'type'), ', ') END"
_KEYS = f"ky AS (SELECT id, regexp_extract(container, '[^.]*$') || '.' || name || '(' || {_TYPES_OF} || ')' AS key, 0 AS pref FROM de WHERE kind IN ('fun', 'method') AND container <> '' UNION ALL SELECT id, regexp_extract(container, '[^.]*$') || '.' || name, 1 FROM de WHERE container <> '' UNION ALL SELECT id, regexp_extract(container, '([^.]+)[.]Companion$', 1) || '.' || name, 2 FROM de WHERE container LIKE '%.Companion')"


@query(f"WITH {_KEYS}, aq AS (SELECT DISTINCT key AS asked FROM ky WHERE pref < 2) SELECT asked, min(id) AS id, count(DISTINCT id) AS n FROM (SELECT asked, id, pref FROM aq JOIN ky ON key = asked QUALIFY pref = min(pref) OVER (PARTITION BY asked)) GROUP BY 1")
def r9_symbols(s: SparkSession, d: str) -> DataFrame:
    """`Type.member(Param)` and `Type.member` to the least declaration so called and their number; a member of a type's companion
    answers where the type has none itself. Asked for all members."""
    de = b.decls(s, d).filter("container <> ''")
    types = F.when((F.coalesce("params", F.lit("")) == "") | (F.col("param_count") == 0), "").otherwise(F.array_join(F.transform(F.from_json("params", "array<map<string,string>>"), lambda x: x["type"]), ", "))
    owner, member = F.regexp_extract("container", "[^.]*$", 0), F.col("name")
    around = F.regexp_extract("container", r"([^.]+)\.Companion$", 1)
    key = lambda k, pref: F.struct(k.alias("key"), F.lit(pref).alias("level"))
    keys = F.array(
        key(F.when(F.col("kind").isin("fun", "method"), F.concat(owner, F.lit("."), member, F.lit("("), types, F.lit(")"))), 0),
        key(F.concat(owner, F.lit("."), member), 1), key(F.when(F.col("container").endswith(".Companion"), F.concat(around, F.lit("."), member)), 2),
    )
    rows = de.select("id", F.explode(keys).alias("x")).select("id", F.col("x.key").alias("asked"), "x.level").filter("asked IS NOT NULL")
    best = resolve.nearest(rows, ["asked"]).join(rows.filter("level < 2").select("asked").distinct(), "asked", "left_semi")
    return best.groupBy("asked").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))


@query("WITH " + _SUPER + ", k AS (SELECT name, count(*) AS members FROM (SELECT regexp_extract(container, '[^.]*$') AS name FROM de WHERE container IS NOT NULL) GROUP BY 1) SELECT t.name, coalesce(members, 0) AS members, (SELECT count(*) FROM sup WHERE a = t.name) AS up, (SELECT count(*) FROM sup WHERE b = t.name) AS down FROM (SELECT DISTINCT name FROM de WHERE kind IN ('class', 'interface', 'object', 'enum')) t LEFT JOIN k USING (name)")
def r10_context(s: SparkSession, d: str) -> DataFrame:
    """A type in its context: members, direct super- and subtypes."""
    de = b.decls(s, d)
    t = de.filter(F.col("kind").isin("class", "interface", "object", "enum")).select("name").distinct()
    k = de.filter("container IS NOT NULL").groupBy(F.regexp_extract("container", "[^.]*$", 0).alias("name")).agg(F.count("*").alias("members"))
    e = supertype_edges(s, d)
    up, down = e.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("up")), e.groupBy(F.col("b").alias("name")).agg(F.count("*").alias("down"))
    return t.join(k, "name", "left").join(up, "name", "left").join(down, "name", "left").fillna(0, ["members", "up", "down"])


_MENTION = "'[A-Z][a-z]+[A-Z][A-Za-z]+'"


@query(f"WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_MENTION})) AS word FROM documents WHERE source = 'tracker_issues'), t AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS word, path FROM de JOIN f ON f.id = file_id WHERE kind = 'class'), c AS (SELECT word, count(DISTINCT path) AS n FROM t GROUP BY 1) SELECT doc_id, word, CASE WHEN n IS NULL THEN '+' WHEN n = 1 THEN '=' WHEN n <= 3 THEN '~' ELSE '?' END AS mark FROM m LEFT JOIN c USING (word)")
def r11_touch_prediction(s: SparkSession, d: str) -> DataFrame:
    """How surely a mentioned name leads to a file, by the number of files it could be."""
    m = b.documents(s, d).filter("source = 'tracker_issues'").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+[A-Z][A-Za-z]+"), 0))).alias("word"))
    f = b.files(s, d).select(F.col("id").alias("file_id"), "path")
    c = b.decls(s, d).filter("kind = 'class'").join(f, "file_id").groupBy(F.regexp_replace("name", "[0-9]+$", "").alias("word")).agg(F.count_distinct("path").alias("n"))
    return m.join(c, "word", "left").select("doc_id", "word", F.when(F.col("n").isNull(), "+").when(F.col("n") == 1, "=").when(F.col("n") <= 3, "~").otherwise("?").alias("mark"))


@query("SELECT doc_id, kind, what FROM (SELECT doc_id, 'path' AS kind, unnest(regexp_extract_all(text, '[a-z]+/[A-Z][A-Za-z]+\\.(?:kt|java|md)')) AS what FROM documents UNION ALL SELECT doc_id, 'task', unnest(regexp_extract_all(text, '[A-Z]{2,4}-[0-9]+')) FROM documents UNION ALL SELECT doc_id, 'code', unnest(regexp_extract_all(text, '[a-z]+[A-Z][A-Za-z]+\\(\\)')) FROM documents UNION ALL SELECT doc_id, 'version', unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+\\.[0-9]+')) FROM documents)")
def r12_mentions(s: SparkSession, d: str) -> DataFrame:
    kinds = (("path", r"[a-z]+/[A-Z][A-Za-z]+\.(?:kt|java|md)"), ("task", "[A-Z]{2,4}-[0-9]+"), ("code", r"[a-z]+[A-Z][A-Za-z]+\(\)"), ("version", r"[0-9]+\.[0-9]+\.[0-9]+"))
    tag = lambda k, p: F.transform(F.regexp_extract_all("text", F.lit(p), 0), lambda w: F.struct(F.lit(k).alias("kind"), w.alias("what")))
    return b.documents(s, d).select("doc_id", F.explode(F.concat(*[tag(k, p) for k, p in kinds])).alias("x")).select("doc_id", "x.*")


def change_marks(s: SparkSession, d: str) -> DataFrame:
    """(id, parent_id, mark) of the declarations that differ between two versions."""
    old, new = two_versions(s, d)
    parents = new.select("id", "parent_id").unionByName(old.join(new.select("id"), "id", "left_anti").select("id", "parent_id"))
    return version_matches(s, d).filter("mark <> '='").select(F.coalesce("new_id", "old_id").alias("id"), "mark").distinct().join(parents, "id")


_MARKS = f"{_MATCHED}, mk AS (SELECT DISTINCT coalesce(new_id, old_id) AS id, mark FROM mt WHERE mark <> '='), pa AS (SELECT id, parent_id FROM nv UNION ALL SELECT id, parent_id FROM ov WHERE id NOT IN (SELECT id FROM nv)), cm AS (SELECT mk.id, parent_id, mark FROM mk JOIN pa USING (id))"


@query(f"WITH {_MARKS} SELECT cm.id, cm.mark FROM cm LEFT JOIN (SELECT id, mark FROM cm WHERE mark IN ('+', '-')) p ON p.id = cm.parent_id AND p.mark = cm.mark WHERE p.id IS NULL")
def r13_change_set(s: SparkSession, d: str) -> DataFrame:
    """Changed declarations, from the matching of two versions; what lies directly inside an added or removed one is part of it."""
    c = change_marks(s, d)
    p = c.filter("mark IN ('+', '-')").select(F.col("id").alias("parent_id"), "mark").distinct()
    return c.join(p, ["parent_id", "mark"], "left_anti").select("id", "mark")


@query(f"WITH {_RES}, {_CALLS}, {_MARKS}, ch AS (SELECT DISTINCT cm.id, mark, name, kind, file_id AS home FROM cm JOIN de USING (id) WHERE mark IN ('^', '~', '-')), cl AS (SELECT ch.id, ca.file_id FROM ch JOIN ca ON ca.name = ch.name AND ch.kind IN ('fun', 'method') WHERE ca.file_id <> home UNION SELECT ch.id, lb.file_id FROM ch JOIN lb ON lb.target = ch.id AND label = 'EXACT' WHERE lb.file_id <> home), lf AS (SELECT name, kind, min(id) AS instead FROM de WHERE local = 0 AND id NOT IN (SELECT id FROM cm WHERE mark = '-') GROUP BY ALL) SELECT ch.id, mark, coalesce(n, 0) AS callers, CASE WHEN mark = '-' THEN instead END AS instead FROM ch LEFT JOIN (SELECT id, count(DISTINCT file_id) AS n FROM cl GROUP BY 1) USING (id) LEFT JOIN lf USING (name, kind)")
def r8_callers_of_changed(s: SparkSession, d: str) -> DataFrame:
    """Of each declaration that a change set changes or removes, how many files name its type or call it; for removed ones also where
    calls go now: the least declaration that is left with its name."""
    de = b.decls(s, d).filter("local = 0")
    c = change_marks(s, d).filter("mark IN ('^', '~', '-')")
    called = call_lines(s, d).select("file_id", "name").distinct()
    typed = references(s, d).filter("label = 'EXACT'").select("file_id", F.col("target").alias("id"))
    home = de.select("id", "name", F.col("file_id").alias("home"), "kind")
    changed = c.select("id", "mark").join(home, "id")
    by_call = changed.filter("kind IN ('fun', 'method')").join(called, "name").select("id", "file_id", "home")
    by_type = changed.join(typed, "id").select("id", "file_id", "home")
    callers = by_call.unionByName(by_type).filter("file_id <> home").groupBy("id").agg(F.count_distinct("file_id").alias("callers"))
    left = home.join(c.filter("mark = '-'").select("id"), "id", "left_anti").groupBy("name", "kind").agg(F.min("id").alias("instead"))
    out = changed.join(callers, "id", "left").join(left, ["name", "kind"], "left")
    return out.select("id", "mark", F.coalesce("callers", F.lit(0)).alias("callers"), F.when(F.col("mark") == "-", F.col("instead")).alias("instead"))


# By names and not by edges, whose number grows with the square of a name's places.
_ALL_REACHED = "un AS (SELECT DISTINCT file_id, name FROM n SEMI JOIN ety USING (name)), nm1 AS MATERIALIZED (SELECT target AS start, name FROM ety WHERE target IN (SELECT id FROM f WHERE source_set = 'main'))" + "".join(
    f", nm{k} AS MATERIALIZED (SELECT DISTINCT start, ety.name FROM (SELECT DISTINCT start, file_id FROM nm{k - 1} JOIN un USING (name)) JOIN ety ON target = file_id)" for k in (2, 3)
) + ", rt AS (SELECT DISTINCT start, file_id AS id FROM (SELECT * FROM nm1 UNION SELECT * FROM nm2 UNION SELECT * FROM nm3) JOIN (SELECT * FROM un WHERE file_id IN (SELECT id FROM f WHERE source_set = 'test')) USING (name) WHERE start <> file_id)"


@query(f"WITH {_EDGES}, {_ALL_REACHED} SELECT f.id, module, CASE WHEN path LIKE '%.gradle.kts' OR path LIKE '%.kts' THEN 'everything' WHEN t.n IS NULL THEN 'module' ELSE 'reached' END AS scope, coalesce(t.n, 0) AS tests FROM f LEFT JOIN (SELECT start, count(*) AS n FROM rt GROUP BY 1) t ON t.start = f.id WHERE source_set = 'main'")
def r14_test_selection(s: SparkSession, d: str) -> DataFrame:
    """Tests to run when a main file changes: all that reach it in three steps; a build file widens to everything, a file no test
    reaches to its module."""
    changed = b.files(s, d).filter("source_set = 'main'").select(F.col("id").alias("start"), "path", "module")
    reached = tests_reached(s, d).withColumnRenamed("n", "tests")
    wide = F.when(F.col("path").endswith(".kts"), "everything").when(F.col("tests").isNull(), "module").otherwise("reached")
    return changed.join(reached, "start", "left").select(F.col("start").alias("id"), "module", wide.alias("scope"), F.coalesce("tests", F.lit(0)).alias("tests"))


@query()
def r15_line_diff(s: SparkSession, d: str) -> DataFrame:
    """Lines added and removed between two versions of a comment, by a longest common subsequence."""
    new = F.regexp_replace("text", r"\. ", ".\n")
    return b.comments(s, d).select("id", line_diff(F.col("text"), new).alias("x")).select("id", "x.*")


@query(f"WITH {_VERSIONS}, a AS (SELECT file_id, sha256(string_agg(hash, chr(1) ORDER BY hash)) AS was FROM ov GROUP BY 1), n AS (SELECT file_id, sha256(string_agg(hash, chr(1) ORDER BY hash)) AS now FROM nv GROUP BY 1) SELECT file_id, CASE WHEN was IS NULL OR now IS NULL THEN 'unknown' WHEN now = was THEN 'standing' ELSE 'stale' END AS state FROM a FULL JOIN n USING (file_id)")
def r16_staleness(s: SparkSession, d: str) -> DataFrame:
    """The fingerprint of a file's declarations as an anchor stored it, in the older version, against that of the newer; where either is missing it is unknown."""
    old, new = two_versions(s, d)
    return staleness(old, new, "file_id", "hash")


def staleness(stored: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) by fingerprints of the sorted values of a key, null ones left out: standing, stale, or unknown on one side."""
    mark = lambda df, name: df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\x01"), 256).alias(name))
    both = mark(stored, "was").join(mark(now, "now"), key, "full_outer")
    return both.select(key, F.when(F.col("was").isNull() | F.col("now").isNull(), "unknown").when(F.col("now") == F.col("was"), "standing").otherwise("stale").alias("state"))


_SAID = "(?:^|[^A-Za-z])([A-Za-z]+[.](?:kt|java)):([0-9]+)"
_OUTPUT = f"ol AS (SELECT doc_id, i::BIGINT AS out_line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND source = 'cli_output'), unnest(range(1, len(ls) + 1)) AS t(i)), oe AS (SELECT doc_id, out_line, regexp_extract(text, '{_SAID}', 1) AS file, regexp_extract(text, '{_SAID}', 2)::BIGINT AS line, trim(regexp_replace(regexp_replace(text, '^\\[[0-9:]+\\] [A-Z]+ ', ''), '[0-9]+', '#', 'g')) AS message FROM ol WHERE regexp_matches(text, '{_SAID}')), nf AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '[0-9]+', '') AS file, min(id) AS file_id FROM f GROUP BY 1)"


@query(f"WITH {_OUTPUT}, x AS (SELECT oe.doc_id, out_line, message, nf.file_id, oe.line, fqn FROM oe LEFT JOIN nf USING (file) LEFT JOIN de ON de.file_id = nf.file_id AND oe.line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY doc_id, out_line ORDER BY end_line - start_line NULLS LAST, start_line DESC, fqn) = 1) SELECT message, count(*) AS n, count(DISTINCT fqn) AS declarations, count(DISTINCT fqn) >= 3 AS cascade FROM x GROUP BY 1")
def r17_triage(s: SparkSession, d: str) -> DataFrame:
    """Lines of tool output that name a place in a file, grouped by what they say without numbers, with the declarations they lie in; three make a cascade."""
    docs = b.documents(s, d).filter("source = 'cli_output'").select("doc_id")
    lines = document_lines(s, d).join(docs, "doc_id", "left_semi").filter(F.col("text").rlike(_SAID))
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\[[0-9:]+\] [A-Z]+ ", ""), "[0-9]+", "#"))
    said = lines.select("doc_id", F.col("line").alias("out_line"), F.regexp_extract("text", _SAID, 1).alias("file"), F.regexp_extract("text", _SAID, 2).cast("bigint").alias("line"), bare.alias("message"))
    named = b.files(s, d).groupBy(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), "[0-9]+", "").alias("file")).agg(F.min("id").alias("file_id"))
    at = said.join(named, "file", "left")
    x = narrowest(at, b.decls(s, d), "file_id", "line", "start_line", "end_line", ["fqn"], ["doc_id", "out_line", "message"])
    return x.groupBy("message").agg(F.count("*").alias("n"), F.count_distinct("fqn").alias("declarations"), (F.count_distinct("fqn") >= 3).alias("cascade"))


@query(f"WITH {_RES}, {_CALLS}, an AS (SELECT DISTINCT name FROM ty), cx AS (SELECT DISTINCT file_id, line, c, name, {_ARGS} AS args FROM ca), fp AS (SELECT file_id, name, param_count AS total, {_REQUIRED} AS required, {_MANY} AS many FROM de WHERE kind IN ('fun', 'method')), fit AS (SELECT cx.file_id, cx.name, line, c, bool_or(required <= args AND (many OR args <= total)) AS fits FROM cx JOIN fp USING (file_id, name) GROUP BY ALL), bli AS (SELECT DISTINCT file_id FROM sr WHERE package NOT IN (SELECT package FROM ty WHERE package IS NOT NULL)) SELECT rf.file_id, rf.name, CASE WHEN an.name IS NULL THEN 'unknown' ELSE 'not imported' END AS problem FROM rf ANTI JOIN ne USING (file_id, name) ANTI JOIN im USING (file_id, name) ANTI JOIN bli USING (file_id) LEFT JOIN an ON an.name = rf.name UNION ALL SELECT DISTINCT file_id, name, 'wrong argument count' FROM fit WHERE NOT fits")
def r18_name_check(s: SparkSession, d: str) -> DataFrame:
    """Names of types that no scope of a file knows, unknown altogether or declared elsewhere but not imported, and calls of the
    file's own functions of which none takes so many arguments. A file that imports an unknown package whole is not judged by names."""
    types = declared_types(s, d)
    imports = import_lines(s, d)
    blind = imports.filter("star").select("file_id", F.col("fqn").alias("package")).join(types.select("package"), "package", "left_anti").select("file_id").distinct()
    known = resolved(s, d).select("file_id", "name").unionByName(imports.filter("NOT star").select("file_id", "name")).distinct()
    left = type_names(s, d).join(known, ["file_id", "name"], "left_anti").join(blind, "file_id", "left_anti").join(types.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    names = left.select("file_id", "name", F.when(F.col("there").isNull(), "unknown").otherwise("not imported").alias("problem"))
    calls = r4_argument_count(s, d).groupBy("file_id", "line", "call").agg(F.bool_or("fits").alias("fits")).filter("NOT fits")
    wrong = calls.select("file_id", F.regexp_extract("call", "[A-Za-z0-9_]+", 0).alias("name"), F.lit("wrong argument count").alias("problem")).distinct()
    return names.unionByName(wrong)


@query("SELECT id, CASE WHEN role = 'review' THEN 'protected' WHEN ter IN (SELECT id FROM iss WHERE resolved IS NOT NULL) THEN 'released' WHEN end_ms IS NULL THEN 'running' ELSE 'idle' END AS verdict FROM ru")
def r19_verdict(s: SparkSession, d: str) -> DataFrame:
    """Ordered cases over an inventory and its registers: the first that holds decides."""
    done = b.issues(s, d).filter("resolved IS NOT NULL").select(F.col("id").alias("ter"), F.lit(True).alias("done")).distinct()
    v = F.when(F.col("role") == "review", "protected").when(F.col("done"), "released").when(F.col("end_ms").isNull(), "running").otherwise("idle")
    return b.runs(s, d).join(done, "ter", "left").select("id", v.alias("verdict"))


@query("WITH a AS (SELECT session, min(id) AS m FROM ru WHERE kind = 'main' GROUP BY 1 HAVING count(*) = 1), p AS (SELECT project, min(id) AS m FROM ru GROUP BY 1 HAVING count(*) = 1) SELECT st.seq, coalesce(a.m, p.m) AS run, CASE WHEN a.m IS NOT NULL THEN 'session' WHEN p.m IS NOT NULL THEN 'place' ELSE 'nobody' END AS how FROM st LEFT JOIN a USING (session) LEFT JOIN p USING (project)")
def r20_attribution(s: SparkSession, d: str) -> DataFrame:
    """The listed session first, then a place that only one run has; otherwise nobody."""
    r = b.runs(s, d)
    a = r.filter("kind = 'main'").groupBy("session").agg(F.min("id").alias("m1"), F.count("*").alias("n1")).filter("n1 = 1")
    p = r.groupBy("project").agg(F.min("id").alias("m2"), F.count("*").alias("n2")).filter("n2 = 1")
    how = F.when(F.col("m1").isNotNull(), "session").when(F.col("m2").isNotNull(), "place").otherwise("nobody")
    return b.steps(s, d).join(a, "session", "left").join(p, "project", "left").select("seq", F.coalesce("m1", "m2").alias("run"), how.alias("how"))


@query(f"WITH {_LINKS}, nw AS (SELECT path, doc_id, created FROM fl JOIN documents USING (doc_id) WHERE source = 'commit_messages' QUALIFY row_number() OVER (PARTITION BY path ORDER BY created DESC NULLS LAST, doc_id) <= 40), x AS (SELECT path, task, max(created) AS at_ FROM nw JOIN lk USING (doc_id) GROUP BY ALL) SELECT path, task FROM x QUALIFY row_number() OVER (PARTITION BY path ORDER BY at_ DESC NULLS LAST, task) <= 6")
def r21_earlier_tasks(s: SparkSession, d: str) -> DataFrame:
    """The six tasks that landed last on a path, of its 40 newest commits."""
    r = F.row_number().over(W.partitionBy("path").orderBy(F.desc_nulls_last("at"), "task"))
    return landed(s, d).withColumn("r", r).filter("r <= 6").select("path", "task")
