"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import tables as op
from tessera.plans import base as b
from tessera.session import hadoop_path, scratch
from tessera.sources.lines import LineSource
from tessera.streaming.jobs import drained

query = b.Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT de.id, f.path, de.kind, de.fqn, de.start_line FROM de JOIN f ON f.id = de.file_id WHERE de.kind = 'class' AND f.deleted = 0")
def s1_declaration_scan(s: SparkSession, d: str) -> DataFrame:
    f = b.files(s, d).filter("deleted = 0").select(F.col("id").alias("file_id"), "path")
    return b.decls(s, d).filter("kind = 'class'").join(f, "file_id").select("id", "path", "kind", "fqn", "start_line")


_REFS = "SELECT id AS file_id, line, unnest(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9]*)\\b', 1)) AS name FROM ln"


@query(f"WITH r AS ({_REFS}), t AS (SELECT DISTINCT name FROM de WHERE kind IN ('class', 'interface', 'object', 'enum')) SELECT file_id, line, name, count(*) AS n FROM r SEMI JOIN t USING (name) GROUP BY ALL")
def s2_reference_scan(s: SparkSession, d: str) -> DataFrame:
    refs = b.lines(s, d).select(F.col("id").alias("file_id"), "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9]*)\b"), 1)).alias("name"))
    types = b.decls(s, d).filter("kind IN ('class', 'interface', 'object', 'enum')").select("name").distinct()
    return refs.join(types, "name", "left_semi").groupBy("file_id", "line", "name").agg(F.count("*").alias("n"))


_IMPORT = "^import +(static +)?([A-Za-z0-9_.]+?)(\\.\\*)?( +as +([A-Za-z0-9_]+))? *;?$"


@query(f"SELECT id AS file_id, regexp_extract(text, '{_IMPORT}', 2) AS fqn, regexp_extract(text, '{_IMPORT}', 5) AS alias, regexp_extract(text, '{_IMPORT}', 3) <> '' AS star FROM ln WHERE regexp_matches(text, '{_IMPORT}')")
def s3_import_scan(s: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.regexp_extract("text", _IMPORT, n)
    return b.lines(s, d).filter(F.col("text").rlike(_IMPORT)).select(F.col("id").alias("file_id"), part(2).alias("fqn"), part(5).alias("alias"), (part(3) != "").alias("star"))


def _layers(s: SparkSession, d: str) -> DataFrame:
    """A base of documents and an overlay that replaces every tenth and deletes every 37th."""
    base = b.documents(s, d).select("doc_id", "text", "lang", F.lit("base").alias("layer"))
    over = base.filter("doc_id % 10 = 0 OR doc_id % 37 = 0").withColumn("gone", F.col("doc_id") % 37 == 0)
    over = over.withColumns({"text": F.concat(F.lit("edited "), F.coalesce("text", F.lit(""))), "layer": F.lit("overlay")})
    return op.overlay(base.withColumn("gone", F.lit(False)), over, "doc_id", F.col("gone")).drop("gone")


_LAYERS = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'edited ' || coalesce(text, '') ELSE text END AS text, lang, CASE WHEN doc_id % 10 = 0 THEN 'overlay' ELSE 'base' END AS layer FROM documents WHERE doc_id % 37 <> 0"


@query(_LAYERS)
def j5_overlay(s: SparkSession, d: str) -> DataFrame:
    return _layers(s, d)


@query(f"SELECT doc_id, layer, length(text) AS chars FROM ({_LAYERS}) WHERE doc_id IN (1010, 1036, 1037)")
def s4_point_lookup(s: SparkSession, d: str) -> DataFrame:
    return _layers(s, d).filter(F.col("doc_id").isin(1010, 1036, 1037)).select("doc_id", "layer", F.char_length("text").alias("chars"))


@query("SELECT id, path FROM f WHERE lower(path) LIKE '%.kts'")
def s5_suffix_scan(s: SparkSession, d: str) -> DataFrame:
    return b.files(s, d).filter(F.lower("path").endswith(".kts")).select("id", "path")


@query("SELECT id, path, line FROM ln JOIN (SELECT id, module FROM f) USING (id) WHERE contains(text, 'emptyList()') AND module = 'core'")
def s6_content_scan(s: SparkSession, d: str) -> DataFrame:
    core = b.files(s, d).filter(F.col("content").contains("emptyList()") & (F.col("module") == "core"))
    rows = core.select("id", "path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("i", "text"))
    return rows.filter(F.col("text").contains("emptyList()")).select("id", "path", (F.col("i") + 1).cast("bigint").alias("line"))


@query("SELECT path FROM f WHERE contains(content, 'mapOf(') ORDER BY path LIMIT 50")
def s7_files_containing(s: SparkSession, d: str) -> DataFrame:
    return b.files(s, d).filter(F.col("content").contains("mapOf(")).select("path").orderBy("path").limit(50)


@query("SELECT sha256(content) AS sha, count(*) AS paths, min(path) AS first_path FROM f WHERE content IS NOT NULL GROUP BY 1")
def s8_blobs(s: SparkSession, d: str) -> DataFrame:
    rows = b.files(s, d).filter("content IS NOT NULL").select(F.sha2("content", 256).alias("sha"), "path")
    return rows.groupBy("sha").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


@query("SELECT seq, p->>'type' AS kind, length(p->>'text') AS chars FROM (SELECT seq, unnest(from_json(content, '[\"JSON\"]')) AS p FROM st WHERE content LIKE '[%' AND json_valid(content)) WHERE p->>'type' IS NOT NULL")
def s10_transcript_parts(s: SparkSession, d: str) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
    parts = b.steps(s, d).filter(F.col("content").startswith("[")).select("seq", F.explode(F.from_json("content", kind)).alias("p"))
    return parts.filter("p.type IS NOT NULL").select("seq", F.col("p.type").alias("kind"), F.char_length("p.text").alias("chars"))


@query("SELECT seq, session, type AS kind FROM st")
def s10_transcript_lines(s: SparkSession, d: str) -> DataFrame:
    """Transcripts as files of JSON lines, one a session, read as growing files and parsed line by line; what does not parse is left out."""
    folder = scratch(s, "transcripts")
    rows = b.steps(s, d).select("seq", "session", "type").withColumn("value", F.to_json(F.struct("seq", "session", "type"), {"ignoreNullFields": "false"}))
    rows.repartition("session").select("value").write.text(folder)
    s.dataSource.register(LineSource)
    lines = drained(s.readStream.format("growing_lines").option("path", folder).load())
    x = F.from_json("line", "seq bigint, session string, type string")
    return lines.select(x.alias("x")).filter("x.seq IS NOT NULL").select("x.seq", "x.session", F.col("x.type").alias("kind"))


@query("SELECT path, size, mtime FROM f WHERE deleted = 0 AND (path, size, mtime) NOT IN (SELECT (path, CASE WHEN id % 5 = 0 THEN size + 1 ELSE size END, mtime) FROM f WHERE deleted = 0 AND id % 7 <> 0)")
def s11_discovery(s: SparkSession, d: str) -> DataFrame:
    now = b.files(s, d).filter("deleted = 0").select("id", "path", "size", "mtime")
    known = now.filter("id % 7 <> 0").select("path", F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")
    return op.absent(now.drop("id"), known, ["path", "size", "mtime"])


@query("SELECT id, CASE WHEN length(content) < n THEN 'shrunk' WHEN left(content, n) <> old THEN 'rewritten' WHEN length(content) > n THEN 'grown' ELSE 'same' END AS state FROM (SELECT id, content, (length(content) // 2 + CASE WHEN id % 11 = 0 THEN length(content) ELSE 0 END)::BIGINT AS n, CASE WHEN id % 3 = 0 THEN 'x' || left(content, length(content) // 2 - 1) ELSE left(content, length(content) // 2) END AS old FROM f WHERE length(content) > 1)")
def s12_rewrites(s: SparkSession, d: str) -> DataFrame:
    """Files against what was read of them before: here half of each, of some in other words, of some more than there is now."""
    n = F.char_length("content")
    half = F.floor(n / 2)
    rows = b.files(s, d).filter(n > 1)
    was = F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.substring("content", F.lit(1), (half - 1).cast("int")))).otherwise(F.substring("content", F.lit(1), half.cast("int")))
    seen = rows.select("id", F.when(F.col("id") % 11 == 0, half + n).otherwise(half).alias("read"), F.sha2(was, 256).alias("mark"))
    return rewrites(rows, seen)


def rewrites(files: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, state) of the files (id, content) against how much was `read` of each and the hash of that: shrunk and rewritten ones are
    to be read anew, grown ones from there on. Files never read are `new`."""
    n = F.char_length("content")
    rows = files.join(seen, "id", "left")
    now = F.sha2(F.substring("content", F.lit(1), F.col("read").cast("int")), 256)
    state = F.when(F.col("read").isNull(), "new").when(n < F.col("read"), "shrunk").when(now != F.col("mark"), "rewritten").when(n > F.col("read"), "grown").otherwise("same")
    return rows.select("id", state.alias("state"))


def rolled(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The records of a log that is rolled over, from its older and its newer file of JSON lines; missing files and torn lines give nothing."""
    there = [p for p in paths if (lambda fs, q: fs.exists(q))(*hadoop_path(spark, p))]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(there).filter("_torn IS NULL").drop("_torn")


@query("SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events WHERE value IS NOT NULL")
def s13_call_log(s: SparkSession, d: str) -> DataFrame:
    """The call log, written as the two files that a log rolls over into, and read from both."""
    folder = scratch(s, "log")
    e = b.events(s, d).filter("value IS NOT NULL").select("event_id", "event_type", "props")
    newer = F.col("event_id") % 2 == 0
    for name, half in (("calls.1", ~newer), ("calls", newer)):
        e.filter(half).write.json(f"{folder}/{name}")
    rows = rolled(s, [f"{folder}/calls.1", f"{folder}/calls", f"{folder}/calls.2"], "event_id bigint, event_type string, props string")
    return rows.select("event_id", "event_type", F.from_json("props", "k bigint").getField("k").alias("k"))


_TASK = "[A-Z]{2,4}-[0-9]+"


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_TASK}'))) AS task FROM documents WHERE source = 'commit_messages' AND doc_id % 4 <> 0")
def s15_commits_naming_tasks(s: SparkSession, d: str) -> DataFrame:
    commits = b.documents(s, d).filter("source = 'commit_messages'")
    new = op.absent(commits, commits.filter("doc_id % 4 = 0"), ["doc_id"])  # the known ones
    return new.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TASK), 0))).alias("task"))


_SECTIONS = """WITH l AS (SELECT doc_id, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i)),
sec AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM l)"""


def document_lines(s: SparkSession, d: str) -> DataFrame:
    rows = b.documents(s, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line"), "text")


@query(_SECTIONS + " SELECT doc_id, section::BIGINT AS section, min(line) AS first_line, count(*) AS n, sum(length(text))::BIGINT AS chars FROM sec GROUP BY ALL")
def s16_sections(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = document_lines(s, d).withColumn("section", F.sum(F.col("text").rlike("^#{1,6} ").cast("bigint")).over(w))
    return rows.groupBy("doc_id", "section").agg(F.min("line").alias("first_line"), F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query(_SECTIONS + ", m AS (SELECT *, sum(CASE WHEN starts_with(text, '- ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS item FROM l) SELECT doc_id, item::BIGINT AS item, string_agg(trim(CASE WHEN starts_with(text, '- ') THEN substr(text, 3) ELSE text END, ' '), ' ' ORDER BY line) AS fact FROM m WHERE item > 0 GROUP BY ALL")
def s17_marked_lines(s: SparkSession, d: str) -> DataFrame:
    """One fact per marked line, with the unmarked lines after it."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = document_lines(s, d).withColumn("item", F.sum(F.col("text").startswith("- ").cast("bigint")).over(w)).filter("item > 0")
    bare = F.trim(F.when(F.col("text").startswith("- "), F.substring("text", 3, 1 << 30)).otherwise(F.col("text")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", bare.alias("t")))), lambda x: x["t"])
    return rows.groupBy("doc_id", "item").agg(F.array_join(parts, " ").alias("fact"))


@query("SELECT id, path, 'new' AS version FROM f WHERE id % 6 = 0 UNION ALL SELECT id, path, 'old' FROM f WHERE id % 6 <> 0")
def k1_replace(s: SparkSession, d: str) -> DataFrame:
    rows = b.files(s, d).select("id", "path")
    old, new = rows.withColumns({"version": F.lit("old"), "v": F.lit(1)}), rows.filter("id % 6 = 0").withColumns({"version": F.lit("new"), "v": F.lit(2)})
    return op.newest_version(old.unionByName(new), ["id"], "v").drop("v")


@query("SELECT id, hash IS NOT NULL AND (path, hash) IN (SELECT (path, hash) FROM f WHERE id % 3 <> 0) AS reuse FROM f")
def k2_reuse(s: SparkSession, d: str) -> DataFrame:
    rows = b.files(s, d).select("id", "path", "hash")
    return op.reusable(rows, rows.filter("id % 3 <> 0"), ["path", "hash"]).select("id", "reuse")


@query("SELECT run_id, hour // 24 AS day, round(sum(CASE WHEN hour % 2 = 0 THEN 2 ELSE 1 END * coalesce(cost, 0)), 6) AS cost FROM uh GROUP BY ALL")
def k3_additive_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = b.hours(s, d).select("run_id", "hour", F.floor(F.col("hour") / 24).alias("day"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    old = rows.groupBy("run_id", "day").agg(F.sum("cost").alias("cost"))
    return op.add_up(old, rows.filter("hour % 2 = 0").select("run_id", "day", "cost"), ["run_id", "day"], ["cost"]).withColumn("cost", F.round("cost", 6))


@query("SELECT session, max_by(seq, seq) AS seq, max_by(type, seq) AS type FROM st GROUP BY session")
def k4_last_writer(s: SparkSession, d: str) -> DataFrame:
    return b.steps(s, d).groupBy("session").agg(F.max("seq").alias("seq"), F.max_by("type", "seq").alias("type"))


@query("SELECT k, updated, state FROM iss")
def k5_never_back(s: SparkSession, d: str) -> DataFrame:
    from tessera.session import table

    rows = table(s, d, "issues").select(F.lower(F.trim("id")).alias("k"), "updated", "state")
    return op.newest_version(rows, ["k"], "updated")


@query("SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN ter END, 'ask ' || role) AS ter, coalesce(model, 'unknown') AS model FROM ru")
def k6_fill_only(s: SparkSession, d: str) -> DataFrame:
    rows = b.runs(s, d)
    old = rows.select("id", F.when(F.col("id") % 2 == 0, F.col("ter")).alias("ter"), "model")
    return op.fill_only(old, rows.select("id", F.concat(F.lit("ask "), "role").alias("ter"), F.lit("unknown").alias("model")), ["id"], ["ter", "model"])


@query("SELECT DISTINCT mid FROM st WHERE mid IS NOT NULL AND mid <> '' AND mid NOT IN (SELECT mid FROM st WHERE seq % 3 = 0 AND mid IS NOT NULL)")
def k7_insert_or_ignore(s: SparkSession, d: str) -> DataFrame:
    seen = b.steps(s, d).filter("mid IS NOT NULL AND mid <> ''").select("mid", "seq")
    return op.absent(seen.select("mid"), seen.filter("seq % 3 = 0"), ["mid"])


@query("SELECT id, issue, at_ms FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY at_ms DESC, id DESC) AS rn FROM fc) WHERE rn <= 5 AND at_ms >= 1750000000000")
def k8_retention(s: SparkSession, d: str) -> DataFrame:
    rows = b.changes(s, d).withColumn("key", F.struct("at_ms", "id"))
    return op.retained(rows, "issue", "key", 5, F.struct(F.lit(1750000000000).alias("at_ms"), F.lit("").alias("id"))).select("id", "issue", "at_ms")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000")
def k9_newest(s: SparkSession, d: str) -> DataFrame:
    return b.events(s, d).select("event_id").orderBy(F.desc("event_id")).limit(1000)


@query("SELECT id, role, duration_s FROM ru")
def k10_csv(s: SparkSession, d: str) -> DataFrame:
    out = scratch(s, "csv")
    b.runs(s, d).select("id", "role", "duration_s").write.option("header", True).csv(out)
    return s.read.schema("id bigint, role string, duration_s bigint").option("header", True).csv(out)


@query("SELECT id, role, cost FROM ru")
def k11_json(s: SparkSession, d: str) -> DataFrame:
    out = scratch(s, "json")
    b.runs(s, d).select("id", "role", "cost").write.json(out)
    return s.read.schema("id bigint, role string, cost bigint").json(out)
