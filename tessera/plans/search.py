"""Ranking, search and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.words import DECLARING, ENGLISH, stems, stems_sql
from tessera.operators import search as op
from tessera.operators import walks
from tessera.plans import base as b
from tessera.plans.joins import _EDGES, _LINKS, document_files, document_tasks, type_files, used_names
from tessera.plans.scans import document_lines
from tessera.session import written

query = b.Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"SELECT id, array_to_string({stems_sql('summary')}, ' ') AS words FROM iss")
def q1_tokens(s: SparkSession, d: str) -> DataFrame:
    return b.issues(s, d).select("id", F.array_join(stems(F.col("summary")), " ").alias("words"))


#: Files and documents from this instant on lie over the base as edits.
BASE_AT = 1_767_225_600_000
_SIG = sorted({*ENGLISH, *DECLARING})
FIELDS = ["name", "ctx", "sig", "doc", "dirs"]
_COMMENT = r"^[ \t]*(?:/\*\*?|\*/?|//+)"
_COMMENTS = f"""cm AS (SELECT id, line, line - row_number() OVER (PARTITION BY id ORDER BY line) AS block, regexp_replace(regexp_replace(text, '{_COMMENT}', ''), '\\*/[ \t]*$', '') AS said FROM ln WHERE regexp_matches(text, '{_COMMENT}')), docs AS (SELECT id AS file_id, max(line) + 1 AS start_line, string_agg(said, ' ' ORDER BY line) AS doc FROM cm GROUP BY id, block)"""
_TOP = "kind IN ('class', 'interface', 'object', 'enum', 'record') OR coalesce(container, '') = ''"
_FIELDS = f"""SELECT de.id, de.kind, CASE WHEN f.mtime >= {BASE_AT} THEN 'overlay' ELSE 'base' END AS src, (f.source_set LIKE '%est%') AS test, {stems_sql('name')} AS name, {stems_sql('container')} AS ctx, list_filter({stems_sql('sig', _SIG)}, lambda w: NOT list_contains({stems_sql('name')}, w))[:12] AS sig,
{stems_sql('doc')}[:60] AS doc, CASE WHEN {_TOP} THEN {stems_sql('module')} ELSE [] END AS dirs FROM de JOIN f ON f.id = de.file_id LEFT JOIN docs USING (file_id, start_line) WHERE local = 0 AND kind NOT IN ('constructor', 'init')"""


def comment_blocks(s: SparkSession, d: str) -> DataFrame:
    """(file_id, start_line, doc): blocks of comment lines, by the line after them."""
    rows = b.lines(s, d).filter(F.col("text").rlike(_COMMENT))
    block = F.col("line") - F.row_number().over(W.partitionBy("id").orderBy("line"))
    said = F.regexp_replace(F.regexp_replace("text", _COMMENT, ""), r"\*/[ \t]*$", "")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", said.alias("t")))), lambda x: x["t"])
    g = rows.withColumn("block", block).groupBy("id", "block").agg((F.max("line") + 1).alias("start_line"), F.array_join(parts, " ").alias("doc"))
    return g.select(F.col("id").alias("file_id"), "start_line", "doc")


def fields(s: SparkSession, d: str) -> DataFrame:
    """The word columns of declarations: name, container, signature without the name's words, the comment above, and, of types and top declarations, place."""
    f = b.files(s, d).select(F.col("id").alias("file_id"), "module", "mtime", "source_set")
    rows = b.decls(s, d).filter("local = 0 AND kind NOT IN ('constructor', 'init')").join(f, "file_id").join(comment_blocks(s, d), ["file_id", "start_line"], "left")
    none = F.array().cast("array<string>")
    rows = rows.select(
        "id", "kind", F.when(F.col("mtime") >= BASE_AT, "overlay").otherwise("base").alias("src"), F.col("source_set").contains("est").alias("test"), stems(F.col("name")).alias("name"), stems(F.col("container")).alias("ctx"),
        stems(F.col("sig"), _SIG).alias("s"), F.slice(stems(F.col("doc")), 1, 60).alias("doc"), F.when(F.expr(_TOP), stems(F.col("module"))).otherwise(none).alias("dirs"),
    )
    return rows.withColumn("sig", F.slice(F.filter("s", lambda w: ~F.array_contains("name", w)), 1, 12)).drop("s")


def _tagged() -> Column:
    """All words of the fields as (field, w, len), len being the field's words."""
    tag = lambda c: F.transform(c, lambda w: F.struct(F.lit(c).alias("field"), w.alias("w"), F.size(c).alias("len")))
    return F.flatten(F.array(*map(tag, FIELDS)))


@query(f"WITH {_COMMENTS}, x AS ({_FIELDS}) SELECT id, field, term, count(*) AS tf FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS field, unnest({c}) AS term FROM x" for c in FIELDS) + ") GROUP BY ALL")
def q2_field_tokens(s: SparkSession, d: str) -> DataFrame:
    return fields(s, d).select("id", F.explode(_tagged()).alias("x")).groupBy("id", "x.field", F.col("x.w").alias("term")).agg(F.count("*").alias("tf"))


@query("SELECT id FROM de WHERE kind NOT IN ('constructor', 'init', 'companion') AND local = 0 AND NOT (kind IN ('property', 'field') AND modifiers LIKE '%private%')")
def q3_indexed(s: SparkSession, d: str) -> DataFrame:
    hidden = F.col("kind").isin("property", "field") & F.col("modifiers").contains("private")
    return b.decls(s, d).filter(~F.col("kind").isin("constructor", "init", "companion") & (F.col("local") == 0) & ~F.coalesce(hidden, F.lit(False))).select("id")


QUESTIONS = [(1, "limit"), (1, "snapshot"), (2, "rebuild"), (2, "branch"), (3, "token"), (3, "budget")]
_QT = "qt AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ") v(qid, term))"
WEIGHT = {"name": 3.0, "ctx": 1.0, "sig": 0.7, "doc": 1.3, "dirs": 0.5}
TYPICAL = {"name": 3.0, "ctx": 4.0, "sig": 5.0, "doc": 20.0, "dirs": 4.0}
FOUND_BY = {"name": 10.0, "ctx": 4.0, "sig": 2.0, "doc": 3.0, "dirs": 1.0}  # weights of the first search
_PRIOR = "CASE kind WHEN 'class' THEN 1.15 WHEN 'interface' THEN 1.15 WHEN 'object' THEN 1.1 WHEN 'property' THEN 0.85 ELSE 1.0 END"


def _questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(QUESTIONS, "qid int, term string")


def strength(term: Column, word: Column) -> Column:
    """Equal 1; a word at most four characters longer 0.7; a word that begins the term, from four characters, 0.6."""
    longer = word.startswith(term) & (F.length(word) - F.length(term) <= 4) & (F.length(term) >= 4)
    return F.when(word == term, 1.0).when(longer, 0.7).when(term.startswith(word) & (F.length(word) >= 4), 0.6).otherwise(0.0)


_STRENGTH = "CASE WHEN w = term THEN 1.0 WHEN starts_with(w, term) AND length(w) - length(term) <= 4 AND length(term) >= 4 THEN 0.7 WHEN starts_with(term, w) AND length(w) >= 4 THEN 0.6 ELSE 0.0 END"
_TF = lambda c: f"list_sum(list_transform({c}, lambda w: {_STRENGTH}))"
_PART = lambda c: f"CASE WHEN coalesce({_TF(c)}, 0) > 0 THEN {WEIGHT[c]} * {_TF(c)} * 2.2 / ({_TF(c)} + 1.2 * (0.5 + 0.5 * len({c}) / {TYPICAL[c]})) ELSE 0 END"


def candidates(x: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, src, score): the best 60 of each layer for each question, by a BM25 over the fields' weighted words."""
    tokens = op.weighted_tokens(x, "id", FOUND_BY)
    scores = op.fts_bm25(tokens, op.lengths(x, FIELDS), questions.withColumn("w", F.lit(1.0)), "id").withColumn("score", F.round("score", 6))
    r = F.row_number().over(W.partitionBy("qid", "src").orderBy(F.desc("score"), "id"))
    return scores.join(x.select("id", "src"), "id").withColumn("r", r).filter("r <= 60").select("qid", "id", "src", "score")


def rescored(x: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, kind, test, score, terms) of the candidates: fielded BM25, where each field's hits saturate on their own and rarity is that of the base.

    Words meet terms through their shared beginnings of four characters (shorter ones whole), so the join is on equality.
    """
    base = x.filter("src = 'base'")
    total = base.agg(F.count("*").cast("double").alias("total"))
    start = lambda c: F.substring(c, 1, 4)
    terms = questions.withColumn("start", start("term"))
    found = candidates(x, questions).select("qid", "id")
    words = x.join(found.select("id").distinct(), "id", "left_semi").select("id", "kind", "test", F.explode(_tagged()).alias("x")).select("id", "kind", "test", "x.*").withColumn("start", start("w"))
    hit = words.join(terms, "start").withColumn("st", strength(F.col("term"), F.col("w"))).filter("st > 0").join(found, ["qid", "id"], "left_semi")
    tf = hit.groupBy("qid", "term", "id", "kind", "test", "field", "len").agg(F.sum("st").alias("tf"))
    weight = F.create_map(*[F.lit(v) for kv in WEIGHT.items() for v in kv])[F.col("field")]
    typical = F.create_map(*[F.lit(v) for kv in TYPICAL.items() for v in kv])[F.col("field")]
    part = weight * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.5 + 0.5 * F.col("len") / typical))
    asked = base.select("id", F.explode(F.array_distinct(F.flatten(F.array(*FIELDS)))).alias("term")).join(questions.select("term").distinct(), "term", "left_semi")
    by = tf.groupBy("qid", "term", "id", "kind", "test").agg(F.sum(part).alias("p")).join(op.document_frequency(asked), "term", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("df", F.lit(0))
    return by.groupBy("qid", "id", "kind", "test").agg(F.sum(F.col("p") * F.ln(1 + (F.col("total") - n + 0.5) / (n + 0.5))).alias("score"), F.count("*").alias("terms"))


_ALL = "list_concat(list_concat(list_concat(list_concat(name, ctx), sig), doc), dirs)"
_FOUND = f"""{_COMMENTS}, x AS MATERIALIZED ({_FIELDS}), {_QT}, tkw AS (SELECT id, term, sum(w) AS tf FROM ({' UNION ALL '.join(f"SELECT id, unnest({c}) AS term, {w}::DOUBLE AS w FROM x" for c, w in FOUND_BY.items())}) GROUP BY ALL), ld AS (SELECT id, src, len({_ALL}) AS l FROM x), dfw AS (SELECT term, count(*) AS df FROM tkw GROUP BY 1),
cand AS (SELECT * FROM (SELECT qid, id, src, round(sum(greatest(ln(((SELECT count(*) FROM x) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT greatest(avg(l), 1.0) FROM ld)))), 6) AS score FROM qt JOIN tkw USING (term) JOIN dfw USING (term) JOIN ld USING (id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qid, src ORDER BY score DESC, id) <= 60)"""
_SCORED = f"""{_FOUND}, dfs AS (SELECT term, count(x.id) AS df FROM (SELECT DISTINCT term FROM qt) LEFT JOIN x ON src = 'base' AND list_contains({_ALL}, term) GROUP BY 1),
sc AS (SELECT qid, id, kind, test, sum(p * ln(1 + ((SELECT count(*) FROM x WHERE src = 'base') - df + 0.5) / (df + 0.5))) AS score, count(*) AS terms FROM (SELECT qid, term, id, kind, test, {' + '.join(map(_PART, FIELDS))} AS p FROM x JOIN (SELECT qid, id FROM cand) USING (id) JOIN qt USING (qid)) JOIN dfs USING (term) WHERE p > 0 GROUP BY ALL)"""


@query(f"WITH {_FOUND} SELECT * FROM cand")
def q4_candidates(s: SparkSession, d: str) -> DataFrame:
    return candidates(written(fields(s, d)), _questions(s))


@query(f"WITH {_SCORED} SELECT qid, id, round(score, 6) AS score, terms FROM sc")
def q5_fielded_bm25(s: SparkSession, d: str) -> DataFrame:
    return rescored(written(fields(s, d)), _questions(s)).select("qid", "id", F.round("score", 6).alias("score"), "terms")


@query(f"WITH {_QT}, v AS (SELECT DISTINCT unnest({stems_sql('name')}) AS w FROM de) SELECT qid, term, w, round({_STRENGTH}, 2) AS strength FROM v CROSS JOIN qt WHERE {_STRENGTH} > 0")
def q6_term_strength(s: SparkSession, d: str) -> DataFrame:
    v = b.decls(s, d).select(F.explode(stems(F.col("name"))).alias("w")).distinct().withColumn("start", F.substring("w", 1, 4))
    j = v.join(F.broadcast(_questions(s).withColumn("start", F.substring("term", 1, 4))), "start")
    return j.withColumn("strength", F.round(strength(F.col("term"), F.col("w")), 2)).filter("strength > 0").select("qid", "term", "w", "strength")


_BASE = f"created < epoch_ms({BASE_AT}) OR created IS NULL"


@query(f"WITH bd AS (SELECT * FROM documents WHERE {_BASE}), t AS (SELECT DISTINCT doc_id, unnest({stems_sql('text')}) AS term FROM bd), n AS (SELECT count(*) AS n FROM bd) SELECT term, round(ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY 1")
def q7_base_idf(s: SparkSession, d: str) -> DataFrame:
    """Rarity from the base only, so that edits do not move the ranking."""
    base = b.documents(s, d).filter((F.unix_millis(F.col("created").cast("timestamp")) < BASE_AT) | F.col("created").isNull())
    df = base.select("doc_id", F.explode(F.array_distinct(stems(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(base.agg(F.count("*").alias("n"))), F.lit(True)).select("term", F.round(F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"WITH {_SCORED}, need AS (SELECT qid, count(*) AS need FROM qt GROUP BY 1), r AS (SELECT qid, sc.id, round(score * CASE WHEN terms = need THEN 1.25 ELSE 1 END * {_PRIOR.replace('kind', 'sc.kind')} * CASE WHEN test THEN 0.85 ELSE 1 END, 6) AS score FROM sc JOIN need USING (qid)), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM r), pop AS (SELECT de.id, count(*) OVER (PARTITION BY name) AS refs FROM de) SELECT qid, k.id, place, round(CASE WHEN place <= 30 THEN score * (1 + 0.06 * ln(1 + least(refs, 200))) ELSE score END, 3) AS score FROM k JOIN pop ON pop.id = k.id")
def q8_boosts(s: SparkSession, d: str) -> DataFrame:
    """All terms found, kind of declaration, tests, and how often a name occurs, the last for the best 30 only."""
    need = _questions(s).groupBy("qid").agg(F.count("*").alias("need"))
    prior = F.when(F.col("kind").isin("class", "interface"), 1.15).when(F.col("kind") == "object", 1.1).when(F.col("kind") == "property", 0.85).otherwise(1.0)
    whole, test = F.when(F.col("terms") == F.col("need"), 1.25).otherwise(1.0), F.when(F.col("test"), 0.85).otherwise(1.0)
    r = rescored(written(fields(s, d)), _questions(s)).join(F.broadcast(need), "qid").withColumn("score", F.round(F.col("score") * whole * prior * test, 6))
    r = r.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("bigint"))
    de = b.decls(s, d).select("id", "name")
    pop = de.join(r.select("id"), "id", "left_semi").join(de.groupBy("name").agg(F.count("*").alias("refs")), "name").select("id", "refs")
    boost = F.when(F.col("place") <= 30, 1 + 0.06 * F.ln(1 + F.least(F.col("refs"), F.lit(200)))).otherwise(1.0)
    return r.join(pop, "id").select("qid", "id", "place", F.round(F.col("score") * boost, 3).alias("score"))


_BM = f"""dw AS (SELECT doc_id, {stems_sql('text')} AS ws FROM documents), n AS (SELECT count(*) AS n, greatest(1.0, avg(len(ws))) AS al FROM dw), tk AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM dw) GROUP BY ALL), dfr AS (SELECT term, count(*) AS df FROM tk GROUP BY 1), {_QT}"""


@query(f"WITH {_BM}, e AS (SELECT qid, d.term, CASE WHEN d.term = qt.term THEN 1.0 ELSE 0.6 END AS w FROM qt JOIN dfr d ON d.term = qt.term OR (length(qt.term) >= 5 AND starts_with(d.term, qt.term))) SELECT qid, doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM tk JOIN e USING (term) JOIN dfr USING (term) CROSS JOIN n GROUP BY ALL")
def q9_okapi(s: SparkSession, d: str) -> DataFrame:
    """Okapi BM25 with prefix expansion from five characters; an expanded word counts 0.6 with its own rarity."""
    docs = written(b.documents(s, d).select("doc_id", stems(F.col("text")).alias("ws")))  # stemmed once
    tokens = op.token_table(docs, "doc_id", "ws")
    terms = op.expanded_terms(_questions(s), op.document_frequency(tokens).select("term"), 5, 0.6)
    return op.bm25(tokens, op.corpus_size(docs, "ws"), terms, "doc_id").withColumn("score", F.round("score", 6))


_JSON_TEXT = "json->>'description'"
_SIMILAR = f"""fw AS (SELECT id, num, 0 AS src, {stems_sql('summary')} AS ws FROM iss UNION ALL SELECT id, num, 1, {stems_sql('d')} FROM (SELECT id, num, {_JSON_TEXT} AS d FROM iss) UNION ALL SELECT iss.id, num, 2, {stems_sql('text')} FROM co JOIN iss ON iss.k = lower(trim(issue))),
tk AS (SELECT id, term, sum(CASE src WHEN 0 THEN 10.0 WHEN 1 THEN 1.0 ELSE 0.4 END)::DOUBLE AS tf, max((src < 2)::INT) AS own FROM (SELECT id, src, unnest(ws) AS term FROM fw) GROUP BY ALL), le AS (SELECT id, sum(len(ws)) AS l FROM fw GROUP BY 1), dfq AS (SELECT term, count(*) AS df FROM tk GROUP BY 1),
po AS (SELECT id, src, ws[i] AS term, i FROM fw, unnest(range(1, len(ws) + 1)) AS t(i) WHERE src < 2 AND num % 50 = 0), pg AS (SELECT id, src, term, min(i) AS pos, count(*) AS n FROM po GROUP BY id, src, term QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY src) = 1),
tr AS (SELECT id AS q, term, src FROM pg QUALIFY row_number() OVER (PARTITION BY id ORDER BY src, CASE WHEN src = 0 THEN 0 ELSE -n END, pos) <= 16), need AS (SELECT q, count(*) AS n, count(*) FILTER (src = 0) AS titles FROM tr GROUP BY 1),
hs AS (SELECT q, tk.id, round(sum(greatest(ln(((SELECT count(*) FROM le) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT avg(l) FROM le)))), 6) AS score, sum(own) AS shared, sum(CASE WHEN src = 0 THEN own ELSE 0 END) AS in_title FROM tr JOIN tk USING (term) JOIN dfq USING (term) JOIN le ON le.id = tk.id WHERE q <> tk.id GROUP BY ALL),
hb AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM hs QUALIFY place <= 60)"""


@query(f"WITH {_SIMILAR} SELECT q, id, place::INT AS place, shared::BIGINT AS shared FROM hb JOIN need USING (q) WHERE titles > 0 AND in_title >= least(2, titles) OR shared >= greatest(3, ceil(0.4 * n))")
def q11_similar_issues(s: SparkSession, d: str) -> DataFrame:
    """Other issues alike, best first; asked for the issues whose number is divisible by 50, against all."""
    i = written(b.issues(s, d).select("id", "num", "summary", F.get_json_object("json", "$.description").alias("description"), "k"))
    said = b.comments(s, d).select(F.lower(F.trim("issue")).alias("k"), "text").join(i.select("k", "id"), "k").select("id", "text")
    return similar(i, said, F.col("num") % 50 == 0)


def similar(issues: DataFrame, comments: DataFrame, asked: Column, top: int = 60) -> DataFrame:
    """(q, id, place, shared) for the `asked` of the issues (id, summary, description), with their comments (id, text).

    The `top` others by BM25 over fields weighted 10, 1 and, for comments, 0.4, as FTS5 has it: a word's weighted frequency saturates
    over all fields, and length is that of all fields. Of these stay the ones whose title or description has two of the asked title's
    words (all of a shorter title), or at least three and two fifths of all terms asked. `place` counts before that filter.
    """
    terms, placed, need = asked_terms(issues, comments, asked)
    h = walks.best_alike(written(placed), terms, top).withColumn("score", F.round("score", 6))
    best = h.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= top).join(need, "q")
    return best.filter("(titles > 0 AND in_title >= least(2, titles)) OR shared >= greatest(3, ceil(0.4 * n))").select("q", "id", "place", "shared")


def asked_terms(issues: DataFrame, comments: DataFrame, asked: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q, term, src) of the terms of each asked issue, (term, id, own, part) of their places, and (q, n, titles) of their numbers."""
    said = comments.select("id", F.lit(False).alias("asked"), F.lit(2).alias("src"), stems(F.col("text")).alias("ws"))
    words = written(_by_field(issues.withColumn("asked", asked), ("summary", "description"), "asked").unionByName(said))  # stemmed once
    weight = F.when(F.col("src") == 0, 10.0).when(F.col("src") == 1, 1.0).otherwise(0.4)
    tokens = words.select("id", "src", F.explode("ws").alias("term")).groupBy("id", "term").agg(F.sum(weight).alias("tf"), F.max((F.col("src") < 2).cast("int")).alias("own"))
    length = words.groupBy("id").agg(F.sum(F.size("ws")).alias("length"))
    sizes = length.agg(F.count("*").cast("double").alias("n_docs"), F.avg("length").alias("avg_len"))
    terms = written(query_terms(words.filter("asked AND src < 2")).withColumnRenamed("id", "q"))
    need = terms.groupBy("q").agg(F.count("*").alias("n"), F.count(F.when(F.col("src") == 0, 1)).alias("titles"))
    tokens = written(tokens.join(terms.select("term").distinct(), "term", "left_semi"))
    # What a word adds to an issue's score is the same for every question, so it is computed once for each of its places.
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("avg_len")))
    placed = tokens.join(op.document_frequency(tokens), "term").join(length, "id").join(F.broadcast(sizes), F.lit(True))
    return terms, placed.select("term", "id", "own", (idf * norm).alias("part")), need


#: What a shared link is worth, by kind; a symbol counts less if only its type is named.
TIERS = {"file": 100, "symbol": 100, "named": 85, "caller": 60, "module": 45, "task": 30}
_MENTIONED = {"file": r"[a-z]+/([A-Z][A-Za-z]+)\.(?:kt|java|md)", "module": r"([a-z]+)/[A-Z][A-Za-z]+\.(?:kt|java|md)", "symbol": r"([A-Z][A-Za-z]+\.[a-z][A-Za-z]+)", "named": r"([A-Z][a-z]+[A-Z][A-Za-z]+)"}
_KINDS = " UNION ALL ".join(f"SELECT k, id, num, '{n}' AS kind, unnest(regexp_extract_all(t, '{p}', 1)) AS what FROM tx" for n, p in _MENTIONED.items())
_TIERED = f"""{_EDGES}, {_LINKS}, {_SIMILAR}, tx AS (SELECT k, id, num, summary || ' ' || coalesce({_JSON_TEXT}, '') AS t FROM iss), me AS (SELECT DISTINCT * FROM ({_KINDS})), mq AS (SELECT * FROM me WHERE num % 50 = 0),
bn AS (SELECT id AS fid, regexp_replace(regexp_extract(path, '([^/.]*)[.][^/]*$', 1), '[0-9]+', '') AS name FROM f), cw AS (SELECT DISTINCT mq.k, mq.id, 'caller' AS kind, x.name AS what FROM mq JOIN bn z ON z.name = mq.what JOIN ed ON ed.b = z.fid JOIN bn x ON x.fid = ed.a WHERE mq.kind = 'file' AND x.name <> z.name),
tw AS (SELECT DISTINCT mq.k, mq.id, lower(task) AS ek FROM mq JOIN (SELECT DISTINCT task, regexp_extract(path, '([^/.]*)[.][^/]*$', 1) AS name FROM lk JOIN fl USING (doc_id) JOIN documents USING (doc_id) WHERE source = 'commit_messages') c ON c.name = mq.what WHERE mq.kind = 'file'),
ti AS (SELECT DISTINCT mq.id AS q, e.id, mq.kind FROM mq JOIN me e ON e.kind = mq.kind AND e.what = mq.what WHERE e.k <> mq.k UNION SELECT cw.id, e.id, 'caller' FROM cw JOIN me e ON e.kind IN ('file', 'named') AND e.what = cw.what WHERE e.k <> cw.k UNION SELECT tw.id, i.id, 'task' FROM tw JOIN iss i ON i.k = tw.ek WHERE i.k <> tw.k),
tv AS (SELECT q, id, CASE WHEN kind IN ('symbol', 'named') THEN 'symbol' ELSE kind END AS tier, max(CASE kind {' '.join(f"WHEN '{n}' THEN {v}" for n, v in TIERS.items())} END) AS v FROM ti GROUP BY ALL), co2 AS (SELECT q, id, max(v) AS best, count(*) AS tiers FROM tv GROUP BY ALL),
te AS (SELECT q, id, floor(20 * score / max(score) OVER (PARTITION BY q) + 0.5)::BIGINT AS text FROM hs WHERE score > 0),
sc10 AS (SELECT coalesce(c.q, t.q) AS q, coalesce(c.id, t.id) AS id, coalesce(best, 0) AS best, coalesce(tiers, 0) AS tiers, coalesce(text, 0) AS text FROM co2 c FULL JOIN te t ON t.q = c.q AND t.id = c.id)"""


@query(f"WITH {_TIERED} SELECT q, id, score::BIGINT AS score, tiers, place FROM (SELECT q, sc10.id, tiers, (best + 5 * greatest(0, tiers - 1)) * 100 + text + least(12, 4 * greatest(0, coalesce((json->>'votes')::BIGINT, 0))) AS score, row_number() OVER (PARTITION BY q ORDER BY (best + 5 * greatest(0, tiers - 1)) * 100 + text + least(12, 4 * greatest(0, coalesce((json->>'votes')::BIGINT, 0))) DESC, updated DESC, sc10.id)::INT AS place FROM sc10 JOIN iss ON iss.id = sc10.id WHERE best > 0 OR text > 0) WHERE place <= 60")
def q10_tiers(s: SparkSession, d: str) -> DataFrame:
    """Issues for an asked one by links in code: a shared file or symbol, a file that calls, a module, a task that landed on the files.

    The best tier decides, each further one adds a little; text and votes only order what has the same links. The best 60 of each
    asked issue, which are those whose number is divisible by 50, against all.
    """
    i = written(b.issues(s, d).select("k", "id", "num", "summary", F.get_json_object("json", "$.description").alias("description"), F.get_json_object("json", "$.votes").cast("bigint").alias("votes"), "updated"))
    text = F.concat_ws(" ", "summary", F.coalesce("description", F.lit("")))
    tag = lambda n, p: F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda w: F.struct(F.lit(n).alias("kind"), w.alias("what")))
    me = written(i.select("id", (F.col("num") % 50 == 0).alias("asked"), F.explode(F.concat(*[tag(n, p) for n, p in _MENTIONED.items()])).alias("x")).select("id", "asked", "x.*").distinct())
    mq = me.filter("asked").select(F.col("id").alias("q"), "kind", "what")
    stem_of = lambda c: F.regexp_extract(c, r"([^/.]*)[.][^/]*$", 1)
    asked_files = mq.filter("kind = 'file'").select(F.col("what").alias("name")).distinct()
    # Files call by the names they have without digits: those that declare a type, of the asked files, and those that use it, of the linked ones.
    names = b.files(s, d).select(F.col("id").alias("fid"), F.regexp_replace(stem_of("path"), "[0-9]+", "").alias("name"))
    declared = type_files(s, d).select(F.col("name").alias("t"), F.col("b").alias("fid")).join(names.join(asked_files, "name", "left_semi"), "fid").select(F.col("name").alias("z"), "t")
    declared = written(declared.distinct())
    linked = names.join(me.filter("kind IN ('file', 'named')").select(F.col("what").alias("name")), "name", "left_semi")
    used = used_names(s, d).select(F.col("a").alias("fid"), F.col("name").alias("t")).join(declared.select("t"), "t", "left_semi").join(linked, "fid").select("t", F.col("name").alias("x"))
    docs = b.documents(s, d).filter("source = 'commit_messages'").select("doc_id")
    landed_on = document_tasks(s, d).join(document_files(s, d), "doc_id").join(docs, "doc_id", "left_semi").select(F.lower("task").alias("k"), stem_of("path").alias("what")).distinct()
    tasks = landed_on.join(i.select("k", "id"), "k").select("id", F.lit("task").alias("kind"), "what")
    said = b.comments(s, d).select(F.lower(F.trim("issue")).alias("k"), "text").join(i.select("k", "id"), "k").select("id", "text")
    terms, placed, _ = asked_terms(i.select("id", "summary", "description", "num"), said, F.col("num") % 50 == 0)
    asked = mq.unionByName(terms.select("q", F.lit("term").alias("kind"), F.col("term").alias("what")))
    more = i.select("id", F.least(F.lit(12), 4 * F.greatest(F.coalesce("votes", F.lit(0)), F.lit(0))).alias("more"), "updated")
    worth = {k: ("symbol" if k == "named" else k, v) for k, v in TIERS.items()}
    rows = walks.best_linked(more, placed, me.select("id", "kind", "what").unionByName(tasks), asked, declared, used, worth, 60)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.desc("updated"), "id"))).filter("place <= 60").drop("updated")


@query(f"WITH x AS (SELECT id, 0 AS src, term, min(i) AS pos, count(*) AS n FROM (SELECT id, ws[i] AS term, i FROM (SELECT id, {stems_sql('summary')} AS ws FROM iss), unnest(range(1, len(ws) + 1)) AS t(i)) GROUP BY ALL UNION ALL SELECT id, 1, term, min(i), count(*) FROM (SELECT id, ws[i] AS term, i FROM (SELECT id, {stems_sql(chr(39) + chr(39) + ' || coalesce(json->>' + chr(39) + 'description' + chr(39) + ', ' + chr(39) + chr(39) + ')')} AS ws FROM iss), unnest(range(1, len(ws) + 1)) AS t(i)) GROUP BY ALL), u AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY src) = 1) SELECT id, term FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src, CASE WHEN src = 0 THEN 0 ELSE -n END, pos) <= 16")
def q12_query_terms(s: SparkSession, d: str) -> DataFrame:
    """Title words first, then the description's by frequency and place; 16 at most."""
    i = b.issues(s, d).select("id", "summary", F.get_json_object("json", "$.description").alias("description"))
    return query_terms(_by_field(i, ("summary", "description"))).select("id", "term")


def _by_field(issues: DataFrame, fields: tuple[str, ...], *keep: str) -> DataFrame:
    """(id, src, ws): the stems of each field of an issue, src being the field's place."""
    texts = F.array(*[F.struct(F.lit(n).alias("src"), F.col(c).alias("text")) for n, c in enumerate(fields)])
    return issues.select("id", *keep, F.explode(texts).alias("x")).select("id", *keep, "x.src", stems(F.col("x.text")).alias("ws"))


def query_terms(words: DataFrame) -> DataFrame:
    """(id, term, src) of the words (id, src, ws) of titles, src 0, and descriptions, src 1."""
    both = words.select("id", "src", F.posexplode("ws").alias("pos", "term"))
    g = both.groupBy("id", "src", "term").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    g = g.withColumn("first", F.row_number().over(W.partitionBy("id", "term").orderBy("src"))).filter("first = 1")
    r = F.row_number().over(W.partitionBy("id").orderBy("src", F.when(F.col("src") == 0, 0).otherwise(-F.col("n")), "pos"))
    return g.withColumn("r", r).filter("r <= 16").select("id", "term", "src")


#: What is asked of the facts; the third question has no word that is searched for.
ASKED = [(1, "Which tokens are limited?"), (2, "rebuilding the snapshot budget"), (3, "to be or not to be")]
_ASKED = "aq AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + ") v(qid, question))"
_FACTS = f"""{_ASKED}, aw AS (SELECT DISTINCT qid, unnest({stems_sql('question')}) AS term FROM aq), fx AS (SELECT doc_id, created, {stems_sql('text')} AS body, {stems_sql('project')} AS tags FROM documents WHERE source = 'facts'),
ft AS (SELECT doc_id, term, sum(w)::DOUBLE AS tf FROM (SELECT doc_id, unnest(body) AS term, 1.0 AS w FROM fx UNION ALL SELECT doc_id, unnest(tags), 0.3 FROM fx) GROUP BY ALL), fl AS (SELECT doc_id, len(body) + len(tags) AS l FROM fx),
pt AS (SELECT qid, aw.term AS qterm, doc_id, sum(tf) AS tf FROM ft JOIN aw ON ft.term = aw.term OR (length(aw.term) >= 5 AND starts_with(ft.term, aw.term)) GROUP BY ALL), pd AS (SELECT qterm, count(DISTINCT doc_id) AS df FROM pt GROUP BY 1),
fs AS (SELECT qid, doc_id, round(sum(greatest(ln(((SELECT count(*) FROM fl) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT greatest(avg(l), 1.0) FROM fl)))), 6) AS score FROM pt JOIN pd USING (qterm) JOIN fl USING (doc_id) GROUP BY ALL)"""


@query(f"WITH {_FACTS} SELECT qid, doc_id, score FROM fs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 10 UNION ALL (SELECT qid, doc_id, NULL FROM (SELECT qid FROM aq WHERE qid NOT IN (SELECT qid FROM aw)), (SELECT doc_id FROM fx ORDER BY created DESC NULLS LAST, doc_id DESC LIMIT 10))")
def q13_fact_search(s: SparkSession, d: str) -> DataFrame:
    """The ten best facts for a question: any of its stems, one of five characters or more as a prefix too; the newest facts if it has no stem."""
    facts = b.documents(s, d).filter("source = 'facts'").select("doc_id", "created", stems(F.col("text")).alias("body"), stems(F.col("project")).alias("tags"))
    facts = written(facts)
    asked = s.createDataFrame(ASKED, "qid int, question string")
    terms = asked.select("qid", F.explode(F.array_distinct(stems(F.col("question")))).alias("term"))
    tokens = op.weighted_tokens(facts, "doc_id", {"body": 1.0, "tags": 0.3})
    words = op.expanded_terms(terms, tokens.select("term").distinct(), 5, 1.0).select("qterm", "term").distinct()
    # A prefix is one phrase: the frequencies of the words it stands for add up.
    phrases = tokens.join(words, "term").groupBy("doc_id", F.col("qterm").alias("term")).agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    scores = op.fts_bm25(phrases, op.lengths(facts, ["body", "tags"]), terms.withColumn("w", F.lit(1.0)), "doc_id").withColumn("score", F.round("score", 6))
    best = op.top_per_query(scores, "doc_id", 10).select("qid", "doc_id", "score")
    newest = facts.orderBy(F.desc_nulls_last("created"), F.desc("doc_id")).limit(10).select("doc_id")
    unasked = asked.join(terms, "qid", "left_anti").select("qid")
    return best.unionByName(F.broadcast(unasked).join(newest, F.lit(True)).select("qid", "doc_id", F.lit(None).cast("double").alias("score")))


_SETS = f"ws AS (SELECT doc_id, list_sort(list_distinct({stems_sql('text')})) AS w FROM documents), cl AS (SELECT w, min(doc_id) AS rep FROM ws WHERE len(w) > 0 GROUP BY 1)"


@query(f"WITH {_SETS}, pr AS (SELECT a.w AS wa, b.w AS wb FROM cl a JOIN cl b ON a.rep <> b.rep AND len(a.w) >= 0.85 * len(b.w) - 1e-9 AND len(b.w) >= 0.85 * len(a.w) - 1e-9 AND list_filter(a.w, lambda x: regexp_matches(x, '[0-9]')) = list_filter(b.w, lambda x: regexp_matches(x, '[0-9]')) AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.85), l AS (SELECT wa AS w, count(*) AS links FROM pr GROUP BY 1) SELECT doc_id, coalesce(rep, doc_id) AS rep, coalesce(links, 0) AS links FROM ws LEFT JOIN cl USING (w) LEFT JOIN l USING (w)")
def q14_near_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Word sets alike by 0.85 that name the same numbers."""
    ws = F.array_sort(F.array_distinct(stems(F.col("text"))))
    docs = b.documents(s, d).select("doc_id", ws.alias("ws")).withColumn("numbers", F.array_join(F.filter("ws", lambda w: w.rlike("[0-9]")), " "))
    return op.similar_sets(written(docs), "doc_id", "ws", 0.85, "numbers")


def all_terms(issues: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, id, score) of the issues (id, ws) that have each term of a question (qid, term) as a prefix of a word, as FTS5 ranks them.

    A prefix is one phrase: the frequencies of the words it stands for add up. The questions are few and go to the issues, which are
    not shuffled; only those that have a term go on.
    """
    terms = F.broadcast(q.select("term").distinct())
    tf = F.expr("size(filter(ws, w -> startswith(w, term)))")
    phrases = written(issues.join(terms, tf > 0).select("id", "term", tf.cast("double").alias("tf"), F.size("ws").cast("bigint").alias("length")))
    scores = op.fts_bm25(phrases, op.lengths(issues, ["ws"]), q.withColumn("w", F.lit(1.0)), "id")
    n = phrases.join(F.broadcast(q), "term").groupBy("qid", "id").agg(F.count("*").alias("n"))
    whole = n.join(F.broadcast(q.groupBy("qid").agg(F.count("*").alias("need"))), "qid").filter("n = need")
    return scores.join(whole.select("qid", "id"), ["qid", "id"], "left_semi")


TASK_HITS = 2000
_TASKS = f"""{_QT}, tw AS (SELECT id, ws, len(ws) AS l FROM (SELECT id, {stems_sql('summary')} AS ws FROM iss)), tt AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(ws) AS term FROM tw) GROUP BY ALL),
tp AS (SELECT qid, qt.term AS qterm, id, sum(tf) AS tf FROM tt JOIN qt ON starts_with(tt.term, qt.term) GROUP BY ALL), td AS (SELECT qterm, count(DISTINCT id) AS df FROM tp GROUP BY 1), need AS (SELECT qid, count(*) AS need FROM qt GROUP BY 1),
ts AS (SELECT qid, id, round(sum(greatest(ln(((SELECT count(*) FROM tw) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT greatest(avg(l), 1.0) FROM tw)))), 6) AS score, count(*) AS n FROM tp JOIN td USING (qterm) JOIN tw USING (id) GROUP BY ALL)"""


@query(f"WITH {_TASKS} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS place FROM ts JOIN need USING (qid) WHERE n = need QUALIFY place <= {TASK_HITS}")
def q15_all_terms(s: SparkSession, d: str) -> DataFrame:
    """Issues that have all terms of a question, each as a prefix, in the order of their rank; the best 2 000."""
    issues, q = written(b.issues(s, d).select("id", stems(F.col("summary")).alias("ws"))), _questions(s)
    hit = all_terms(issues, q).withColumn("score", F.round("score", 6))
    return hit.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= TASK_HITS).select("qid", "id", "place")


_BULLETS = "l AS (SELECT doc_id, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i)), bl AS (SELECT * FROM l WHERE starts_with(text, '- '))"


@query(f"WITH {_BULLETS}, w AS (SELECT doc_id, line, unnest(list_distinct({stems_sql('text')})) AS term FROM bl), n AS (SELECT doc_id, count(*) AS n FROM bl GROUP BY 1), dfx AS (SELECT doc_id, term, count(*) AS df FROM w GROUP BY ALL), sc AS (SELECT doc_id, line, count(*) AS score FROM w JOIN dfx USING (doc_id, term) JOIN n USING (doc_id) WHERE df * 3 <= n GROUP BY ALL) SELECT doc_id, line, score FROM sc WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) <= 6")
def q16_bullets(s: SparkSession, d: str) -> DataFrame:
    """The six bullets with most words that aren't in over a third of a document's bullets."""
    bl = document_lines(s, d).filter(F.col("text").startswith("- "))
    w = bl.select("doc_id", "line", F.explode(F.array_distinct(stems(F.col("text")))).alias("term"))
    rare = w.groupBy("doc_id", "term").agg(F.count("*").alias("df")).join(bl.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").filter("df * 3 <= n").select("doc_id", "term")
    sc = w.join(rare, ["doc_id", "term"]).groupBy("doc_id", "line").agg(F.count("*").alias("score")).filter("score >= 2")
    return sc.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "line"))).filter("r <= 6").drop("r")


@query("WITH l AS (SELECT doc_id, i::BIGINT AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i)), m AS (SELECT doc_id, line FROM l WHERE contains(text, 'LimitShard') OR contains(text, 'TokenGap')), c AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 5) SELECT doc_id, line FROM m SEMI JOIN c USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 2")
def q17_documents_naming(s: SparkSession, d: str) -> DataFrame:
    m = document_lines(s, d).filter(F.col("text").contains("LimitShard") | F.col("text").contains("TokenGap")).select("doc_id", "line")
    top = m.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(5)
    return m.join(top, "doc_id", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("line"))).filter("r <= 2").drop("r")


@query("WITH p AS (SELECT id, kind, name, string_split(fqn, '.') AS ps FROM de) SELECT id, array_to_string(ps[i:], '.') AS key FROM p, unnest(range(1, len(ps))) AS t(i) UNION ALL SELECT id, name FROM p WHERE kind = 'class'")
def q18_lookup_keys(s: SparkSession, d: str) -> DataFrame:
    """Every suffix of a qualified name with two parts at least, and the bare name of types."""
    ps = F.split("fqn", r"\.")
    suffixes = F.when(F.size(ps) > 1, F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda i: F.array_join(F.slice(ps, i, F.size(ps)), "."))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(suffixes, F.when(F.col("kind") == "class", F.array("name")).otherwise(F.array().cast("array<string>")))
    return b.decls(s, d).select("id", F.explode(keys).alias("key"))


@query(f"WITH {_SETS}, t AS (SELECT rep, w, unnest(w) AS term FROM cl), dft AS (SELECT term, count(*) AS df FROM t GROUP BY 1) SELECT term, df FROM dft WHERE df >= 2")
def j18_shared_words(s: SparkSession, d: str) -> DataFrame:
    """The words over which similar texts may meet, with the number of classes that hold them."""
    ws = b.documents(s, d).select(F.array_sort(F.array_distinct(stems(F.col("text")))).alias("w")).distinct()
    return ws.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")
