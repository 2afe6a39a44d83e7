"""What the query modules share: a registry, the tables with repeated rows and superseded versions removed, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.delivery import DeletionVectors, delivery_vectors
from tessera.session import table

#: The instant at which ages are measured.
NOW = 1_767_225_600_000

PRELUDE = """WITH RECURSIVE f AS (SELECT DISTINCT ON (id) * FROM files), de AS (SELECT DISTINCT * FROM decls),
iss AS (SELECT *, lower(trim(id)) AS k, nullif(lower(trim(parent)), '') AS pk FROM (SELECT DISTINCT * FROM issues) QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated DESC) = 1),
co AS (SELECT DISTINCT * FROM comments), fc AS (SELECT DISTINCT id, project, issue, "at" AS at_ms, lower(field) AS field, removed, added, author FROM field_changes),
ru AS (SELECT * FROM (SELECT DISTINCT * FROM runs) QUALIFY row_number() OVER (PARTITION BY id ORDER BY end_ms DESC NULLS LAST, turns DESC) = 1),
uh AS (SELECT run_id, hour, max(cost) AS cost FROM usage_hours GROUP BY ALL),
st AS (SELECT seq, path, session, project, type, timestamp AS at_text, message.id AS mid, message.model AS model, message.usage.output_tokens AS output, coalesce(message.usage.input_tokens, 0) AS input, message.content AS content, length(message.content) AS chars FROM start_a WHERE session IS NOT NULL),
ln AS (SELECT id, path, i::BIGINT AS line, lines[i] AS text FROM (SELECT id, path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM f WHERE content IS NOT NULL), unnest(range(1, len(lines) + 1)) AS t(i))
"""


class Registry:
    """Queries by name, with their SQL where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, bare: bool = False) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql if bare else PRELUDE + (", " + sql[5:] if sql.startswith("WITH ") else sql)
            return f

        return add


_ONCE: dict[tuple, DeletionVectors] = {}


def once(s: SparkSession, d: str, name: str) -> DeletionVectors:
    """The deletion vectors of rows delivered again, by `id`, made once per application: later queries read payload without a shuffle."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _ONCE:
        order = F.col("mtime") if name == "files" else F.lit(0).cast("bigint")
        _ONCE[key] = delivery_vectors(s, f"{d}/{name}.parquet", F.col("id").cast("string"), order, F.lit(0).cast("bigint"))
    return _ONCE[key]


def files(s: SparkSession, d: str) -> DataFrame:
    """Each file once, the latest where rows of an id differ. Contents are read where they lie, and filters on them reach the scan."""
    return once(s, d, "files").kept()


def decls(s: SparkSession, d: str) -> DataFrame:
    """Each declaration once. Only the columns that a query uses are shuffled, as in the readers below."""
    return table(s, d, "decls").dropDuplicates(["id"])


def issues(s: SparkSession, d: str) -> DataFrame:
    """The version with the greatest `updated` of each id; `k` and `pk` are the id and the parent as they are compared."""
    rows = table(s, d, "issues").withColumn("k", F.lower(F.trim("id")))
    last = rows.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(F.desc("updated")))).filter("rn = 1").drop("rn")
    return last.withColumn("pk", F.nullif(F.lower(F.trim("parent")), F.lit("")))


def comments(s: SparkSession, d: str) -> DataFrame:
    """Each comment once; texts are read where they lie."""
    return once(s, d, "comments").kept()


def changes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "field_changes").dropDuplicates(["id"]).withColumn("field", F.lower("field")).withColumnRenamed("at", "at_ms")


def runs(s: SparkSession, d: str) -> DataFrame:
    """Of each run the row stored last: the greatest end, then the most turns."""
    w = W.partitionBy("id").orderBy(F.desc_nulls_last("end_ms"), F.desc("turns"))
    return table(s, d, "runs").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def hours(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_hours").groupBy("run_id", "hour").agg(F.max("cost").alias("cost"))


def steps(s: SparkSession, d: str) -> DataFrame:
    """Transcript lines as steps of a session."""
    m = F.col("message")
    return table(s, d, "start_a").filter("session IS NOT NULL").select(
        "seq", "path", "session", "project", "type", F.col("timestamp").alias("at_text"), m["id"].alias("mid"), m["model"].alias("model"), m["usage"]["output_tokens"].alias("output"),
        F.coalesce(m["usage"]["input_tokens"], F.lit(0)).alias("input"), m["content"].alias("content"), F.char_length(m["content"]).alias("chars"),
    )


def lines(s: SparkSession, d: str) -> DataFrame:
    """(id, path, line, text) of all file contents, whatever their line ends."""
    rows = files(s, d).filter("content IS NOT NULL")
    return rows.select("id", "path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("i", "text")).select("id", "path", (F.col("i") + 1).cast("bigint").alias("line"), "text")


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")
