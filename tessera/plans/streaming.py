"""Streaming and incremental semantics; each stream's result is that of the batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import tables as op
from tessera.plans import base as b
from tessera.session import table
from tessera.streaming import jobs

query = b.Registry()
QUERIES, SQL = query.queries, query.sql


def _events(s: SparkSession, d: str) -> DataFrame:
    return jobs.file_stream(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, event_type FROM events WHERE value > 50", bare=True)
def t1_resumable_source(s: SparkSession, d: str) -> DataFrame:
    return jobs.drained(_events(s, d).filter("value > 50").select("event_id", "event_type"))


@query("SELECT k, max(updated) AS updated FROM iss GROUP BY 1")
def t2_watermark(s: SparkSession, d: str) -> DataFrame:
    """Versions never step back: a batch's newest version of an id replaces an older one only."""
    rows = jobs.file_stream(s, f"{d}/issues.parquet").select(F.lower(F.trim("id")).alias("k"), "updated")
    merge = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("k").agg(F.max("updated").alias("updated"))
    return jobs.upserted(rows, ["k"], merge)


@query("SELECT k FROM iss WHERE updated >= (SELECT max(updated) - 864000000 FROM iss) UNION SELECT k FROM iss WHERE project = 'HRB' AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.issue = iss.id)")
def t3_reconciled(s: SparkSession, d: str) -> DataFrame:
    """What is asked again: the margin before the watermark, and rows that a full pass finds without history."""
    i = b.issues(s, d)
    late = i.join(F.broadcast(i.agg((F.max("updated") - 864_000_000).alias("mark"))), F.lit(True)).filter("updated >= mark").select("k")
    lost = i.filter("project = 'HRB'").join(b.changes(s, d).select(F.col("issue").alias("id")), "id", "left_anti").select("k")
    return late.union(lost).distinct()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", bare=True)
def t4_tumbling(s: SparkSession, d: str) -> DataFrame:
    out = jobs.tumbling(_events(s, d), "ts", "1 hour", "365 days", ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i FOR i IN range(0, 4)]) AS start FROM events) GROUP BY 1", bare=True)
def t5_sliding(s: SparkSession, d: str) -> DataFrame:
    out = jobs.sliding(_events(s, d), "ts", "1 hour", "15 minutes", "365 days")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(*) AS n FROM g GROUP BY user_id, k", bare=True)
def t6_sessions(s: SparkSession, d: str) -> DataFrame:
    out = jobs.sessions(_events(s, d), "ts", "1 day", "user_id")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT a.event_id AS opened, min(z.event_id) AS closed FROM events a JOIN events z ON z.user_id = a.user_id AND a.event_type = 'view' AND z.event_type = 'purchase' AND z.ts > a.ts AND z.ts <= a.ts + INTERVAL 1 HOUR GROUP BY 1", bare=True)
def t7_paired(s: SparkSession, d: str) -> DataFrame:
    """A stream-stream join within an hour; both sides' state is bounded by the watermark."""
    e = _events(s, d).select("event_id", "user_id", "event_type", "ts").withWatermark("ts", "1 day")
    a = e.filter("event_type = 'view'").select(F.col("event_id").alias("opened"), "user_id", F.col("ts").alias("from"))
    z = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("closed"), F.col("user_id").alias("u"), F.col("ts").alias("to"))
    pairs = jobs.drained(a.join(z, F.expr("user_id = u AND to > `from` AND to <= `from` + INTERVAL 1 HOUR")).select("opened", "closed"))
    return pairs.groupBy("opened").agg(F.min("closed").alias("closed"))


@query("SELECT DISTINCT mid FROM st WHERE mid <> ''")
def t8_deduplicated(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.file_stream(s, f"{d}/start_a.parquet").select(F.col("message.id").alias("mid"), "received_at").filter("mid <> ''")
    return jobs.drained(rows.withWatermark("received_at", "365 days").dropDuplicatesWithinWatermark(["mid"]).select("mid"))


@query("SELECT seq, greatest(output - coalesce(max(output) OVER (PARTITION BY mid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS delta, mid FROM st WHERE mid <> '' AND output IS NOT NULL")
def t8_growing_messages(s: SparkSession, d: str) -> DataFrame:
    rows = jobs.file_stream(s, f"{d}/start_a.parquet").select(F.col("message.id").alias("mid"), "seq", F.col("message.usage.output_tokens").alias("output"), "received_at")
    rows = rows.filter("mid <> '' AND output IS NOT NULL").withWatermark("received_at", "365 days")
    return jobs.drained(jobs.growing_messages(rows, "mid", "seq", "output", "received_at"))


@query("SELECT day, 'over' AS what FROM (SELECT hour // 24 AS day, sum(cost) AS c FROM uh GROUP BY 1) WHERE c > 0.3")
def t9_alerts(s: SparkSession, d: str) -> DataFrame:
    """Each day is announced once, in the batch in which its sum crosses the limit."""
    rows = jobs.file_stream(s, f"{d}/usage_hours.parquet")
    days = jobs.exceeded(rows, F.floor(F.col("hour") / 24), ["run_id", "hour"], "cost", 0.3)
    return days.select("day", F.lit("over").alias("what"))


@query("WITH o AS (SELECT session, type FROM st WHERE seq % 3 <> 0 GROUP BY ALL), n AS (SELECT session, type FROM st WHERE seq % 4 <> 0 GROUP BY ALL) SELECT coalesce(o.session, n.session) AS session, coalesce(o.type, n.type) AS type, CASE WHEN o.session IS NULL THEN 'added' ELSE 'removed' END AS mark FROM o FULL JOIN n ON o.session = n.session AND o.type IS NOT DISTINCT FROM n.type WHERE o.session IS NULL OR n.session IS NULL")
def t10_set_difference(s: SparkSession, d: str) -> DataFrame:
    st = b.steps(s, d)
    old, new = (st.filter(f"seq % {m} <> 0").select("session", "type").distinct() for m in (3, 4))
    return op.compared(old, new, ["session", "type"], [])


#: Where a reader left off, and how many events it takes at a time.
CURSOR, PAGE = 500, 200


def replay(events: DataFrame, after: int, page: int) -> DataFrame:
    """The next `page` events after a cursor, by number: what a reader that fell behind asks for."""
    return events.filter(F.col("event_id") > after).orderBy("event_id").limit(page)


@query(f"SELECT event_id, event_type FROM events WHERE event_id > {CURSOR} ORDER BY event_id LIMIT {PAGE}", bare=True)
def t11_replay(s: SparkSession, d: str) -> DataFrame:
    return replay(b.events(s, d), CURSOR, PAGE).select("event_id", "event_type")


#: Files stamped from this instant on have moved since the overlay was built; more than so many mean a full pass.
REFRESHED_AT, FEW = 1_767_225_600_000, 200


def refreshed(files: DataFrame, built: DataFrame, few: int = FEW) -> DataFrame:
    """(id, state, incremental) of the files (id, size, mtime) against the stamps of the last build: moved ones are read again,
    if they are `few` at most, else all of them; files that are gone are `gone`."""
    old = built.select("id", F.struct("size", "mtime").alias("was"))
    both = files.select("id", F.struct("size", "mtime").alias("now")).join(old, "id", "full_outer")
    moved = F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("was"))
    count = both.agg((F.count(F.when(moved | F.col("now").isNull(), 1)) <= few).alias("incremental"))
    state = F.when(F.col("now").isNull(), "gone").when(moved | ~F.col("incremental"), "reparsed").otherwise("kept")
    return both.join(F.broadcast(count), F.lit(True)).select("id", state.alias("state"), "incremental")


_STAMPS = f"b AS (SELECT id, size, mtime FROM f WHERE mtime < {REFRESHED_AT}), x AS (SELECT id, f.mtime IS NULL AS gone, b.id IS NULL OR (f.size, f.mtime) IS DISTINCT FROM (b.size, b.mtime) AS moved FROM (SELECT * FROM f WHERE deleted = 0) f FULL JOIN b USING (id)), c AS (SELECT count(*) FILTER (moved OR gone) <= {FEW} AS incremental FROM x)"


@query(f"WITH {_STAMPS} SELECT id, CASE WHEN gone THEN 'gone' WHEN moved OR NOT incremental THEN 'reparsed' ELSE 'kept' END AS state, incremental FROM x, c")
def t13_refresh(s: SparkSession, d: str) -> DataFrame:
    """Which files are read again: the stamps before the last build against those of the files that are there."""
    f = b.files(s, d).select("id", "size", "mtime", "deleted")
    return refreshed(f.filter("deleted = 0"), f.filter(F.col("mtime") < REFRESHED_AT))


@query("SELECT count(*) AS rows, count(DISTINCT id) AS ids, max(updated) AS newest FROM issues")
def t14_snapshot(s: SparkSession, d: str) -> DataFrame:
    """One consistent reading: the files are listed once and all figures come of that listing."""
    paths = table(s, d, "issues").inputFiles()
    return s.read.parquet(*paths).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.max("updated").alias("newest"))


@query("WITH x AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT event_id FROM x WHERE r <= 3", bare=True)
def t5_last_calls(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return b.events(s, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("event_id")
