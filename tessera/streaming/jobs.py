"""Incremental forms: file streams with checkpoints, watermarks, windows, pairing and exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import hadoop_path, scratch


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under `path`, a file or a folder, with the batch reader's schema."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith("/" + name) for f in now.inputFiles()):  # a stream reads folders or patterns, so a file is a pattern of one
        path = f"{folder}/[{name[0]}]{name[1:]}"
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drained(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Runs an appending stream over what is there now and gives all its output so far as a table.

    With a `path` a later call goes on from the checkpoint beside it, after a stop as after a failure; without, the output is a
    table of this application alone.
    """
    spark = stream.sparkSession
    out = path or scratch(spark, "stream")
    run = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}.state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


BUCKETS = 16
_BUCKET = "_bucket"


def _versions(spark: SparkSession, path: str) -> dict[int, dict[int, str]]:
    """The whole versions of each bucket: bucket to number to folder. A version counts once its batch is written to the end."""
    fs, root = hadoop_path(spark, path)
    out: dict[int, dict[int, str]] = {}
    for v in fs.listStatus(root) if fs.exists(root) else []:
        number = v.getPath().getName().partition("version=")[2]
        if number and fs.exists(v.getPath().suffix("/_SUCCESS")):
            for b in fs.listStatus(v.getPath()):
                bucket = b.getPath().getName().partition(f"{_BUCKET}=")[2]
                if bucket:
                    out.setdefault(int(bucket), {})[int(number)] = b.getPath().toString()
    return out


def _read(spark: SparkSession, folders: list[str], empty: DataFrame) -> DataFrame:
    return spark.read.schema(empty.schema).parquet(*folders) if folders else empty


def upserted(stream: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], path: str | None = None, mode: str = "append", buckets: int = BUCKETS) -> DataFrame:
    """Merges each batch into a table by `merge(old, batch)` and gives the table as it is then.

    The table lies in buckets of the keys' hash, and `merge` must treat each key on its own: only the buckets that a batch has rows
    for are read and written again. A batch writes a version named by its number from the versions before it, so a batch that runs
    again, or after a restart with the same `path`, replaces only what it wrote itself. The two newest versions of a bucket are kept.
    """
    spark = stream.sparkSession
    out = path or scratch(spark, "upserted")
    nothing = spark.createDataFrame([], stream.schema)
    # The columns of the result are those of a merge into nothing; `old` has them from the first batch on.
    empty = spark.createDataFrame([], merge(None, nothing).schema)
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))

    def fold(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        if not touched:
            batch.unpersist()
            return
        there = _versions(spark, out)
        before = {b: [n for n in there.get(b, {}) if n < number] for b in touched}
        old = _read(spark, [there[b][max(ns)] for b, ns in before.items() if ns], empty)
        merged = merge(old, batch).withColumn(_BUCKET, bucket)
        merged.repartition(min(buckets, len(touched)), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{out}/version={number}")
        batch.unpersist()
        for b in touched:
            for n in sorted(before[b])[:-1]:
                fs, p = hadoop_path(spark, there[b][n])
                fs.delete(p, True)

    stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", f"{out}.state").trigger(availableNow=True).start().awaitTermination()
    return _read(spark, [ns[max(ns)] for ns in _versions(spark, out).values()], empty)


def replaced(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """The last row of each key of a stream in update mode."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.join(new, [old[k].eqNullSafe(new[k]) for k in keys], "left_anti").unionByName(new)

    return upserted(stream, keys, merge, path, "update")


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str], path: str | None = None) -> DataFrame:
    """(start, keys, n) per window. State is kept until the watermark passes a window; what was counted stays in the table."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return replaced(w.select(F.col("w.start").alias("start"), *keys, "n"), ["start", *keys], path)


def sliding(events: DataFrame, at: str, width: str, slide: str, late: str, path: str | None = None) -> DataFrame:
    """(start, n) per window of overlapping ones, kept as by `tumbling`."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return replaced(w.select(F.col("w.start").alias("start"), "n"), ["start"], path)


def sessions(events: DataFrame, at: str, gap: str, key: str, path: str | None = None) -> DataFrame:
    """(key, start, end, n) of each key's sessions, which end when `gap` passes without a row; late rows join or bridge what was there.

    There is no streaming state: each batch's sessions are merged with those of the table, of the batch's keys only. Rows without a
    time are left out.
    """

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new.filter(F.col(at).isNotNull()).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
        if old is None:
            return rows
        ordered = W.partitionBy(key).orderBy("start", "end")
        before = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
        opened = old.unionByName(rows).withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
        numbered = opened.withColumn("s", F.sum("new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        return numbered.groupBy(key, "s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("s")

    return upserted(events.select(key, at), [key], merge, path)


def exceeded(usage: DataFrame, day: Column, keys: list[str], value: str, limit: float, path: str | None = None) -> DataFrame:
    """(day) of each day whose values sum to more than `limit`, announced once, in whichever batch it crosses the limit.

    `value` is the greatest of rows with the same `keys`. The table holds the days' values and, with null keys, what was announced;
    both are written in one step, so an announcement is neither lost nor repeated.
    """

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if old is None else old.filter(~F.col("announced")).select(*new.columns).unionByName(new)
        values = rows.groupBy("day", *keys).agg(F.max(value).alias(value)).withColumn("announced", F.lit(False))
        over = values.groupBy("day").agg(F.sum(value).alias("total")).filter(F.col("total") > limit).select("day")
        known = over.limit(0) if old is None else old.filter("announced").select("day")
        told = known.unionByName(over.join(known, "day", "left_anti"))
        return values.unionByName(told.withColumn("announced", F.lit(True)), allowMissingColumns=True)

    state = upserted(usage.select(day.alias("day"), *keys, value).filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)), ["day"], merge, path)
    return state.filter("announced").select("day")


def growing_messages(lines: DataFrame, key: str, order: str, value: str, at: str, silent_ms: int = 3_600_000) -> DataFrame:
    """(key, order, delta): of each message's lines what the value grew beyond all before, with one number of state per message.

    `lines` has a watermark on `at`. The state is dropped when the watermark is `silent_ms` past a message's last line, so memory is
    bounded; a line that comes later still counts anew.
    """

    def grow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        most = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value]):
            out.append((k[0], o, max(0, v - most)))
            most = max(most, v)
        state.update((int(most),))
        last = int(rows[at].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + silent_ms)
        yield pd.DataFrame(out, columns=[key, order, "delta"])

    return lines.groupBy(key).applyInPandasWithState(grow, f"{key} string, {order} bigint, delta bigint", "most bigint", "append", GroupStateTimeout.EventTimeTimeout)
