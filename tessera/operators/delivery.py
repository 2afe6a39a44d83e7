"""Messages delivered more than once: narrow winner selection and per-file deletion vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import written

WORD = 64
WORDS = 64  # words in a block of a vector: 4 096 rows, 512 bytes
GROUP_BYTES = 64 << 20  # vectors sent to all executors at once

KEY, WORD_NO, BLOCK = "_dv_file", "_dv_word", "_dv_block"


def _located(raw: DataFrame) -> DataFrame:
    row = F.col("_metadata.row_index")
    return raw.withColumns({
        KEY: F.xxhash64(F.col("_metadata.file_path")),
        "_dv_path": F.col("_metadata.file_path"),
        WORD_NO: F.floor(row / WORD).cast("bigint"),
        "_dv_bit": (row % WORD).cast("int"),
    })


@dataclass
class DeletionVectors:
    """Rows to leave out of the files under `path`: for each file and block of 4 096 rows a bitmap of 64 words of 64 bits.

    `groups` are the files with deletions, in parts whose vectors fit one broadcast; a part reads its own files only, and the files
    without deletions are read plainly. Vectors take about one bit for each row of a block with deletions, so a part is a
    terabyte of payload or so; more vectors mean more parts, never a shuffle of payload or a second read of a file.
    """

    spark: SparkSession
    path: str
    vectors: DataFrame
    groups: list[list[str]]
    clean: list[str]

    def _files(self, uris: list[str]) -> DataFrame:
        """Some of the files, with the whole table's schema and partition columns."""
        whole = self.spark.read.parquet(self.path)
        paths = [unquote(u) for u in uris]
        reader = self.spark.read.schema(whole.schema)
        if not all(p.rstrip("/").endswith(self.path.rstrip("/").split(":")[-1]) for p in paths):  # a folder, which may name partitions
            reader = reader.option("basePath", self.path)
        return reader.parquet(*paths)

    def _part(self, rows: DataFrame, vectors: DataFrame, columns: list[str], deleted: bool) -> DataFrame:
        located = _located(rows).withColumn(BLOCK, F.floor(F.col(WORD_NO) / WORDS).cast("bigint"))
        joined = located.join(F.broadcast(vectors.drop("_dv_path")), [KEY, BLOCK], "inner" if deleted else "left")
        word = F.coalesce(F.get("_dv_words", (F.col(WORD_NO) % WORDS).cast("int")), F.lit(0).cast("bigint"))
        gone = F.call_function("bit_get", word, F.col("_dv_bit")) == 1
        return joined.filter(gone if deleted else ~gone).select(*columns)

    def _read(self, columns: list[str] | None, deleted: bool) -> DataFrame:
        whole = self.spark.read.parquet(self.path)
        columns = whole.columns if columns is None else columns
        if not self.groups:
            return whole.select(*columns).limit(0) if deleted else whole.select(*columns)
        if len(self.groups) == 1:
            return self._part(whole, self.vectors, columns, deleted)
        parts = [self._part(self._files(g), self.vectors.filter(F.col("_dv_path").isin(g)), columns, deleted) for g in self.groups]
        if self.clean and not deleted:
            parts.append(self._files(self.clean).select(*columns))
        return reduce(DataFrame.unionByName, parts)

    def kept(self, columns: list[str] | None = None) -> DataFrame:
        """The table without the deleted rows; the payload is never shuffled."""
        return self._read(columns, False)

    def deleted(self, columns: list[str]) -> DataFrame:
        """The given columns of the deleted rows."""
        return self._read(columns, True)


def delivery_vectors(spark: SparkSession, path: str, message_id: Column, greatest: Column, smallest: Column) -> DeletionVectors:
    """Keep one row per `message_id`: the greatest `greatest` (null smallest), then the smallest `smallest`.

    Ids are compared exactly; rows with a null or empty id stay. Rows that tie in both (a row repeated whole) keep the one in the
    file with the greater key, then the first in the file. An empty table gives no vectors. Columns of the table may have any name
    that doesn't begin with `_dv_`.

    Only the identifier, the order columns and the position (file key, row number) are shuffled, and partially aggregated before.
    The vectors are made of two bit-ors over positions, all identified rows minus winners, so nothing is joined and a hot
    identifier is combined before the shuffle.
    """
    located = _located(spark.read.parquet(path))
    narrow = located.select(
        message_id.alias("_dv_id"), greatest.alias("_dv_most"), smallest.alias("_dv_least"), KEY, "_dv_path", WORD_NO, "_dv_bit"
    ).filter(F.col("_dv_id").isNotNull() & (F.col("_dv_id") != ""))
    least = F.when(F.col("_dv_least").isNotNull(), -F.col("_dv_least"))
    winner = F.max(F.struct("_dv_most", least.alias("l"), KEY, (-F.col(WORD_NO)).alias("w"), (-F.col("_dv_bit")).alias("b")))
    winners = narrow.groupBy("_dv_id").agg(winner.alias("_dv_winner")).select(
        F.col("_dv_winner." + KEY).alias(KEY), (-F.col("_dv_winner.w")).alias(WORD_NO), (-F.col("_dv_winner.b")).alias("_dv_bit")
    )
    one = lambda bit: F.expr(f"shiftleft(1L, {bit})")
    zero = F.lit(0).cast("bigint")
    both = narrow.select(KEY, "_dv_path", WORD_NO, one("_dv_bit").alias("all"), zero.alias("won")).unionByName(
        winners.select(KEY, F.lit(None).cast("string").alias("_dv_path"), WORD_NO, zero.alias("all"), one("_dv_bit").alias("won"))
    )
    words = both.groupBy(KEY, WORD_NO).agg(
        F.max("_dv_path").alias("_dv_path"), F.bit_or("all").alias("all"), F.bit_or("won").alias("won")
    ).withColumn("bits", F.col("all").bitwiseAND(F.bitwise_not("won"))).filter("bits != 0")
    entry = F.struct((F.col(WORD_NO) % WORDS).cast("int").alias("k"), F.col("bits").alias("v"))
    sparse = F.map_from_entries(F.collect_list(entry))
    dense = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.element_at(F.col("m"), k), F.lit(0).cast("bigint")))
    blocks = words.groupBy(KEY, F.floor(F.col(WORD_NO) / WORDS).cast("bigint").alias(BLOCK)).agg(F.max("_dv_path").alias("_dv_path"), sparse.alias("m"))
    vectors = written(blocks.select(KEY, BLOCK, "_dv_path", dense.alias("_dv_words")))
    # One row per file that has deletions: bounded by the file listing, which the driver holds anyway.
    sizes = vectors.groupBy(KEY, "_dv_path").agg((F.count("*") * (8 * WORDS + 64)).alias("n")).collect()
    listed = [re.sub(r"^(\w+):///", r"\1:/", p) for p in spark.read.parquet(path).inputFiles()]  # as rows name them
    if len({xxhash.xxh64_intdigest(p, seed=42) for p in listed}) != len(listed):
        raise ValueError("two files share a key")
    groups: list[list[str]] = []
    held = GROUP_BYTES
    for r in sorted(sizes, key=lambda r: r["_dv_path"]):
        if held + r["n"] > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r["_dv_path"])
        held += r["n"]
    named = {r["_dv_path"] for r in sizes}
    clean = [p for p in listed if p not in named] if len(groups) > 1 else []
    return DeletionVectors(spark, path, vectors, groups, clean)
