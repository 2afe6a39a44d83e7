"""Queries of the text problems and what SQL says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import encoding, mixing, packing, pii, sources
from tessera.llm.tokens import token_count
from tessera.session import table


def _scans(spark: SparkSession, d: str) -> DataFrame:
    comments = table(spark, d, "comments").select(F.lit("comments").alias("tbl"), F.col("id").alias("row_id"), "text")
    runs = table(spark, d, "runs").select(F.lit("runs").alias("tbl"), F.col("id").cast("string").alias("row_id"), F.col("title").alias("text"))
    return pii.scanned(comments.unionByName(runs), table(spark, d, "people"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(_scans(spark, d))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).filter("redacted IS NOT NULL").select("tbl", "row_id", "redacted").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sources.parsed(table(spark, d, "files")).filter("NOT valid").select("id")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    return sources.parsed(table(spark, d, "files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return sources.rates(sources.parsed(table(spark, d, "files")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "documents")).filter("garbled").select("doc_id").distinct()


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The documents of `p10_found` that the byte-structure automaton finds."""
    return encoding.repaired(table(spark, d, "documents")).filter(F.col("causes").contains("utf-8 as ")).select("doc_id", "causes")


def p10_without_structure(spark: SparkSession, d: str) -> DataFrame:
    """The documents of `p10_found` with garbling that has no byte structure: pages mistaken for one another, and lost bytes."""
    other = F.filter(F.split("causes", ", "), lambda c: (c != "") & ~c.startswith("utf-8 as "))
    return encoding.repaired(table(spark, d, "documents")).filter(F.size(other) > 0).select("doc_id", F.array_join(other, ", ").alias("causes"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "documents")).filter("garbled").select("doc_id", "causes", "restored")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    return packing.packed(sizes, table(spark, d, "pack_plans"), "doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_pack(spark, d), table(spark, d, "pack_plans"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "source", token_count(F.col("text")).alias("tokens"))
    return mixing.mixed(texts, table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_errors, p4_rates, p8_pack, p8_containers, p9_mix, p9_shares, p10_found, p10_restored, p10_spans, p10_without_structure)}
SQL: dict[str, str] = {}
