"""Queries that once did less than the whole job."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.plans import base, graph, search, windows

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def test_similar_by_two_title_words_or_description(spark):
    rows = [
        ("A-10", "Rebuild snapshot index nightly before backup", "lantern harbor", None),
        ("A-1", "Snapshot index grows", None, None),  # two words of the title, less than two fifths of all
        ("A-2", "Other matter", "The nightly backup precedes the harbor lantern", None),  # by its description alone
        ("A-3", "Snapshot only", "nothing", None),
        ("A-4", "Unlike", "nothing", "snapshot index nightly backup"),  # a comment ranks, but is no shared word
    ] + [(f"B-{i}1", "Plain filler", None, None) for i in range(20)]
    df = spark.createDataFrame([r[:3] for r in rows], "id string, summary string, description string")
    said = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3]], "id string, text string")
    out = search.similar(df, said, df["id"] == "A-10").collect()
    assert {(r["id"], r["shared"]) for r in out} == {("A-1", 2), ("A-2", 4)}
    assert next(r["place"] for r in out if r["id"] == "A-1") == 1


def test_all_terms_are_found_without_a_vocabulary(spark, monkeypatch):
    issues = spark.createDataFrame([("A", ["limits", "limiter", "token"]), ("B", ["limit"]), ("C", ["token", "limit", "x"]), ("D", []), ("E", ["tok", "lim"])], "id string, ws array<string>")
    q = spark.createDataFrame([(1, "limit"), (1, "token"), (2, "tok"), (3, "none")], "qid int, term string")
    monkeypatch.setattr(search.op, "expanded_terms", lambda *a: pytest.fail("all prefixes of all words"))
    assert {(r["qid"], r["id"]) for r in search.all_terms(issues, q).collect()} == {(1, "A"), (1, "C"), (2, "A"), (2, "C"), (2, "E")}


@tables
def test_all_files_and_declarations_are_asked(spark):
    checked = {r["file_id"] % 5 for r in graph.r18_name_check(spark, D).collect()}
    assert checked == {0, 1, 2, 3, 4}
    assert {r["id"] % 7 for r in graph.r8_callers_of_changed(spark, "/root/testdata/sf0.01").collect()} - {0}
    rows = graph.r9_symbol_at(spark, D).collect()
    held = base.lines(spark, D).join(base.decls(spark, D).filter("local = 0").select(F.col("file_id").alias("id")).distinct(), "id").select("path", "line").distinct()
    asked = {r["asked"] for r in rows}
    assert len(asked) == len(rows) and {f"{r['path']}:{r['line']}" for r in held.collect()} <= asked


def test_closures_have_no_depth(spark, monkeypatch):
    chain = spark.createDataFrame([(f"T{i:02}", f"T{i + 1:02}") for i in range(15)] + [("T15", "T14")], "a string, b string")
    monkeypatch.setattr(graph, "supertype_edges", lambda s, d: chain)
    up = {(r["start"], r["id"]): r["depth"] for r in graph.g4_supertypes(spark, "").collect()}
    down = {(r["id"], r["start"]): r["depth"] for r in graph.g5_subtypes(spark, "").collect()}
    assert up == down == {(f"T{i:02}", f"T{j:02}"): j - i for i in range(16) for j in range(i + 1, 16)} | {("T15", "T14"): 1}


@tables
def test_orders_are_whole(spark):
    rows = spark.range(1000).select(F.concat(F.lit("p"), (F.col("id") * 7 % 1000).cast("string")).alias("path"))
    out = windows.placed(rows.repartition(7), windows.path_key(F.col("path"))).collect()
    assert [r["path"] for r in sorted(out, key=lambda r: r["place"])] == sorted({f"p{i}" for i in range(1000)})
    assert sorted(r["place"] for r in out) == list(range(1, 1001))
    found = windows.o2_by_path_and_line(spark, D).collect()
    assert len(found) == base.decls(spark, D).join(base.files(spark, D).select(F.col("id").alias("file_id")), "file_id").count() > 300
    assert windows.o1_path_order(spark, "/root/testdata/sf0.01").count() > 200
