"""Outputs of tools by family, and the lines of each that say something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT_CHARS, SHORT_LINES = 600, 20
HEAD, TAIL = 10, 5
#: (family, what some line of such an output matches), the first that fits decides; the last family is that of all others.
FAMILIES = (
    ("git status", r"^(On branch |Your branch |Changes (not staged|to be committed)|Untracked files:)"),
    ("git diff", r"^diff --git "),
    ("git log", r"^commit [0-9a-f]{7,40}"),
    ("gradle", r"^(> Task :|BUILD (SUCCESSFUL|FAILED))"),
    ("test runner", r"^(=+ .*(passed|failed).* =+|Tests run: |test result: |(PASS|FAIL) )"),
)
#: (family, lines that are kept)
KEPT = (
    ("git status", r"^(On branch|Your branch|Changes|Untracked|[ \t]+(modified|new file|deleted|renamed|both modified):|\t)"),
    ("git diff", r"^(diff --git|@@|[+-])"),
    ("git log", r"^(commit |    )"),
    ("gradle", r"(FAILED|^BUILD |^e: |^w: |^\* What went wrong|^Execution failed|error:|warning:)"),
    ("test runner", r"(FAIL|failed|ERROR|Tests run|test result|^=+ .* =+$|^E  )"),
)
GENERIC = "ERROR|WARN|error|failed|Exception"


def family(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family) of each output by its lines; null texts are generic."""
    out = F.lit("generic")
    for name, pattern in reversed(FAMILIES):
        out = F.when(F.coalesce(F.col(text).rlike("(?m)" + pattern), F.lit(False)), name).otherwise(out)
    return outputs.select(key, out.alias("family"))


def compressed(lines: DataFrame, families: DataFrame, key: str) -> DataFrame:
    """(key, family, line, text): the lines (key, line, text) that are kept. Short outputs stay as they are; of the others stay the lines
    their family keeps, and of generic ones head, tail and what reports trouble. Lines are only left out, so nothing gets longer.

    The numbers of lines and characters are aggregated and joined back, so that a very long output is not one window.
    """
    size = lines.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.char_length("text") + 1).alias("chars"))
    rows = lines.join(size, key).join(families, key)
    generic = (F.col("line") <= HEAD) | (F.col("line") > F.col("n") - TAIL) | F.col("text").rlike(GENERIC)
    keep = generic
    for name, pattern in KEPT:
        keep = F.when(F.col("family") == name, F.col("text").rlike(pattern)).otherwise(keep)
    return rows.filter(((F.col("chars") <= SHORT_CHARS) & (F.col("n") < SHORT_LINES)) | keep).select(key, "family", "line", "text")


def family_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?m){p}') THEN '{n}'" for n, p in FAMILIES) + " ELSE 'generic' END"


def kept_sql() -> str:
    kept = " ".join(f"WHEN family = '{n}' THEN regexp_matches(text, '{p}')" for n, p in KEPT)
    return f"(chars <= {SHORT_CHARS} AND n < {SHORT_LINES}) OR CASE {kept} ELSE line <= {HEAD} OR line > n - {TAIL} OR regexp_matches(text, '{GENERIC}') END"


def first_of(lines: DataFrame, key: str, match: str, k: int) -> DataFrame:
    """The first `k` lines of each output that match a pattern."""
    r = F.row_number().over(W.partitionBy(key).orderBy("line"))
    return lines.filter(F.col("text").rlike(match)).withColumn("r", r).filter(F.col("r") <= k).drop("r")
