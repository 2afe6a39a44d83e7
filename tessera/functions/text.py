"""Text helpers: commands, secrets, dates in words, compressed outputs."""

from __future__ import annotations

import re
import shlex
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own rules for what must not be shown, in order.
SECRETS = (
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 ***"),
    (r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;\"']+", "$1$2***"),
    (r"\b[a-z]+://([^\s:/@]+):[^\s@/]+@", "***:***@"),
    (r"\b[A-Fa-f0-9]{40,64}\b", "***"),
)


def masked(text: Column, known: list[str] = ()) -> Column:
    """Secrets replaced by ***: known values first, the longest before the rest, then what the rules find."""
    for value in sorted(known, key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit("***"))
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


_SETTING = re.compile(r"^(?:(?:cd|export)\s+\S+\s*(?:&&|;)\s*|[A-Z_]+=\S+\s*(?:&&|;)?\s*)")


def command_key(text: str) -> str:
    """A shell command's group: program, subcommand and its sorted flags, four at most; values become placeholders.

    Commands that only set the scene are dropped; a here-document goes by its program; what can't be read goes by its first word.
    """
    text = text.strip()
    while m := _SETTING.match(text):
        text = text[m.end() :]
    if "<<" in text:
        return "heredoc " + text.split()[0]
    text = re.split(r"\s*(?:\||&&|;)\s*", text)[0]
    try:
        parts = shlex.split(text)
    except ValueError:
        parts = text.split()
    if not parts:
        return ""
    program = parts[0].rsplit("/", 1)[-1]
    flags = sorted({p.split("=")[0] for p in parts[1:] if p.startswith("-")})[:4]
    words = [p for p in parts[1:] if not p.startswith("-")]
    sub = words[:1] if words and re.fullmatch(r"[a-z][a-z-]*", words[0]) else []
    rest = ["<path>"] if any("/" in w or "." in w for w in words[len(sub) :]) else ["<arg>"] if words[len(sub) :] else []
    return " ".join([program, *sub, *flags, *rest])


def command_keys(text: Column) -> Column:
    @F.pandas_udf("string")
    def keys(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else command_key(v))

    return keys(text)


def since(text: str, now: datetime) -> datetime:
    """`10d`, `24h`, `30m`, a day or an instant, as an instant in UTC."""
    if m := re.fullmatch(r"(\d+)([dhm])", text.strip()):
        return now - timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def next_reset(text: Column, at_ms: Column) -> Column:
    """`resets 8pm (Europe/Prague)` at an instant: the next such hour in that zone, in epoch milliseconds; null if it says none."""
    hour = F.regexp_extract(text, r"resets (\d{1,2})(?::\d{2})? ?(am|pm)", 1)
    half = F.regexp_extract(text, r"resets (\d{1,2})(?::\d{2})? ?(am|pm)", 2)
    zone = F.regexp_extract(text, r"\(([A-Za-z]+/[A-Za-z_]+)\)", 1)
    safe = F.when(zone != "", zone).otherwise("UTC")
    h = F.try_to_number(hour, F.lit("99")).cast("int") % 12 + F.when(half == "pm", 12).otherwise(0)
    local = F.from_utc_timestamp(F.timestamp_millis(at_ms), safe)
    today = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), h)
    due = F.when(today > local, today).otherwise(today + F.make_dt_interval(F.lit(1)))
    return F.when(hour != "", F.unix_millis(F.to_utc_timestamp(due, safe)))


def local_day(at_ms: Column, zone: str) -> Column:
    """The calendar day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(at_ms), zone))


def last_hump(name: Column) -> Column:
    """The last word of a CamelCase name."""
    return F.element_at(F.regexp_extract_all(name, F.lit("[A-Z][a-z0-9]*"), 0), -1)


def source_set(path: Column) -> Column:
    """The folder after `src` in a path, or null."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src")
    return F.when(at > 0, F.get(parts, at.cast("int")))


def common_lines(a: list[str], z: list[str]) -> int:
    """The length of a longest common subsequence: what both begin and end with is cut off, the rest goes by bits of one long number
    per line, so the work is the product of the lengths over the bits of a machine word."""
    i, n = 0, min(len(a), len(z))
    while i < n and a[i] == z[i]:
        i += 1
    k = 0
    while k < n - i and a[-1 - k] == z[-1 - k]:
        k += 1
    a, z = a[i : len(a) - k], z[i : len(z) - k]
    places: dict[str, int] = {}
    for bit, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << bit
    full = (1 << len(a)) - 1
    open_ = full
    for line in z:
        hit = open_ & places.get(line, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return i + k + len(a) - open_.bit_count()


def line_diff(old: Column, new: Column) -> Column:
    """struct(added, removed): the lines that two texts don't share, in order; null is an empty text of one empty line."""

    @F.pandas_udf("struct<added:int,removed:int>")
    def diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = []
        for o, n in zip(old.fillna(""), new.fillna("")):
            a, z = o.split("\n"), n.split("\n")
            same = common_lines(a, z)
            out.append((len(z) - same, len(a) - same))
        return pd.DataFrame(out, columns=["added", "removed"])

    return diff(old, new)
