"""Predicates built from what users write."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = re.compile(r"(?P<field>\{[^}]+\}|[A-Za-z]+):\s*(?P<values>(?:-?(?:\"[^\"]*\"|\{[^}]*\}|[^\s,]+))(?:\s*,\s*-?(?:\"[^\"]*\"|\{[^}]*\}|[^\s,]+))*)|#(?P<flag>-?\w+)|(?P<word>\S+)")


def task_filter(text: str, fields: dict[str, Column], flags: dict[str, Column], search: Column) -> tuple[Column, list[Column]]:
    """The predicate and the order of a task query such as `state: Open, -Done #unresolved sort: updated`.

    Values of a field are joined by OR, excluded ones (with a minus) by AND NOT, where null counts as not excluded. `#flag` names a
    condition; `sort: field` orders, descending with a minus; other words must occur in `search`. Letters' case is no matter.
    Unknown fields raise ValueError.
    """
    where, order = F.lit(True), []
    for m in _TERM.finditer(text):
        if m["flag"]:
            name = m["flag"].lstrip("-").lower()
            where = where & (~F.coalesce(flags[name], F.lit(False)) if m["flag"].startswith("-") else flags[name])
        elif m["word"]:
            where = where & F.lower(search).contains(m["word"].lower())
        else:
            name = m["field"].strip("{}").lower()
            values = [v.strip() for v in m["values"].split(",")]
            if name == "sort":
                order += [F.desc_nulls_last(fields[v[1:].lower()]) if v.startswith("-") else F.asc_nulls_last(fields[v.lower()]) for v in values]
                continue
            if name not in fields:
                raise ValueError(f"unknown field {name}")
            bare = lambda v: v.lstrip("-").strip('"{}').lower()
            column = F.lower(fields[name])
            wanted, shut = [bare(v) for v in values if not v.startswith("-")], [bare(v) for v in values if v.startswith("-")]
            if wanted:
                where = where & column.isin(wanted)
            if shut:
                where = where & ~F.coalesce(column.isin(shut), F.lit(False))
    return where, order


_COMPARE = {"==": "__eq__", "!=": "__ne__", ">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__"}


def condition(text: str, fields: dict[str, Column]) -> Column:
    """A condition such as `failed==0 && tests>0 || forced==1`; a comparison with a missing number is false. && binds tighter."""
    out = F.lit(False)
    for either in text.split("||"):
        part = F.lit(True)
        for c in either.split("&&"):
            m = re.fullmatch(r"\s*(\w+)\s*(==|!=|>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*", c)
            if not m or m[1] not in fields:
                raise ValueError(f"not a condition: {c}")
            part = part & F.coalesce(getattr(fields[m[1]], _COMPARE[m[2]])(float(m[3])), F.lit(False))
        out = out | part
    return out


def module_scope(module: Column, path: Column, scope: str) -> Column:
    """A module, one nested in it, or a path below it."""
    return (module == scope) | module.startswith(scope + "/") | path.startswith(scope + "/") | path.startswith(scope + ".")


def glob(column: Column, pattern: str) -> Column:
    """Case-sensitive match of * and ?."""
    return column.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def event_types(column: Column, patterns: list[str]) -> Column:
    """Equal to a pattern, or below one that ends in `*`."""
    out = F.lit(False)
    for p in patterns:
        out = out | (column.startswith(p[:-1]) if p.endswith("*") else column == p)
    return out


def first_rule(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The category of the first (pattern, category) that matches; null text is `other`."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, category in rules:
        out = out.when(text.rlike(pattern), category)
    return out.otherwise(other)


def base_type(name: Column) -> Column:
    """A type without its arguments and question mark: Map<String, Int>? is Map."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"<.*>", ""), r"\?$", ""))


def parameters_match(types: Column, wanted: list[str]) -> Column:
    """Whether a parameter list has the wanted types, arguments erased; `_` stands for any."""
    out = F.size(types) == len(wanted)
    for i, w in enumerate(wanted):
        if w != "_":
            out = out & (base_type(F.get(types, F.lit(i))) == w)
    return F.coalesce(out, F.lit(False))
