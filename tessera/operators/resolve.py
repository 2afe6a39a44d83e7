"""What names in source files mean: scopes, members through supertypes, overrides, arguments, distinctive names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import reach

OWN, IMPORTED, PACKAGE, STAR, ANYWHERE = range(5)


def scoped(refs: DataFrame, types: DataFrame, imports: DataFrame, stars: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_id, name, target, level) of the declarations that a scope of the file gives a name, by the nearest scope that has any.

    Scopes are the file itself (0), an import or its alias (1), the file's package (2) and packages imported whole (3). `refs` are
    (file_id, name), `types` (target, name, fqn, package, home), `imports` (file_id, name, fqn), `stars` (file_id, package) and
    `packages` (file_id, package). Null names and packages meet nothing; repeated rows count once.
    """
    refs = refs.select("file_id", "name").distinct()
    at = lambda df, level: df.select("file_id", "name", "target", F.lit(level).alias("level"))
    found = [
        at(refs.join(types.select("name", "target", F.col("home").alias("file_id")), ["file_id", "name"]), OWN),
        at(refs.join(imports.select("file_id", "name", "fqn").distinct(), ["file_id", "name"]).join(types.select("fqn", "target"), "fqn"), IMPORTED),
        at(refs.join(packages, "file_id").join(types.select("package", "name", "target"), ["package", "name"]), PACKAGE),
        at(refs.join(stars.distinct(), "file_id").join(types.select("package", "name", "target"), ["package", "name"]), STAR),
    ]
    return nearest(reduce(DataFrame.unionByName, found), ["file_id", "name"])


def nearest(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the distinct candidates of its lowest level."""
    first = candidates.groupBy(*keys).agg(F.min("level").alias("level"))
    return candidates.join(first, [*keys, "level"]).distinct()


def anywhere(types: DataFrame) -> DataFrame:
    """(name, target, n): of each name its least declaration and how many there are; one row per name, so that common names make no pairs."""
    return types.groupBy("name").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"))


def labelled(refs: DataFrame, near: DataFrame, types: DataFrame) -> DataFrame:
    """(file_id, name, target, label): EXACT for the only declaration a scope gives, CANDIDATE for the least of several, OTHER for the
    least of that name outside all scopes. Names that nothing declares are left out."""
    mine = near.groupBy("file_id", "name").agg(F.min("target").alias("near"), F.count_distinct("target").alias("k"))
    rows = refs.select("file_id", "name").distinct().join(mine, ["file_id", "name"], "left").join(anywhere(types).select("name", "target"), "name", "left")
    label = F.when(F.col("k") == 1, "EXACT").when(F.col("k") > 1, "CANDIDATE").otherwise("OTHER")
    return rows.select("file_id", "name", F.coalesce("near", "target").alias("target"), label.alias("label")).filter("target IS NOT NULL")


def levels(supers: DataFrame, types: DataFrame) -> DataFrame:
    """(type, above, level): each type (id) itself at level 0 and all its supertypes over (a, b), nearest first; circles end by themselves."""
    return reach(types.select("id"), supers).select(F.col("start").alias("type"), F.col("id").alias("above"), F.col("depth").cast("bigint").alias("level"))


def member_lookup(uses: DataFrame, members: DataFrame, above: DataFrame) -> DataFrame:
    """(use, member, level, nearest): what a member name used on a type means, in the type and its supertypes.

    `uses` are (use, type, name), `members` (member, type, name), `above` as of `levels`. All levels are kept; `nearest` marks the
    lowest one of each use, which wins.
    """
    hit = uses.join(above, "type").join(members.select("member", F.col("type").alias("above"), "name"), ["above", "name"]).select("use", "member", "level").distinct()
    first = hit.groupBy("use").agg(F.min("level").alias("least"))
    return hit.join(first, "use").select("use", "member", "level", (F.col("level") == F.col("least")).alias("nearest"))


def overrides(members: DataFrame, above: DataFrame) -> DataFrame:
    """(member, overridden, level): members (member, type, name, kind, arity) and those of the same name, kind and arity in supertypes."""
    o = members.select(F.col("member").alias("overridden"), F.col("type").alias("above"), "name", "kind", "arity")
    m = members.join(above.filter("level > 0"), "type")
    return m.join(o, ["above", "name", "kind", "arity"]).filter("member <> overridden").select("member", "overridden", "level").distinct()


def accepts(params: Column, total: Column, args: Column) -> Column:
    """Whether a declaration with these parameters (JSON) can be called with so many arguments: defaults may be left out, a vararg takes any number."""
    ps = F.from_json(params, "array<map<string,string>>")
    yes = lambda x, key: F.coalesce(x[key], F.lit("false")).isin("true", "1")
    required = F.size(F.filter(ps, lambda x: ~yes(x, "default") & ~yes(x, "vararg")))
    many = F.coalesce(F.exists(ps, lambda x: yes(x, "vararg")), F.lit(False))
    return (F.coalesce(required, F.lit(0)) <= args) & (many | (args <= total))


def promoted(rows: DataFrame, types: DataFrame, outside: DataFrame) -> DataFrame:
    """(file_id, name, target): of `rows` (file_id, name) outside every scope those that must mean the only declaration of the name.

    `outside` (name) are names that some file surely takes from elsewhere, by an import of something that is not declared here.
    """
    one = anywhere(types).filter("n = 1").join(outside.select("name").distinct(), "name", "left_anti")
    return rows.select("file_id", "name").join(one, "name").select("file_id", "name", "target")
