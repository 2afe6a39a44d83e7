"""Source files that do not parse: scanners for Kotlin and Java, and the first error of each file."""

from __future__ import annotations

import importlib.resources
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.glr import build, first_error

# Fixed values of the languages: reserved words, words with a meaning in places, and operators.
KOTLIN_HARD = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while".split())
KOTLIN_PLACED = frozenset("file import by get set constructor init where catch finally companion enum out suspend dynamic context".split())
KOTLIN_MODIFIERS = frozenset("public private internal protected open abstract final sealed data inner value annotation override lateinit const inline noinline crossinline vararg infix operator tailrec external expect actual reified".split())
JAVA_HARD = frozenset("assert break case catch class continue default do else enum extends false final finally for if implements import instanceof interface new null package return static super switch synchronized this throw throws true try void while".split())
JAVA_PRIMITIVES = frozenset("boolean byte char double float int long short".split())
JAVA_MODIFIERS = frozenset("public private protected abstract native strictfp transient volatile".split())
JAVA_PLACED = frozenset("record sealed permits yield when open module requires transitive exports opens to uses provides with".split())
JAVA_NEVER = frozenset("const goto _".split())

_DIGITS, _HEX = r"(?:\d(?:[\d_]*\d)?)", r"(?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)"
_NUMBER = rf"(?:0[xX]{_HEX}?(?:\.{_HEX}?)?(?:[pP][+-]?{_DIGITS})?|0[bB][01](?:[01_]*[01])?|{_DIGITS}(?:\.{_DIGITS})?(?:[eE][+-]?{_DIGITS})?|\.{_DIGITS}(?:[eE][+-]?{_DIGITS})?)"
# What the pattern lets through: a prefix without digits, and an octal number with the digit 8 or 9.
_NO_NUMBER = re.compile(r"0[xX][^0-9a-fA-F.]*$|0[xX]\.?$|0[\d_]*[89][\d_]*[lL]?$")
_KOTLIN = re.compile(
    r"(?P<skip>[ \t\f\ufeff]+|//[^\r\n]*)|(?P<nl>\r\n?|\n)|(?P<comment>/\*)|(?P<raw>\"\"\")|(?P<quote>\")"
    r"|(?P<char>'(?:\\u[0-9a-fA-F]{4}|\\.|[^'\\\r\n])')"
    rf"|(?P<number>{_NUMBER}(?:[fF]|[uU]?L?)(?![\w]))"
    r"|(?P<at>(?:return|break|continue|this|super)@[^\W\d]\w*)|(?P<label>[^\W\d]\w*@(?!\w))|(?P<word>[^\W\d]\w*|`[^`\r\n]+`)"
    r"|(?P<op>\.\.\.|\.\.<|===|!==|\.\.|\?\.|\?:|::|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|!!|as\?|!is\b|!in\b|[-+*/%=<>!?.,;:@&(){}\[\]])"
)
_JAVA = re.compile(
    r"(?P<skip>[ \t\f\r\n\ufeff]+|//[^\r\n]*|/\*.*?\*/)|(?P<text>\"\"\"[ \t\f]*(?:\r\n?|\n)(?:\\.|(?!\"\"\").)*\"\"\")|(?P<string>\"(?!\"\")(?:\\(?:u+[0-9a-fA-F]{4}|[^\r\n])|[^\"\\\r\n])*\")|(?P<empty>\"\"(?!\"))"
    rf"|(?P<char>'(?:\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\[^\r\n]|[^'\\\r\n])')|(?P<number>{_NUMBER}\.?[fFdDlL]?(?![\w]))"
    r"|(?P<word>[^\W\d]\w*|\$[\w$]*|[^\W\d][\w$]*)"
    r"|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%=<>!?.,;:@&|^~(){}\[\]])",
    re.S,
)
_OWN = {"+", "-", "*", "<", ">", "&&", "="}  # operators that the Kotlin grammar names
_KOTLIN_BINARY = frozenset("/ % == != === !== <= >= || ?: .. ..<".split())
_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<=".split())
_JAVA_BINARY = frozenset("/ % == != <= && || ^ <<".split())
_GOES_ON_AFTER = frozenset(" =| +| -| *| <| &&| .| ?.| ::| ->| (| [| ,| :| !| @| in| !in| is| !is| as| as?|BINOP|ASSIGN| &".split("|"))
_GOES_ON_BEFORE = frozenset(" .| ?.| ::| )| ]| ,| {| =| :| ->| else| as| as?| where| by| &&|ASSIGN| &".split("|"))
_CONTINUES = frozenset("|| ?:".split())


class Unreadable(Exception):
    """No token begins at the position given."""


def scan_kotlin(text: str) -> tuple[list[str], list[int]]:
    """Kinds and positions of the tokens. Line ends count only between braces and where a statement may end."""
    kinds: list[str] = []
    places: list[int] = []
    inside = ["{"]  # what encloses the place: { ( [ or, in a string's template, $
    pending = -1  # a line end not yet told
    n, pos = len(text), re.match(r"\ufeff?(?:#![^\r\n]*)?", text).end()

    def put(kind: str, at: int, goes_on: bool = False) -> None:
        nonlocal pending
        if pending >= 0 and not goes_on and kind not in _GOES_ON_BEFORE and not (kinds and kinds[-1] in _GOES_ON_AFTER):
            if not (kind in (" catch", " finally") and kinds and kinds[-1] == " }"):
                kinds.append("NL")
                places.append(pending)
        pending = -1
        kinds.append(kind)
        places.append(at)

    def string(pos: int, raw: bool) -> int:
        """Goes on inside a string, to its end or to the code of a template."""
        stop = re.compile(r'"""+|\$\{' if raw else r'"|\\(?:u[0-9a-fA-F]{4}|[tbnr\'"\\$])|\$\{|[\\\r\n]')
        while True:
            m = stop.search(text, pos)
            if not m:
                raise Unreadable(n)
            if m[0] == "${":
                put(" ${", m.start())
                inside.append('$"""' if raw else '$"')
                return m.end()
            if m[0][0] == '"':
                put("UNQUOTE", m.start())
                return m.end()
            if len(m[0]) == 1:
                raise Unreadable(m.start())
            pos = m.end()

    while pos < n:
        m = _KOTLIN.match(text, pos)
        if not m:
            raise Unreadable(pos)
        kind, tok, at, pos = m.lastgroup, m[0], pos, m.end()
        if kind == "skip":
            continue
        if kind == "nl":
            if inside[-1] in "{$" or inside[-1][0] == "$":
                pending = at
            continue
        if kind == "comment":
            depth = 1
            while depth:
                c = re.compile(r"/\*|\*/").search(text, pos)
                if not c:
                    raise Unreadable(n)
                depth += 1 if c[0] == "/*" else -1
                pos = c.end()
        elif kind in ("raw", "quote"):
            put("QUOTE", at)
            pos = string(pos, kind == "raw")
        elif kind == "char":
            put("CHAR", at)
        elif kind == "number":
            if _NO_NUMBER.match(tok) or tok[0] == "0" and len(tok) > 1 and tok.isdigit():
                raise Unreadable(at)
            put("NUMBER", at)
        elif kind == "at":
            put(" " + tok.split("@")[0], at)
        elif kind == "label":
            put("LABEL", at)
        elif kind == "word":
            if tok == "as" and text.startswith("?", pos) and not text.startswith(("?.", "?:"), pos):
                pos += 1
                put(" as?", at)
            elif tok in KOTLIN_HARD or tok in KOTLIN_PLACED:
                put(" " + tok, at)
            else:
                put("MOD" if tok in KOTLIN_MODIFIERS else "IDENT", at)
        else:
            if tok in "({[":
                put(" " + tok, at)
                inside.append(tok)
                continue
            if tok in ")}]":
                if tok == "}" and inside[-1][0] == "$":
                    put(" }$", at)
                    pos = string(pos, inside.pop() == '$"""')
                    continue
                if len(inside) > 1 and inside[-1] == {")": "(", "}": "{", "]": "["}[tok]:
                    inside.pop()
                put(" " + tok, at)
                continue
            if tok in ("!is", "!in"):
                put(" " + tok, at)
            elif tok == "*" and kinds and kinds[-1] == " .":
                put("STAR", at)  # of an import, after which a line may end
            elif tok in ("++", "--"):
                put("INCR", at)
            elif tok in _KOTLIN_BINARY:
                put("BINOP", at, tok in _CONTINUES)
            elif tok in _ASSIGN:
                put("ASSIGN", at)
            else:
                put(" " + tok, at)
    kinds.append("NL")
    places.append(n)
    return kinds, places


def scan_java(text: str) -> tuple[list[str], list[int]]:
    """Kinds and positions of the tokens."""
    kinds, places, pos, n = [], [], 0, len(text)
    if text.endswith("\x1a"):
        n -= 1
    while pos < n:
        m = _JAVA.match(text, pos)
        if not m:
            raise Unreadable(pos)
        kind, tok = m.lastgroup, m[0]
        if kind != "skip":
            if kind == "word":
                if tok in JAVA_HARD or tok in JAVA_PLACED:
                    kind = " " + tok
                elif tok in JAVA_NEVER:
                    raise Unreadable(pos)
                else:
                    kind = "PRIM" if tok in JAVA_PRIMITIVES else "MOD" if tok in JAVA_MODIFIERS else "IDENT"
            elif kind == "op":
                kind = "INCR" if tok in ("++", "--") else "ASSIGN" if tok in _ASSIGN else "BINOP" if tok in _JAVA_BINARY else " " + tok
            else:
                if kind == "number" and _NO_NUMBER.match(tok):
                    raise Unreadable(pos)
                kind = {"text": "STRING", "string": "STRING", "empty": "STRING", "char": "CHAR", "number": "NUMBER"}[kind]
            kinds.append(kind)
            places.append(pos)
        pos = m.end()
    return kinds, places


def grammar(language: str) -> str:
    return importlib.resources.files("tessera.llm").joinpath("grammars", f"{language}.txt").read_text()


@lru_cache
def tables() -> dict[str, tuple]:
    """The parse tables by extension: of fixed size, whatever the data."""
    kotlin = grammar("kotlin")
    return {"kt": build(kotlin, "file"), "kts": build(kotlin, "script"), "java": build(grammar("java"), "file")}


def syntax_error(text: str, extension: str, known: dict[str, tuple] | None = None) -> tuple[int, int, str] | None:
    """(line, column, token) of the first place where a source text cannot go on, or None if it is valid."""
    scan = scan_java if extension == "java" else scan_kotlin
    try:
        kinds, places = scan(text)
        n = first_error((known or tables())[extension], kinds)
        if n < 0:
            return None
        at = places[n] if n < len(places) else len(text)
    except Unreadable as e:
        at = e.args[0]
    lines = re.split(r"\r\n?|\n", text[:at])
    found = re.match(r"\w+|[^\w\r\n]|\Z", text[at : at + 40])
    return len(lines), len(lines[-1]) + 1, (found[0] or "end of file") if found else "end of line"


def extension_of(path: Column) -> Column:
    return F.regexp_extract(path, r"\.(kts?|java)$", 1)


def parsed(files: DataFrame) -> DataFrame:
    """(id, repository, extension, valid, line, col, token) of each file with content, once per id.

    The language is the one the path's extension stands for; files of other extensions, and those with null content or path, are
    left out. An empty file or one with only comments is valid. Long files are parsed whole. Contents are not shuffled: each row
    is parsed where it is read, and repeated rows are dropped afterwards. Of rows of one id that differ, an invalid one stands,
    and of several invalid ones that with the latest first error.
    """
    sc = files.sparkSession.sparkContext
    shared = sc.broadcast(tables())

    @F.pandas_udf("struct<line:int,col:int,token:string>")
    def check(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        known = shared.value
        rows = [syntax_error(c, e, known) or (None, None, None) for c, e in zip(content, ext)]
        return pd.DataFrame(rows, columns=["line", "col", "token"]).astype({"line": "Int32", "col": "Int32"})

    ext = extension_of(F.col("path"))
    rows = files.filter(F.col("content").isNotNull() & (ext != "")).select("id", F.split_part("path", F.lit("/"), F.lit(1)).alias("repository"), ext.alias("extension"), check("content", ext).alias("e"))
    one = rows.groupBy("id").agg(F.max(F.struct(F.coalesce("e.line", F.lit(0)).alias("line"), "e.col", "e.token", "repository", "extension")).alias("r"))
    line = F.nullif("r.line", F.lit(0))
    return one.select("id", "r.repository", "r.extension", line.isNull().alias("valid"), line.alias("line"), "r.col", "r.token")


def rates(parsed_files: DataFrame) -> DataFrame:
    """(repository, language, files, invalid, rate) per repository and language."""
    language = F.when(F.col("extension") == "java", "java").otherwise("kotlin")
    bad = F.sum((~F.col("valid")).cast("bigint"))
    return parsed_files.groupBy("repository", language.alias("language")).agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate"))
