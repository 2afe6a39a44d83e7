"""Index words: what a text is cut into, which words are left out, and the stem by which forms of a word meet.

Words are cut, filtered and stemmed on whole strings by regular expressions, so a long text costs a few passes of compiled code and
no interpreted step per word but the stop-word test. The patterns are those that both Java and RE2 read, and one list of rules makes
the Spark expression and the SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of Apache Lucene's English analyzer.
ENGLISH = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# The reserved words and primitive types of Java (Java Language Specification, 3.9).
JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
).split()
# The hard keywords and modifiers of Kotlin (Kotlin language reference, "Keywords and operators").
KOTLIN_WORDS = (
    "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while "
    "abstract actual annotation companion const crossinline data enum expect external final infix inline inner internal lateinit noinline open operator out override private protected public reified sealed suspend tailrec value vararg"
).split()
DECLARING = sorted({*JAVA_WORDS, *KOTLIN_WORDS})

_WORD = r"\p{Lu}*[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{M}]+|\p{Lu}+|\p{N}+"
_V, _C = "[aeiouy]", "[^aeiouy ]"
#: (pattern, replacement), in order, on words that each have a blank on either side. The first and last steps of Porter's stemmer
#: (1980) with y always a vowel: plurals, -ed and -ing with what they leave behind (marked ~), final y, final e. Words in -eed stay.
RULES = (
    ("(ss|i)es ", "$1 "),
    ("([^ ][^s ])s ", "$1 "),
    (f"({_V}[^ ]*[^e ]|[aiouy])ed ", "$1~ "),
    (f"({_V}[^ ]*)ing ", "$1~ "),
    ("(at|bl|iz)~ ", "$1e "),
    ("(?:(b)b|(d)d|(f)f|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)~ ", "$1$2$3$4$5$6$7$8$9 "),
    (f"( {_C}+{_V}[^aeiouwxy ])~ ", "$1e "),
    ("~", ""),
    ("([aeiou][^ ]*)y ", "$1i "),
    (f"({_V}+{_C}+{_V}+{_C}+)e ", "$1 "),
    (f" ({_V}+{_C}+|{_C}*{_V}{_V}+{_C}+|{_C}*{_V}+{_C}{_C}+|{_C}*{_V}+[wx])e ", " $1 "),
)


def pieces(text: Column) -> Column:
    """The lower-case words of a text: runs of letters, cut before a capital that begins a word, or of digits; null for null."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(\p{Lu}\p{Ll})", " $1"), F.lit(_WORD), F.lit(0)), F.lower)


def stems(text: Column, drop: Sequence[str] = ENGLISH) -> Column:
    """The stems of all words of two characters or more but the dropped ones, in order, repeats kept; empty for null.

    Forms of a word have one stem: limit, limits, limited and limiting; cache and caching; entry and entries.
    """
    words = F.regexp_extract_all(F.regexp_replace(text, r"(\p{Lu}\p{Ll})", " $1"), F.lit(_WORD), F.lit(0))
    kept = F.filter(words, lambda w: (F.char_length(w) >= 2) & ~F.lower(w).isin(list(drop)))
    line = F.concat(F.lit(" "), F.lower(F.array_join(kept, "  ")), F.lit(" "))
    for pattern, to in RULES:
        line = F.regexp_replace(line, pattern, to)
    return F.coalesce(F.filter(F.split(line, " +"), lambda w: w != ""), F.array().cast("array<string>"))


def stem(word: Column) -> Column:
    """The stem of one lower-case word."""
    line = F.concat(F.lit(" "), word, F.lit(" "))
    for pattern, to in RULES:
        line = F.regexp_replace(line, pattern, to)
    return F.trim(line)


def _rules_sql(line: str) -> str:
    for pattern, to in RULES:
        line = f"regexp_replace({line}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return line


def pieces_sql(text: str) -> str:
    """`pieces` in DuckDB."""
    return f"list_transform(regexp_extract_all(regexp_replace({text}, '(\\p{{Lu}}\\p{{Ll}})', ' \\1', 'g'), '{_WORD}'), lambda w: lower(w))"


def stems_sql(text: str, drop: Sequence[str] = ENGLISH) -> str:
    """`stems` in DuckDB."""
    kept = f"list_filter(regexp_extract_all(regexp_replace({text}, '(\\p{{Lu}}\\p{{Ll}})', ' \\1', 'g'), '{_WORD}'), lambda w: length(w) >= 2 AND NOT list_contains({list(drop)}, lower(w)))"
    line = _rules_sql(f"(' ' || lower(array_to_string({kept}, '  ')) || ' ')")
    return f"coalesce(list_filter(string_split_regex({line}, ' +'), lambda w: w <> ''), [])"


def stem_sql(word: str) -> str:
    """`stem` in DuckDB."""
    return "trim(" + _rules_sql(f"(' ' || {word} || ' ')") + ")"
