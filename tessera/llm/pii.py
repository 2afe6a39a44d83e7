"""Personal information in free text: a semi-Markov conditional random field over bounded windows of tokens.

Candidate segments are windows of whole tokens, of bounded length for each kind, that could be of the kind by their tokens' types
alone; no list of words proposes or forbids any. The windows' features are their shapes, the words in and beside them, and whether
the names are known; what they mean is learnt (`pii_train`).
"""

from __future__ import annotations

import importlib.resources
import json
import math
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Most names that are sent to all executors; more are joined to the words of the texts instead.
BROADCAST_NAMES = 200_000
#: Most tokens of a window, by kind.
WINDOW = {"name": 12, "address": 22, "id_number": 9}

_AT = r"(?:[ ]?[\[({<]\p{L}+[\])}>][ ]?|[ ](?i:at)[ ])"
_DOT = r"(?:\.|[ ]?[\[({<](?:dot|DOT|tečka|punkt|point|punto)[\])}>][ ]?|[ ](?:dot|DOT)[ ])"
_EMAILS = (
    ("plain", regex.compile(r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}_](?:[\p{L}\p{M}\p{N}_.+%'-]*[\p{L}\p{N}_+])?@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)+(?![\p{L}\p{N}_])")),
    ("spelt", regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+%-])[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.+%-]*{_AT}[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)+(?![\p{{L}}\p{{N}}_])")),
)
_DIGITS = regex.compile(r"(?<![\p{L}\p{N}_])(?<![\p{L}\p{N}][.,/:-])(?:\+|00)?[(]?\d+(?:(?:[ . /-]|[)][ ]?|[ ]?[(])\d+)*+(?![\p{L}_])")
_GROUP = regex.compile(r"\d+")
# The formats of postal codes (of five digits, with a gap or hyphen, British, Dutch, of four digits).
_ZIP = regex.compile(r"(?<![\p{L}\p{N}_])(?:(?:[A-Z]{1,2}-)?(?:\d{5}(?:-\d{4})?|\d{3} \d{2}|\d{2}-\d{3}|\d{4}(?: [A-Z]{2})?)|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})(?![\p{L}\p{N}_/])")
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[-’'](?=\p{L})\p{L}[\p{L}\p{M}]*)*|\p{N}+|\n|[^\s]")
_CASELESS = regex.compile(r"[\p{Lo}\p{M}]+")
_LATIN, _LETTERS = regex.compile(r"\p{Latin}"), regex.compile(r"\p{L}{2,}")
_REMOTE, _REMOTE_PATH = regex.compile(r"(?i)git@"), regex.compile(r":[\p{L}\p{N}_~/]")
_AT_WORD, _SPELT_DOT = regex.compile(r"[\[({<](\p{L}+)[\])}>]"), regex.compile(r"(?i) dot ")
_NAME_LEFT, _NAME_RIGHT, _ID_LEFT = regex.compile(r"[\p{L}\p{N}_@./\\#-]"), regex.compile(r"[\p{L}\p{N}_@(/\\]"), regex.compile(r"[\p{L}\p{N}_+(@-]")
_DIGIT, _DOTS = regex.compile(r"\d"), regex.compile(_DOT)
CACHED = 100_000  # words whose type and folded form a worker remembers, to save work only
_SHORT = 5  # letters of a word that a full stop may shorten


@lru_cache(CACHED)
def fold(word: str) -> str:
    """Lower case without marks, so that Søren, SØREN and Soren are one."""
    w = unicodedata.normalize("NFD", word.lower().replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ß", "ss"))
    return "".join(c for c in w if not unicodedata.combining(c))


@dataclass(frozen=True)
class Names:
    """Known given and family names, folded."""

    given: frozenset
    family: frozenset


@dataclass
class Segment:
    start: int
    end: int
    kind: str
    features: list[str]


@lru_cache(CACHED)
def _type(t: str) -> str:
    """A token's type: C capitalised, I a capital alone, U capitals, K letters without case, l small, M mixed, N digits, or the character."""
    c = t[0]
    if not c.isalpha():
        return "N" if c.isnumeric() else t
    if _CASELESS.fullmatch(t):
        return "K"
    if len(t) == 1:
        return "I" if c.isupper() else "l"
    rest = t[1:]
    if c.isupper() and rest.islower():
        return "C"
    if t.isupper():
        return "U"
    if t.islower():
        return "l"
    parts = regex.split(r"[-’']", t)
    return "C" if all(p[:1].isupper() and (p[1:].islower() or not p[1:]) for p in parts) else "M"


class Tokens:
    """A text's tokens: places, types, and whether white space stands before each."""

    def __init__(self, text: str):
        self.text = text
        found = list(_TOKEN.finditer(text))
        self.at = [m.start() for m in found]
        self.to = [m.end() for m in found]
        self.words = [m[0] for m in found]
        self.types = [_type(w) for w in self.words]
        self.apart = [i == 0 or self.at[i] > self.to[i - 1] for i in range(len(found))]
        self.folded = [fold(w) if k in ("C", "I", "U", "K", "l", "M") else "" for w, k in zip(self.words, self.types)]

    def before(self, i: int, n: int = 1, reach: int = 6) -> list[str]:
        """The nearest words before token i, folded, the nearest first."""
        out = []
        for k in range(i - 1, max(-1, i - 1 - reach), -1):
            if self.folded[k]:
                out.append(self.folded[k])
                if len(out) == n:
                    break
        return out

    def sentence_start(self, i: int) -> bool:
        return i == 0 or self.words[i - 1] in ".!?\n" and len(self.words[i - 1]) == 1


def _script(word: str) -> str:
    return "Latin" if _LATIN.match(word) else "other"


def _names(t: Tokens, known: Names) -> Iterator[Segment]:
    """Windows of two to four words, at most one comma, with initials and small words between; or a run of letters without case."""
    text, n = t.text, len(t.words)
    for i in range(n):
        if t.types[i] not in "CIUK" or (t.at[i] and _NAME_LEFT.match(text, t.at[i] - 1)):
            continue
        form, names, j = "", [], i
        while j < n and j - i < WINDOW["name"]:
            kind, word = t.types[j], t.words[j]
            if j > i and not (t.apart[j] and text[t.to[j - 1] : t.at[j]] in (" ", "\u00a0")) and word not in ".," and not (form.endswith("I.") and kind in "CIU"):
                break
            if word == ".":
                if form[-1:] != "I" or t.apart[j]:
                    break
                form += "."
            elif word == ",":
                if "," in form or t.apart[j] or form[-1:] not in "CU":
                    break
                form += ","
            elif kind in "CUK" or kind == "I":
                form += " " * (form[-1:] not in ("", ".")) + kind
                if kind != "I":
                    names.append(j)
            elif kind == "l" and len(word) <= 4 and "," not in form and form[-1:] in "CUl":
                form += " l"
            else:
                break
            j += 1
            if len(names) > 4:
                break
            whole = form[-1:] in "CUK" or form.endswith("I.") and "," in form
            if not whole or (len(names) + form.count("I") < 2 and form != "K") or (j < n and t.at[j] == t.to[j - 1] and _NAME_RIGHT.match(text, t.at[j])):
                continue
            yield _name(t, known, i, j, form, names)


def _name(t: Tokens, known: Names, i: int, j: int, form: str, names: list[int]) -> Segment:
    turned = "," in form
    g, f = (names[-1] if not form.endswith("I.") else -1, names[0]) if turned else (names[0] if form[0] != "I" else -1, names[-1])
    word = lambda k: t.folded[k]
    has_g, has_f = g >= 0 and word(g) in known.given, word(f) in known.family
    gaz = ("initial" if g < 0 else "given" if has_g else "no given") + (" family" if has_f else "")
    if g >= 0 and not has_g and word(g) in known.family:
        gaz += " turned"
    if turned and has_g and word(f) in known.given:
        gaz += " double"
    shape = form.replace("U", "C")
    feats = [f"name {shape}", f"name {shape} {gaz}", f"name {gaz}", f"name script {_script(t.words[f])} {shape}"]
    feats += [f"name in={word(k)}" for k in names] + [f"name small={t.folded[k]}" for k in range(i, j) if t.types[k] == "l"]
    before = t.before(i, 1, 3)
    feats.append(f"name before={before[0] if before else ''}")
    prev = t.words[i - 1] if i else ""
    if prev and not prev[0].isalnum():
        feats.append(f"name behind {prev}")
    if t.sentence_start(i):
        feats += ["name begins a sentence", f"name begins a sentence {shape} {gaz}"]
    if before and not t.sentence_start(i) and t.types[i - 1] == "l":
        feats.append(f"name inside {gaz}")
    if i and t.types[i - 1] in "CU" and t.apart[i]:
        feats.append("name capital before" + (" known" if t.folded[i - 1] in known.given else ""))
    if j < len(t.words) and t.types[j] in "CU" and t.apart[j]:
        feats.append("name capital after")
    if j < len(t.words) and not t.words[j][0].isalnum():
        feats.append(f"name ahead of {t.words[j]}")
    if j + 1 < len(t.words) and t.words[j] in "-:" and t.types[j + 1] == "N" and not t.apart[j]:
        feats.append("name number follows")
    cases = {t.types[k] for k in names} & {"C", "U"}
    if len(cases) == 2:
        feats.append("name uneven")
    elif cases == {"U"}:
        feats.append("name capitals" + (" initial" if g < 0 else ""))
    if word(f) in known.given and not has_f:
        feats.append("name family is given")
    if form == "K":
        feats.append(f"name K length {min(len(t.words[i]), 6)}")
    return Segment(t.at[i], t.to[j - 1], "name", feats)


def _emails(text: str) -> Iterator[Segment]:
    for shape, pattern in _EMAILS:
        if shape == "plain" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            host = _DOTS.split(m[0])[-1]
            feats = [f"email {shape}", "email tld " + ("letters" if _LETTERS.fullmatch(host) else "other")]
            if _REMOTE.match(m[0]) or _REMOTE_PATH.match(text[m.end() : m.end() + 2]):
                feats.append("email remote")
            if text[max(0, m.start() - 3) : m.start()].endswith("://"):
                feats.append("email url")
            if shape == "spelt":
                at = _AT_WORD.search(m[0])
                feats.append(f"email at={at[1].lower()}" if at else "email bare at" + (" and dot" if _SPELT_DOT.search(m[0]) else ""))
            yield Segment(*m.span(), "email", feats)


def _phones(t: Tokens) -> Iterator[Segment]:
    text = t.text
    for run in _DIGITS.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
        if sum(b - a for a, b in groups) < 7:
            continue
        for i in range(len(groups)):
            a = groups[i][0]
            while a > run.start() and text[a - 1] in "+(":
                a -= 1
            first = bisect_left(t.at, a)
            cues = t.before(first, 2, 5)
            beside = first > 1 and t.types[first - 1] == "N" and t.types[first - 2] in "UI" and not t.apart[first - 1]
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n < 7:
                    continue
                if n > 15:
                    break
                b = groups[j][1]
                body = text[a:b]
                lengths = [y - x for x, y in groups[i : j + 1]]
                seps = "".join(sorted(set(_DIGIT.sub("", body[1:] if body[0] in "+(" else body))))
                lead = "+" if body[0] == "+" else "00" if body.startswith("00") else "(" if body[0] == "(" else "0" if body[0] == "0" else "1" if lengths[0] == 1 and body[0] == "1" else "digit"
                feats = [f"phone lead {lead}", f"phone digits {min(n, 13)}", f"phone groups {min(len(lengths), 6)}", f"phone lead {lead} groups {len(lengths) > 1}"]
                if n == 10 and lengths[-2:] == [3, 4] or n == 11 and lengths[-2:] == [3, 4]:
                    feats.append("phone 3 4" + (" digit" if lead == "digit" else ""))
                if len(set(seps)) > 2:
                    feats.append("phone separators")
                if "." in seps and len(seps) == 1:
                    feats.append("phone dots" + (" all two" if set(lengths) <= {2} else " 3 3 4" if lengths == [3, 3, 4] else ""))
                    if len(lengths) == 4 and all(int(text[x:y]) < 256 for x, y in groups[i : j + 1]):
                        feats.append("phone four bytes")
                feats += [f"phone before={w}" for w in cues]
                if i or j < len(groups) - 1:
                    feats.append("phone part of run")
                after = bisect_left(t.at, b)
                if after < len(t.words) and t.types[after] == "l":
                    feats.append(f"phone after={t.folded[after]}")
                if beside:
                    feats.append("phone behind letters and digits")
                if set(lengths) == {4} or len(lengths) > 2 and set(lengths[:-1]) == {4}:
                    feats.append("phone fours")
                if body.count("(") != body.count(")"):
                    feats.append("phone brackets")
                if n == 10 and len(lengths) == 1 and body[0] in "12" or n == 13 and len(lengths) == 1:
                    feats.append("phone epoch")
                yield Segment(a, b, "phone", feats)


_ID_JOINS = {"-", "/", "."}


def _ids(t: Tokens) -> Iterator[Segment]:
    """Windows of digit groups joined by a blank, hyphen, slash or stop, with up to three capitals before, of 6 to 14 digits in all."""
    text, n = t.text, len(t.words)
    for i in range(n):
        lead = t.types[i] in "UI" and len(t.words[i]) <= 3
        if not lead and t.types[i] != "N":
            continue
        if t.at[i] and _ID_LEFT.match(text[t.at[i] - 1]) or i > 1 and t.types[i - 2] == "N" and text[t.at[i] - 1 : t.at[i]] in (".", ",", "/", ":"):
            continue
        shape, digits, j = "", 0, i
        while j < n and j - i < WINDOW["id_number"]:
            kind, word = t.types[j], t.words[j]
            gap = "" if j == i else text[t.to[j - 1] : t.at[j]]
            if gap not in ("", " "):
                break
            if kind == "N" and word.isdigit():
                if digits and shape[-1:].isdigit():
                    if gap != " ":
                        break
                    shape += " "
                elif gap and digits:
                    break
                shape += ("" if digits else gap) + f"d{len(word)}"
                digits += len(word)
            elif j == i and lead:
                shape = f"U{len(word)}"
            elif word in _ID_JOINS and not gap and digits:
                shape += word
            else:
                break
            j += 1
            if digits > 14:
                break
            if digits < 6 or kind != "N":
                continue
            if j < n and t.at[j] == t.to[j - 1] and (t.types[j] not in ",.;:!?)]}>\"'”’»–\n" or t.words[j] in ".,:" and j + 1 < n and t.types[j + 1] == "N" and not t.apart[j + 1]):
                continue
            yield _id(t, i, j, shape)


def _id(t: Tokens, i: int, j: int, shape: str) -> Segment:
    feats = [f"id {shape}"]
    cues = t.before(i, 2, 5)
    feats += [f"id before={w}" for w in cues] + [f"id {shape} before={w}" for w in cues[:1]]
    if j < len(t.words) and t.types[j] == "l" and t.apart[j]:
        feats.append(f"id after={t.folded[j]}")
    if shape.count(".") == 3 and "d" not in shape.replace("d1", "").replace("d2", "").replace("d3", ""):
        feats.append("id four bytes")
    if i > 0 and t.types[i - 1] == "N" and t.apart[i]:
        feats.append("id digits before")
    if j < len(t.words) and t.types[j] == "N":
        feats.append("id digits after")
    if i > 0 and t.types[i - 1] in "UI" and t.types[i] == "N":
        feats.append("id capitals before")
    return Segment(t.at[i], t.to[j - 1], "id_number", feats)


def _units(t: Tokens) -> list[tuple[int, int, str]]:
    """Tokens as the parts of an address: (first token, after the last, kind): Z postal code, H house number, W word with a capital, w other word."""
    codes = {bisect_left(t.at, m.start()): m.end() for m in _ZIP.finditer(t.text)}
    out, i, n = [], 0, len(t.words)
    while i < n:
        kind, word, j = t.types[i], t.words[i], i + 1
        if i in codes and not (kind == "N" and len(word) == 4 and codes[i] == t.to[i] and j < n and t.words[j] == "/"):
            while j < n and t.at[j] < codes[i]:
                j += 1
            out.append((i, j, "Z4" if kind == "N" and t.to[j - 1] - t.at[i] == 4 else "Z"))
        elif kind == "N" and len(word) <= 4:
            if j < n and not t.apart[j] and t.types[j] in "Il":
                j += len(t.words[j]) == 1
            if j + 1 < n and t.words[j] in "/-" and not t.apart[j] and t.types[j + 1] == "N" and not t.apart[j + 1] and len(t.words[j + 1]) <= 4:
                j += 2
                if j < n and not t.apart[j] and t.types[j] in "Il" and len(t.words[j]) == 1:
                    j += 1
                out.append((i, j, "H/H"))
            else:
                out.append((i, j, "H"))
        elif kind in "CUIMlK":
            if j < n and t.words[j] == "." and not t.apart[j] and (len(word) <= _SHORT or j + 1 < n and t.types[j + 1] == "N" and t.apart[j + 1]):
                j += 1
            out.append((i, j, "w" if kind == "l" else "W"))
        else:
            out.append((i, j, word if word in ",\n" else "x"))
        i = j
    return out


def _addresses(t: Tokens) -> Iterator[Segment]:
    """Windows that begin with a number or a word and hold a house number, a comma or line end, and a word with a capital."""
    units = _units(t)
    places = [k for k, u in enumerate(units) if u[2][0] == "H" or u[2] == "Z4"]
    for s in range(len(units)):
        if units[s][2] not in ("H", "H/H", "W", "w"):
            continue
        at = bisect_left(places, s)
        if at == len(places) or places[at] - s > 8:
            continue
        i = units[s][0]
        if t.at[i] and _NAME_LEFT.match(t.text[t.at[i] - 1]):
            continue
        form, heads, cuts = [], [], 0
        for k in range(s, min(len(units), s + WINDOW["address"])):
            a, b, kind = units[k]
            if kind == "x" or kind in ",\n" and (k > s and units[k - 1][2] in ",\n" and kind == ","):
                break
            if kind in ",\n":
                cuts += 1
                if cuts > 4:
                    break
                if kind == "\n" and form[-1:] == [","]:
                    continue
            elif kind in "Ww" and not cuts:
                heads.append(a)
            if len(heads) > 6:
                break
            if not (kind in "Ww" and form[-1:] == [kind]):
                form.append("/" if kind == "\n" else kind)
            if kind in ("W", "Z", "Z4") and cuts and any(x[0] == "H" or x == "Z4" for x in form) and "W" in form:
                if b < len(t.words) and t.at[b] == t.to[b - 1] and _NAME_RIGHT.match(t.text[t.at[b]]):
                    continue
                yield _address(t, units, s, k, form, heads)


def _address(t: Tokens, units: list, s: int, k: int, form: list[str], heads: list[int]) -> Segment:
    i, j = units[s][0], units[k][1]
    if t.words[j - 1] == "." and units[k][2] == "W":
        j -= 1
    shape = " ".join(form)
    feats = [f"address {shape}", f"address begins {' '.join(form[:3])}", f"address ends {' '.join(form[-3:])}", f"address head words {len(heads)} {form[0]}"]
    feats += [x for h in heads for x in (f"address word={t.folded[h]}", f"address suffix={t.folded[h][-4:]}", f"address suffix={t.folded[h][-3:]}")]
    feats += ["address abbreviated" for h in heads if h + 1 < len(t.words) and t.words[h + 1] == "."]
    feats.append(f"address small words {sum(t.types[h] == 'l' for h in heads)} {form[0]}")
    town = 0
    for x in range(k, s, -1):
        if units[x][2] == "W":
            town += 1
        elif town:
            break
    feats += [f"address first={t.folded[i]}", f"address town words {min(town, 3)} {form[-1]}", f"address length {min(len(form), 9)}"]
    before = t.before(i, 1, 3)
    feats.append(f"address before={before[0] if before else ''}")
    if i and t.types[i - 1] in "CU" and t.apart[i]:
        feats.append("address capital before")
    if i and t.types[i - 1] == "N":
        feats.append("address number before")
    if t.sentence_start(i):
        feats.append("address begins a sentence")
    nxt = [u[2] for u in units[k + 1 : k + 4]]
    feats.append(f"address ahead of {' '.join(nxt[:2])}")
    if nxt and nxt[0] in ("Z", "Z4", "W", "H") and t.apart[units[k + 1][0]]:
        feats.append(f"address goes on {nxt[0]}")
    return Segment(t.at[i], t.to[j - 1], "address", feats)


def segments(text: str, known: Names) -> list[Segment]:
    """All candidate segments with the features of the whole span; everything else is one token of no entity each."""
    t = Tokens(text)
    seen, out = set(), []
    for source in (_emails(text), _phones(t), _ids(t), _addresses(t), _names(t, known)):
        for s in source:
            if (s.start, s.end, s.kind) not in seen:
                seen.add((s.start, s.end, s.kind))
                out.append(s)
    return out


def _lattice(found: list[Segment]) -> tuple[dict[int, int], list[list[int]]]:
    """Places at which a segment begins or ends, and the segments that end at each."""
    places = {p: i for i, p in enumerate(sorted({p for s in found for p in (s.start, s.end)}))}
    ends: list[list[int]] = [[] for _ in places]
    for k, s in enumerate(found):
        ends[places[s.end]].append(k)
    return places, ends


def decode(found: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The best sequence of segments: dynamic programming over their boundaries chooses places and kinds jointly.

    Windows are bounded by their kinds, so each place has few segments that end there, and the work is linear in the text.
    """
    places, ends = _lattice(found)
    best, back = [0.0] * len(places), [-1] * len(places)
    for p in range(len(places)):
        best[p] = best[p - 1] if p else 0.0
        for k in ends[p]:
            score = best[places[found[k].start]] + sum(weights.get(f, 0.0) for f in found[k].features)
            if score > best[p]:
                best[p], back[p] = score, k
    out, p = [], len(places) - 1
    while p >= 0:
        if back[p] >= 0:
            out.append(found[back[p]])
            p = places[out[-1].start]
        else:
            p -= 1
    return out[::-1]


def gradient(found: list[Segment], gold: set[tuple[int, int, str]], weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """Log-likelihood of the gold segments and its gradient, by the forward-backward algorithm on the lattice."""
    places, ends = _lattice(found)
    n = len(places)
    scores = [sum(weights.get(f, 0.0) for f in s.features) for s in found]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forth = [0.0] * n
    for p in range(n):
        forth[p] = forth[p - 1] if p else 0.0
        for k in ends[p]:
            forth[p] = add(forth[p], forth[places[found[k].start]] + scores[k])
    starts: list[list[int]] = [[] for _ in range(n)]
    for k, s in enumerate(found):
        starts[places[s.start]].append(k)
    from_here = [0.0] * n
    for p in range(n - 1, -1, -1):
        from_here[p] = from_here[p + 1] if p + 1 < n else 0.0
        for k in starts[p]:
            from_here[p] = add(from_here[p], scores[k] + from_here[places[found[k].end]])
    total = forth[-1] if n else 0.0
    out: dict[str, float] = {}
    likelihood = -total
    for k, s in enumerate(found):
        mass = math.exp(forth[places[s.start]] + scores[k] + from_here[places[s.end]] - total)
        there = (s.start, s.end, s.kind) in gold
        likelihood += scores[k] if there else 0.0
        for f in s.features:
            out[f] = out.get(f, 0.0) + there - mass
    return likelihood, out


def fit(examples: Iterable[tuple[list[Segment], set]], rounds: int = 12, rate: float = 0.3, decay: float = 2e-4) -> dict[str, float]:
    """Weights by adaptive gradient ascent on the penalised likelihood."""
    weights: dict[str, float] = {}
    power: dict[str, float] = {}
    examples = [x for x in examples if x[0]]
    for _ in range(rounds):
        for found, gold in examples:
            _, g = gradient(found, gold, weights)
            for f, d in g.items():
                d -= decay * weights.get(f, 0.0)
                power[f] = power.get(f, 1e-3) + d * d
                weights[f] = weights.get(f, 0.0) + rate * d / math.sqrt(power[f])
    return weights


def trained() -> dict[str, float]:
    """The weights that `pii_train` fitted."""
    return json.loads(importlib.resources.files("tessera.llm").joinpath("pii_weights.json").read_text())


def redact(text: str, found: list[Segment]) -> str:
    """The text with a placeholder for each segment; all else as it was."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join(out) + text[at:]


def known_names(people: DataFrame) -> Names | None:
    """The folded names of a staff list, or None if there are more than every executor should hold."""
    rows = people.select("given", "family").distinct().limit(BROADCAST_NAMES + 1).collect()
    if len(rows) > BROADCAST_NAMES:
        return None
    return Names(frozenset(fold(r[0]) for r in rows if r[0]), frozenset(fold(r[1]) for r in rows if r[1]))


def _listed(texts: DataFrame, people: DataFrame) -> DataFrame:
    """`texts` with `given` and `family`, the listed names among each text's words, by joining words and list."""

    @F.pandas_udf("array<string>")
    def words(text: pd.Series) -> pd.Series:
        return text.map(lambda x: sorted({w for w, k in zip(*(lambda t: (t.folded, t.types))(Tokens(x))) if w and k in ("C", "U", "K")}) if x else [])

    @F.pandas_udf("string")
    def folded(name: pd.Series) -> pd.Series:
        return name.map(lambda x: fold(x) if x else x)

    names = people.select(F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(k).alias("name")) for k in ("given", "family")])).alias("x"))
    names = names.select("x.which", folded("x.name").alias("word")).filter("word IS NOT NULL AND word <> ''").distinct()
    one = texts.select("text").filter("text IS NOT NULL").distinct().withColumn("h", F.sha2("text", 256))
    hit = one.select("h", F.explode(words("text")).alias("word")).join(names, "word")
    pick = lambda k: F.collect_set(F.when(F.col("which") == k, F.col("word"))).alias(k)
    return texts.withColumn("h", F.sha2("text", 256)).join(hit.groupBy("h").agg(pick("given"), pick("family")), "h", "left").drop("h")


def scanned(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(tbl, row_id, redacted, kinds) of each row of `texts` (tbl, row_id, text): `kinds` are the items' kinds from the left.

    Null texts give null and no kinds; empty ones stay empty. Long texts are read whole. Rows are only mapped, never shuffled, as long
    as the list of names fits every executor; a longer list is joined to the texts' words, which shuffles the texts once.
    """
    known = known_names(people)
    shared = texts.sparkSession.sparkContext.broadcast((known, trained()))
    none = F.array().cast("array<string>")
    texts = texts.select("tbl", F.col("row_id").cast("string").alias("row_id"), "text")
    texts = texts.select("*", none.alias("given"), none.alias("family")) if known else _listed(texts, people)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, weights = shared.value
        for b in batches:
            redacted, kinds = [], []
            for t, given, family in zip(b["text"], b["given"], b["family"]):
                mine = known or Names(frozenset(() if given is None else given), frozenset(() if family is None else family))
                best = decode(segments(t, mine), weights) if t else []
                redacted.append(redact(t, best) if t else t)
                kinds.append([s.kind for s in best])
            yield pd.DataFrame({"tbl": b["tbl"], "row_id": b["row_id"], "redacted": redacted, "kinds": kinds})

    return texts.mapInPandas(run, "tbl string, row_id string, redacted string, kinds array<string>")


def items(scans: DataFrame) -> DataFrame:
    """(tbl, row_id, kind, item): every item once, numbered within its kind from the left."""
    each = scans.select("tbl", "row_id", F.posexplode("kinds").alias("at", "kind"), "kinds")
    nth = F.size(F.filter(F.slice("kinds", F.lit(1), F.col("at") + 1), lambda k: k == F.col("kind"))).cast("bigint")
    return each.select("tbl", "row_id", "kind", nth.alias("item")).distinct()
