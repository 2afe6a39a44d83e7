"""Garbled text from wrong decoding: finding the spans, and restoring them."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte code pages in which UTF-8 bytes are wrongly read.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac_roman", "mac_latin2", "cp1254", "cp1257", "iso8859-15")
#: (read as, truly): single-byte pages mistaken for one another.
SWAPS = (
    ("cp1252", "cp1250"), ("latin-1", "cp1250"), ("cp1252", "iso8859-2"), ("latin-1", "iso8859-2"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1252", "cp1251"),
    ("latin-1", "cp1251"), ("cp1250", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "cp1250"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1250", "cp852"), ("cp1252", "cp852"), ("latin-1", "cp852"), ("cp852", "cp1250"), ("cp437", "cp852"),
    ("cp852", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp850", "cp1250"), ("cp437", "cp1250"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("latin-1", "cp850"),
    ("mac_roman", "cp1252"), ("mac_roman", "cp1250"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1252", "mac_latin2"), ("cp1250", "mac_latin2"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"),
)
#: Nats by which a re-reading must be likelier: per pair of characters, and in all.
PAIR_GAIN, TOTAL_GAIN, SPAN_GAIN = 2.0, 9.0, 1.0
SEEN = 100_000  # runs and words whose re-readings a worker remembers, to save work only
_CONTROLS = re.compile("[\x80-\x9f]")
_FOREIGN = re.compile("[^\x00-\x7f]+")


@lru_cache
def page(name: str) -> tuple[dict[str, int], dict[int, str]]:
    """Character to byte and back of the upper half; bytes without a character are control characters, as browsers read them."""
    back = {}
    for b in range(0x80, 0x100):
        try:
            back[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            back[b] = chr(b)
    return {c: b for b, c in back.items()}, back


@lru_cache
def automaton(name: str) -> re.Pattern:
    """Maximal runs of well-formed UTF-8 sequences of two to four bytes, over the page's characters."""
    back = page(name)[1]
    of = lambda lo, hi: "[" + "".join(re.escape(back[b]) for b in range(lo, hi + 1)) + "]"
    tail = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}})+")


def decoded(span: str, name: str) -> str | None:
    """The span's bytes in the page read as UTF-8, if they are that."""
    there = page(name)[0]
    try:
        return bytes(there[c] for c in span).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None


@lru_cache
def _known() -> frozenset:
    return frozenset(c for n in (*READ_AS, "cp1253") for c in page(n)[0])


#: Blocks where one character may be all of a span: Latin-1, Latin Extended-A, Romanian letters, Greek, Cyrillic, general punctuation,
#: currency and letterlike symbols. Elsewhere a span needs more structure.
_NEAR = ((0xA0, 0x17F), (0x218, 0x21B), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x2010, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x214F))
#: Bits by which a sequence of 2, 3 or 4 bytes is rarer than chance among high bytes (lead bytes over 128, times 1/2 for each other byte).
_BITS = {2: 3, 3: 5, 4: 8}
#: Scripts that are written together; any other script stands alone.
_TOGETHER = tuple(regex.compile("[" + "".join(rf"\p{{{x}}}" for x in n.split()) + "]+") for n in ("Latin", "Cyrillic", "Greek", "Han Hiragana Katakana Bopomofo", "Hangul Han"))
_NEUTRAL = regex.compile(r"[\p{Common}\p{Inherited}]+")


@lru_cache(SEEN)
def _assigned(c: str) -> bool:
    """Whether a text may hold the character: it is assigned, no control but white space, and not for private use."""
    kind = unicodedata.category(c)
    return kind not in ("Cn", "Co", "Cs") and (kind != "Cc" or c in "\t\n\r")


def _coherent(text: str) -> bool:
    """Whether all letters of a span are of one script, or of several that are written together."""
    bare = _NEUTRAL.sub("", text)
    return not bare or any(p.fullmatch(bare) for p in _TOGETHER) or len({unicodedata.name(c, "").split(" ")[0] for c in bare}) == 1


_LOWER = regex.compile(r"\p{Ll}+")
_WORD_LIKE = regex.compile(r"\p{Ll}+|\p{Lu}\p{Ll}*|\p{Lu}+|\p{Ll}\p{Lu}+")


def plausible(span: str, new: str) -> bool:
    """Whether a span and what it decodes to may be taken for a garbled place on the bytes' structure alone.

    Either the new characters lie in near blocks and the span isn't all small letters, or there are bits enough, in one script. What looks like a word as it stands (or
    one with its case turned) needs more: whole words of some languages are well-formed in some page by chance.
    """
    if not _coherent(new):
        return False
    if all(c <= "\x7f" or any(a <= ord(c) <= b for a, b in _NEAR) for c in new) and not _LOWER.fullmatch(span):
        return True
    return sum(_BITS[len(c.encode())] for c in new if c > "\x7f") >= (40 if _WORD_LIKE.fullmatch(span) and _coherent(span) else 5)


def _class(c: str) -> str:
    if c.isascii():
        return c if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "."
    return c if c in _known() else "¤"


def pairs(text: str) -> list[str]:
    """Neighbouring characters of which one at least is not ASCII, in classes; the ends count as blanks."""
    out = []
    for m in _FOREIGN.finditer(text):
        a, b = m.span()
        s = [_class(c) for c in (text[a - 1] if a else " ") + m[0] + (text[b] if b < len(text) else " ")]
        out += map("".join, zip(s, s[1:]))
    return out


def _readings(run: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(from, to, decoded, page, still garbled) of each maximal well-formed span of a run that decodes to right characters."""
    for name in READ_AS:
        for m in automaton(name).finditer(run):
            a, b = m.span()
            new = decoded(m[0], name)
            if new is None:
                continue
            again = b - a >= 4 and decoded_again(new)
            if all(map(_assigned, _CONTROLS.sub("", new) if again else new)):
                yield a, b, new, name, again


def _apart(run: str, a: int, b: int) -> bool:
    """Whether run[a:b] has no foreign letter beside it, nor a symbol if it holds symbols. Right words and drawn lines meet the
    structure by chance, but mostly inside a longer run of their kind."""
    beside = run[a - 1 : a] + run[b : b + 1]
    return not any(map(str.isalpha, beside)) and not (any(unicodedata.category(c) == "So" for c in beside) and any(unicodedata.category(c) == "So" for c in run[a:b]))


@lru_cache(SEEN)
def _evidence(left: str, run: str, right: str) -> frozenset:
    """The pairs of a run that say what is usual: those that touch no span which may itself be garbled."""
    s = [_class(c) for c in left + run + right]
    doubtful = {i for a, b, new, *_ in _readings(run) if _apart(run, a, b) and plausible(run[a:b], new) for i in range(a, b + 1)}
    return frozenset(x + y for i, (x, y) in enumerate(zip(s, s[1:])) if i not in doubtful)


def evidence(text: str) -> set[str]:
    """`pairs` without those of spans that are well-formed UTF-8 in a legacy page, so that no garbling becomes usual by being frequent."""
    out: set[str] = set()
    for m in _FOREIGN.finditer(text):
        a, b = m.span()
        out |= _evidence(text[a - 1] if a else " ", m[0], text[b] if b < len(text) else " ")
    return out


def pair_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(pair, n): in how many different texts a pair occurs as evidence, so that neither long texts nor copies decide what is usual.

    Only a hash and the set of pairs of each text that isn't ASCII are shuffled. There are at most some 800 classes of characters, so
    at most 640 000 pairs at any size.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [t for t in b["t"] if not t.isascii()]
            yield pd.DataFrame({"h": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in rows], "ps": ["".join(sorted(evidence(t))) for t in rows]})

    rows = documents.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    return rows.mapInPandas(find, "h binary, ps string").distinct().select(F.explode(F.regexp_extract_all("ps", F.lit("(?s).."), 0)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


class Likelihood:
    """How usual pairs of characters are in the corpus."""

    def __init__(self, counts: dict[str, int]):
        self.logs = {p: math.log(n) for p, n in counts.items() if n > 1}  # a pair in one text says nothing about that text
        self.none = -2.0
        self.seen: dict[tuple, list] = {}
        self.words: dict[str, list] = {}

    def of(self, text: str) -> tuple[float, int]:
        found = pairs(text)
        return sum(self.logs.get(p, self.none) for p in found), len(found)

    def mean(self, text: str) -> float:
        total, n = self.of(text)
        return total / n if n else 5.0

    def knows(self, text: str) -> bool:
        """Whether each pair of a text is in the corpus."""
        return all(p in self.logs for p in pairs(text))

    def inside(self, span: str) -> float:
        """The mean over the span's own pairs, without those at its ends."""
        s = [_class(c) for c in span]
        return sum(self.logs.get(x + y, self.none) for x, y in zip(s, s[1:])) / (len(s) - 1)


def _shown(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands alone between quotation marks, brackets or code marks: shown, not garbled."""
    left, right = text[a - 1 : a], text[b : b + 1]
    return (left, right) in {("“", "”"), ('"', '"'), ("'", "'"), ("„", "“"), ("‘", "’"), ("«", "»"), ("`", "`"), ("(", ")"), ("[", "]"), ("<", ">"), ("‹", "›"), ("„", "”")}


Found = tuple[int, int, str, str, float]


def _run_spans(left: str, run: str, right: str, likely: Likelihood) -> list[Found]:
    """(from, to, restored, page, gain) of all acceptable readings in a run of characters that aren't ASCII."""
    found = []
    for a, b, new, name, again in _readings(run):
        before, after = run[a - 1] if a else left, run[b] if b < len(run) else right
        gain = likely.mean(before + new + after) - likely.mean(before + run[a:b] + after)
        # What was read twice stays garbled after one reading, so it only has to become shorter in bytes that make sense. Where
        # no right text has the span's own pairs, the bytes' structure decides.
        fits = plausible(run[a:b], new)
        if (gain >= SPAN_GAIN and (fits or likely.knows(before + new + after))) or (fits and _apart(run, a, b) and likely.inside(run[a:b]) < likely.rare) or again:
            found.append((a, b, new, name, gain))
    return found


def _chosen(found: list[Found], votes: Counter) -> list[Found]:
    """The longest readings first; where pages disagree on a place, the page by which the whole text gains most."""
    taken: list[Found] = []
    for x in sorted(found, key=lambda x: (x[0] - x[1], -votes[x[3]], -x[4])):
        if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
            taken.append(x)
    return taken


def utf8_spans(text: str, likely: Likelihood) -> list[tuple[int, int, str, str]]:
    """(from, to, restored, page) of the spans that are UTF-8 read in a legacy page. Such a span holds no ASCII."""
    runs = []
    for m in _FOREIGN.finditer(text):
        i, j = m.span()
        if j - i < 2:
            continue
        key = (text[i - 1 : i], m[0], text[j : j + 1])
        found = likely.seen.get(key)
        if found is None:
            found = _run_spans(*key, likely)
            if len(likely.seen) < SEEN:
                likely.seen[key] = found
        if found:
            runs.append((i, found))
    votes: Counter = Counter()
    for _, found in runs:
        for a, b, _, name, gain in found:
            votes[name] += (b - a) * (1.0 + max(gain, 0.0))
    out = [(i + a, i + b, new, name) for i, found in runs for a, b, new, name, _ in _chosen(found, votes)]
    return sorted(x for x in out if not _shown(text, x[0], x[1]))


def decoded_again(text: str) -> bool:
    return any(automaton(n).search(text) for n in ("cp1252", "latin-1", "cp1250", "cp850", "cp852", "cp437", "cp1251", "mac_roman"))


def _rereadings(word: str, likely: Likelihood) -> list[tuple[int, str, float]]:
    """(place in SWAPS, re-read word, gain) of an unlikely word's re-readings that are much likelier."""
    total, n = likely.of(word)
    if not n or total / n >= likely.odd:
        return []
    out = []
    for k, (read, truly) in enumerate(SWAPS):
        there, back = page(read)[0], page(truly)[1]
        if any(not c.isascii() and c not in there for c in word):
            continue
        new = "".join(c if c.isascii() else back[there[c]] for c in word)
        t2, n2 = likely.of(new)
        if new == word or not n2:
            continue
        # A letter alone is no evidence, unless it stands for a dash; it follows the other words.
        alone = sum(map(str.isalpha, word)) < 2 and sum(map(str.isalpha, new)) < 2 and not (word.isalpha() and new in "–—…")
        if t2 / n2 - total / n >= PAIR_GAIN and t2 / n2 >= likely.rare and _letters(new):
            out.append((k, new, 0.0 if alone else (t2 / n2 - total / n) * n))
    return out


_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


def swapped(text: str, likely: Likelihood) -> tuple[str, str, str] | None:
    """(restored, read as, truly) if re-reading the text's words from one page in another makes them much likelier."""
    by_swap: dict[int, list] = {}
    for m in _WORD.finditer(text):
        ways = likely.words.get(m[0])
        if ways is None:
            ways = _rereadings(m[0], likely)
            if len(likely.words) < SEEN:
                likely.words[m[0]] = ways
        for k, new, gain in ways:
            by_swap.setdefault(k, []).append((*m.span(), new, gain))
    totals = {k: sum(x[3] for x in v) for k, v in by_swap.items()}
    k = max(totals, key=lambda k: (totals[k], -k), default=None)
    if k is None or totals[k] < TOTAL_GAIN:
        return None
    for a, b, new, _ in reversed(by_swap[k]):
        text = text[:a] + new + text[b:]
    return text, *SWAPS[k]


def _letters(word: str) -> bool:
    """Whether most of the word's foreign characters are letters or common marks."""
    foreign = [c for c in word if not c.isascii()]
    return sum(c.isalpha() or c in "–—‘’“”„…«»°€" for c in foreign) >= 0.8 * len(foreign)


_LOST = re.compile("�+")


def lost(text: str) -> bool:
    """Whether a replacement character stands for lost bytes, rather than being shown."""
    return any(not _shown(text, *m.span()) for m in _LOST.finditer(text))


def repair(text: str, likely: Likelihood) -> tuple[bool, str, list[str]]:
    """(garbled, restored text, what was done). Bytes that were lost as U+FFFD stay so."""
    if text.isascii():
        return False, text, []
    done: list[str] = []
    while spans := utf8_spans(text, likely):  # each round makes the text shorter, so it ends
        for a, b, new, name in reversed(spans):
            text = text[:a] + new + text[b:]
            done.append(f"utf-8 as {name}")
    if other := swapped(text, likely):
        text = other[0]
        done.append(f"{other[2]} as {other[1]}")
    if lost(text):
        done.append("lost")
    return bool(done), text, sorted(set(done))


def model(documents: DataFrame) -> dict[str, int]:
    """The pair counts on the driver: bounded by the classes, see `pair_counts`."""
    return {r["pair"]: r["n"] for r in pair_counts(documents).collect()}


def likelihood(counts: dict[str, int]) -> Likelihood:
    out = Likelihood(counts)
    total = sum(counts.values()) or 1
    out.none = math.log(total) - 16 if total > 1000 else -2.0
    out.none = min(out.none, 0.0) - 1.0
    # A word is odd if its pairs are, on the mean, less than one in some thousands of all pairs.
    out.odd = math.log(total) - 7.0
    # A reading whose pairs are, on the mean, in three texts at most or in less than one of 30 000 is unknown to the corpus.
    out.rare = max(out.odd - 3.5, 1.1)
    return out


def repaired(documents: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, garbled, restored, causes) of each document with a text; null texts are left out, empty ones are not garbled.

    Characters are mapped back to the bytes of each legacy page; an automaton of UTF-8's byte structure finds the maximal
    well-formed spans, and only these are decoded, again while anything comes of it. A span counts if its characters become
    likelier beside their neighbours. Single-byte pages mistaken for one another have no such structure: there, words of unlikely
    pairs are re-read from page to page. What stands alone in quotation marks or brackets is shown on purpose.
    """
    counts = documents.sparkSession.sparkContext.broadcast(model(documents.select(F.col(text).alias("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likely = likelihood(counts.value)
        for b in batches:
            rows = [repair(t, likely) for t in b["t"]]
            yield pd.DataFrame({row_id: b["i"], "garbled": [r[0] for r in rows], "restored": [r[1] for r in rows], "causes": [", ".join(r[2]) for r in rows]})

    rows = documents.filter(F.col(text).isNotNull()).select(F.col(row_id).alias("i"), F.col(text).alias("t"))
    kind = dict(documents.dtypes)[row_id]
    return rows.mapInPandas(run, f"`{row_id}` {kind}, garbled boolean, restored string, causes string")
