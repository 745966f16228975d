"""Normalised text that still knows where its characters come from.

`Aligned` holds a text and, for each character, the range of UTF-16 units of the source it
stands for. Each step of the normaliser is a substitution on it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html.entities import name2codepoint

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasewright.functions.text import SEVERAL, SINGLE, col

_ENTITY = re.compile(r"&(?:#(?P<d>[0-9]+)|#[xX](?P<x>[0-9a-fA-F]+)|(?P<name>\w+));")
_MARKS = re.compile("[" + "".join(map(re.escape, [*SINGLE, *SEVERAL, "\0"])) + "]")
_WIDE = re.compile("[！-～]")
#: Marks before which a character with a reading gets no space.
_NO_SPACE = ",.:;\"'? !)\n"
RANGE = "struct<start:int,length:int>"


class Aligned:
    """A text with, for each character, where its source begins and how many UTF-16 units it takes there. Both never fall."""

    def __init__(self, text: str):
        self.text = text
        self.size = 1 + (points(text) > 0xFFFF).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        #: Which characters stand for something cut out, over which nothing may reach.
        self.blocked = np.zeros(len(text), dtype=bool)

    @property
    def ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.start.tolist(), self.size.tolist(), strict=True))

    def take(self, first: np.ndarray, last: np.ndarray) -> None:
        """Each new character stands for the characters from first to last."""
        end = (self.start + self.size)[last]
        if self.blocked.any():
            before = np.append(0, np.cumsum(self.blocked))
            self.blocked = before[last + 1] > before[first]
        else:
            self.blocked = np.zeros(len(first), dtype=bool)
        self.start = self.start[first]
        self.size = end - self.start

    def sub(self, pattern: re.Pattern, replaced) -> None:
        """What pattern matches, left to right, becomes replaced(match); the new characters share the range of the old ones."""
        text, begin, end, times, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replaced(m)
            if new is None:
                continue
            a, b = m.span()
            text += [self.text[at:a], new]
            begin.append(a)
            end.append(b)
            times.append(len(new))
            at = b
        if text:
            size, begin, end = len(self.text), np.array(begin), np.array(end)
            self.text = "".join([*text, self.text[at:]])
            # How often each old character's place is taken: none inside a match but the first, for each of the new ones.
            inside, last = np.zeros(size + 1, dtype=np.int64), np.arange(size)
            inside[begin] += 1
            inside[end] -= 1
            taken = 1 - np.cumsum(inside)[:-1]
            taken[begin], last[begin] = times, end - 1
            first = np.repeat(np.arange(size), taken)
            self.take(first, last[first])

    def replace(self, old: str, new: str) -> None:
        self.sub(re.compile(re.escape(old)), lambda m: new)

    def separate(self, phrase: str) -> None:
        """Each place of a phrase becomes one blocked line feed, which holds the phrase's range."""
        at, shift = [], 0
        for m in re.finditer(re.escape(phrase), self.text) if phrase else ():
            at.append(m.start() - shift)
            shift += len(phrase) - 1
        if at:
            self.sub(re.compile(re.escape(phrase)), lambda m: "\n")
            self.blocked[at] = True


class Bare(Aligned):
    """A text alone, for where no ranges are asked for."""

    def __init__(self, text: str):
        self.text = text

    def take(self, first: np.ndarray, last: np.ndarray) -> None:
        """Nothing is kept of where characters come from."""

    def sub(self, pattern: re.Pattern, replaced) -> None:
        self.text = pattern.sub(lambda m: m[0] if (new := replaced(m)) is None else new, self.text)

    def replace(self, old: str, new: str) -> None:
        self.text = self.text.replace(old, new)


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def table_of(characters) -> np.ndarray:
    """By code point: whether it is one of the characters."""
    out = np.zeros(0x110000, dtype=bool)
    out[[ord(c) for c in characters if len(c) == 1]] = True
    return out


@lru_cache(4)
def _known(readings: frozenset) -> np.ndarray:
    return table_of(readings)


@lru_cache(16)
def _ascii(marks: str) -> np.ndarray:
    """By code point up to 127: whether it is one of the marks, which lie below that."""
    return table_of(marks)[:128]


@lru_cache(1)
def _digits() -> np.ndarray:
    return table_of(c for c in map(chr, range(0x20000)) if unicodedata.category(c) == "Nd")


def merged(ranges) -> tuple[int, int]:
    """The smallest range that holds all of them."""
    if not ranges:
        return 0, 0
    start = min(s for s, _ in ranges)
    return start, max(s + n for s, n in ranges) - start


#: Names of HTML 4 that the normaliser leaves as they are; it knows apos besides the others.
UNKNOWN = (
    "quot gt reg Aring AElig Ccedil Igrave Icirc Iuml ETH Ograve Ocirc Otilde Uacute Yacute agrave aacute acirc atilde auml egrave eacute ecirc euml iacute ntilde oacute ouml oslash ugrave "
    "ucirc uuml thorn OElig scaron Yuml tilde Beta Delta Epsilon Zeta Theta Iota Lambda Xi Pi Tau Phi Chi alpha gamma eta kappa mu nu omicron rho sigma upsilon psi omega Dagger Prime trade "
    "larr rarr darr uArr rArr dArr hArr and cap cup le ge sup lang rang"
).split()
LEGACY = {k: v for k, v in name2codepoint.items() if k not in UNKNOWN} | {"apos": 39}


def entity(m: re.Match, names: dict[str, int] = LEGACY) -> str | None:
    """The character of a reference; None leaves it as it is."""
    code = int(m["d"]) if m["d"] else int(m["x"], 16) if m["x"] else names.get(m["name"])
    if code is None or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code)


def spaced(text: Aligned, known) -> None:
    """Spaces between characters with a reading (known) and others, and after sentences; control characters go. The last
    character is left alone."""
    if len(text.text) <= 1:
        return
    all_points = points(text.text)
    c, after, low = all_points[:-1], all_points[1:], np.minimum(all_points, 127)
    digit, read = _digits()[all_points], _known(frozenset(known))[all_points]
    between = (c == ord(".")) & digit[1:]
    between[0] = False
    between[1:] &= digit[:-2]
    space = np.select(
        [digit[:-1] & (after == ord("》")), between, read[:-1], _ascii("\t\n \"'(")[low[:-1]], _ascii("!.?")[low[:-1]]],
        [True, False, ~read[1:] & ~_ascii(_NO_SPACE)[low[1:]], False, ~_ascii("\" '")[low[1:]]],
        read[1:],
    )
    control = ((c < 32) | ((c >= 127) & (c < 160))) & ~_ascii("\t\n\r")[low[:-1]]
    kept = np.append(np.flatnonzero(~control), len(c))
    times = 1 + np.append(space, False)[kept]
    new = np.repeat(all_points[kept], times)
    new[(np.cumsum(times) - 1)[times > 1]] = 32
    text.text = new.tobytes().decode("utf-32-le", "surrogatepass")
    text.take(np.repeat(kept, times), np.repeat(kept, times))
    text.sub(re.compile(r"\. \. \. \. \. \."), lambda m: "...")


def without_ignored(source: str, simplify: dict, known, ranges: bool = True) -> Aligned:
    """The normaliser up to its last step."""
    text = Aligned(source) if ranges else Bare(source)
    # One character for one: the ranges stay.
    text.text = source.translate(simplify) if simplify else source
    text.sub(_ENTITY, entity)
    text.sub(_MARKS, lambda m: SINGLE.get(m[0]) or SEVERAL.get(m[0], ""))
    for old, new in (("  ", " "), (" \r\n", "\n"), (" \n", "\n"), (" ,", ",")):
        text.replace(old, new)
    text.sub(_WIDE, lambda m: chr(ord(m[0]) - 0xFEE0))
    spaced(text, known)
    return text


def ignored_list(phrases, simplify: dict, known) -> list[str]:
    """Phrases as they look in normalised text, the longest first."""
    return sorted({p for p in (without_ignored(x, simplify, known).text.strip("\t\n") for x in phrases) if p}, key=lambda p: (len(p), p), reverse=True)


def standardize(source: str, simplify: dict, known, ignored=(), ranges: bool = True) -> Aligned:
    """Normalised text without the ignored phrases (of ignored_list())."""
    text = without_ignored(source, simplify, known, ranges)
    for p in ignored:
        if p in text.text:
            text.replace(p, "")
    if ignored:
        text.replace("\t\n\n", "")
    return text


def blanked(source: str, simplify: dict, known, ignored=()) -> tuple[str, list[bool]]:
    """The source with a line feed for each character of an ignored phrase, and which characters these are. Phrases are looked
    for in the normalised text, the longest first; what one has taken, a later one doesn't reach over."""
    text = without_ignored(source, simplify, known)
    for p in ignored:
        text.separate(p)
    own = Aligned(source)
    units = np.zeros(int(own.size.sum()) + 1, dtype=np.int64)
    np.add.at(units, text.start[text.blocked], 1)
    np.add.at(units, (text.start + text.size)[text.blocked], -1)
    covered = np.append(0, np.cumsum(np.cumsum(units)[:-1] > 0))
    flags = covered[own.start + own.size] > covered[own.start]
    codes = points(source).copy()
    codes[flags] = 10
    return codes.tobytes().decode("utf-32-le", "surrogatepass"), flags.tolist()


def tables(simplify: tuple[str, str] = ("", ""), readings=(), ignored=()):
    """What the columns below share: the map of characters, the known ones, the ignored phrases as they will look."""
    table, known = str.maketrans(*simplify), frozenset(readings)
    return table, known, ignored_list(ignored, table, known)


def decoded_entities(text, legacy: bool = False) -> Column:
    """Character references decoded once; what isn't one stays. legacy: only the names that the normaliser knows, else those of HTML 4."""
    names = F.create_map(*(F.lit(x) for k, v in (LEGACY if legacy else name2codepoint).items() for x in (k, chr(v))))
    t, pattern = col(text), F.lit("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")

    def said(m):
        digits = F.regexp_replace(m, "^&#[xX]?0*|;$", "")
        code = F.when(m.rlike("^&#[xX]"), F.when(F.length(digits) <= 6, F.conv(F.concat(F.lit("0"), digits), 16, 10)))
        code = code.when(m.startswith("&#"), F.when(F.length(digits) <= 7, F.concat(F.lit("0"), digits))).try_cast("long")
        # A mark of byte order isn't read as a character.
        char = F.when(code == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        known = F.when((code < 0xD800) | code.between(0xE000, 0x10FFFF), char)
        return F.coalesce(known, F.try_element_at(names, F.substr(m, F.lit(2), F.length(m) - 2)), m)

    marks = F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), said)
    parts = F.transform(F.arrays_zip(F.split(t, pattern, -1).alias("before"), marks.alias("mark")), lambda x: F.concat(x["before"], F.coalesce(x["mark"], F.lit(""))))
    return F.when(F.regexp(t, pattern), F.array_join(parts, "")).otherwise(t)


def standardized(text, simplify: tuple[str, str] = ("", ""), readings=(), ignored=()) -> Column:
    """struct<text, ranges>: the normalised text, and where each character comes from, in UTF-16 units of the source."""
    known = tables(simplify, readings, ignored)

    def made(t):
        if t is None:
            return None
        got = standardize(t, *known)
        return {"text": got.text, "ranges": [{"start": s, "length": n} for s, n in got.ranges]}

    return F.udf(made, f"struct<text:string,ranges:array<{RANGE}>>", useArrow=True)(col(text))


def masked(text, simplify: tuple[str, str] = ("", ""), readings=(), ignored=()) -> Column:
    """struct<text, blocked>: the text for a name scan."""
    known = tables(simplify, readings, ignored)

    def made(t):
        if t is None:
            return None
        out, flags = blanked(t, *known)
        return {"text": out, "blocked": flags}

    return F.udf(made, "struct<text:string,blocked:array<boolean>>", useArrow=True)(col(text))


def merged_range(ranges, start, length) -> Column:
    """The range that a slice of array<struct<start, length>> covers; start from 0."""
    part = F.slice(ranges, start + 1, length)
    first = F.array_min(F.transform(part, lambda r: r["start"]))
    last = F.array_max(F.transform(part, lambda r: r["start"] + r["length"]))
    return F.struct(F.coalesce(first, F.lit(0)).alias("start"), F.coalesce(last - first, F.lit(0)).alias("length"))
