"""Numbers inside text: spans, ranges and phrases, as small functions for the scan and as Arrow-batched columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasewright.functions.text import _DIGIT, _decimal, _numeral, col

#: Characters of numerals besides digits; names of the large units and of a thousand.
UNIT = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
WORD = {"亿": "ức", "万": "vạn", "千": "ngàn"}
NUMBER_CHARS = "".join(_DIGIT) + "".join(UNIT)
_SPAN = re.compile(rf"(?:(?:[0-9]+(?:[.,][0-9]+)?|[{NUMBER_CHARS}]+)[ \t]*)+")
_POSITIVE = "一二三四五六七八九"
_PAIR = rf"(?P<a>[{_POSITIVE}])(?P<b>[{_POSITIVE}])"
_PAIR_TWO = rf"(?P<a>[{_POSITIVE}两])(?P<b>[{_POSITIVE}])"
_RANGES = (
    ("tens", re.compile(rf"(?P<head>[十百千]+){_PAIR}(?P<unit>[万亿])")),
    ("both", re.compile(rf"{_PAIR_TWO}(?P<low>[十百千])(?P<unit>[万亿])")),
    ("unit", re.compile(rf"{_PAIR_TWO}(?P<unit>[十百千万亿])")),
    ("tail", re.compile(rf"(?P<head>.*(?P<unit>[万亿])){_PAIR}", re.S)),
)
_SHAPES = {"tens": re.compile("[十百千]+..[万亿]", re.S), "both": re.compile("..[十百千][万亿]", re.S), "unit": re.compile("..[十百千万亿]", re.S), "tail": re.compile(".*[万亿]..", re.S)}


def magnitude(n: int) -> str:
    """In units of ức and vạn, the rest grouped; ức themselves are counted the same way. Below -9,999 there is no such text."""
    if abs(n) < 10_000:
        return f"{n:,}"
    if n < 0:
        return ""
    high, rest = divmod(n, UNIT["亿"])
    mid, low = divmod(rest, UNIT["万"])
    return " ".join([*([f"{magnitude(high)} ức"] if high else []), *([f"{mid:,} vạn"] if mid else []), *([f"{low:,}"] if low else [])])


def range_text(text: str) -> str | None:
    """三四万 as 3-4 vạn, 二十三四 as 23-24; None if it isn't a range."""
    for kind, shape in _RANGES:
        if not _SHAPES[kind].fullmatch(text):
            continue
        # The first shape that fits decides, even if its digits don't make a range.
        m = shape.fullmatch(text)
        if not m or _DIGIT[m["a"]] >= _DIGIT[m["b"]]:
            break
        a, b, unit = _DIGIT[m["a"]], _DIGIT[m["b"]], UNIT[m["unit"]]
        if kind == "both":
            return f"{a * UNIT[m['low']]}-{b * UNIT[m['low']]} {WORD[m['unit']]}"
        if kind == "unit":
            return f"{a}-{b} {WORD[m['unit']]}" if m["unit"] in WORD else f"{a * unit}-{b * unit}"
        base = _numeral(m["head"])
        if base is None:
            break
        if kind == "tens":
            each = {"千": 100, "百": 10}.get(m["head"][-1], 1)
            return f"{magnitude((base + a * each) * unit)}-{magnitude((base + b * each) * unit)}"
        return f"{magnitude(base + a * unit // 10)}-{magnitude(base + b * unit // 10)}"
    if len(text) >= 3 and text[-2] in _DIGIT and text[-1] in _DIGIT and _DIGIT[text[-2]]:
        base = _numeral(text[:-2])
        if base and base > 0 and base % 10 == 0:
            return f"{base + _DIGIT[text[-2]]}-{base + _DIGIT[text[-1]]}"
    return None


def phrase(text: str, plain: bool = False) -> str | None:
    """A number as it is said: decimals and leading zeros as they are, ranges, two digits as a range, else by magnitude (plain: in digits)."""
    if "." in text or "," in text or (len(text) > 1 and text[0] == "0"):
        return text
    if found := range_text(text):
        return found
    if len(text) == 2 and text[0] in _DIGIT and text[1] in _DIGIT:
        return f"{_DIGIT[text[0]]}-{_DIGIT[text[1]]}"
    n = _numeral(text)
    return None if n is None else str(n) if plain else magnitude(n)


def span_at(text: str, start: int) -> tuple[int, str] | None:
    """(length, number) of the longest number from start; ASCII digits among numerals become numerals."""
    m = _SPAN.match(text, start)
    found = m[0].rstrip(" \t") if m else ""
    if not found or found in ("百", "千", "万", "亿"):
        return None
    latin = any("0" <= c <= "9" for c in found)
    if latin and any(c in _DIGIT for c in found):
        return len(found), "".join("零一二三四五六七八九"[int(c)] if "0" <= c <= "9" else c for c in found if c in NUMBER_CHARS or "0" <= c <= "9")
    return len(found), found


def spans(text: str, keys=frozenset()) -> dict[int, tuple[int, str]]:
    """By start, the numbers of a text from left to right; one whose text is a key is left, and the search goes on a character later."""
    out, at = {}, 0
    while m := _SPAN.search(text, at):
        at = m.start()
        found = span_at(text, at)
        if found and found[1] not in keys:
            out[at] = found
            at += found[0]
        else:
            at += 1
    return out


def number_phrase(text) -> Column:
    return F.udf(lambda t: None if t is None else phrase(t), "string", useArrow=True)(col(text))


def number_range(text) -> Column:
    return F.udf(lambda t: None if t is None else range_text(t), "string", useArrow=True)(col(text))


def tael_text(text) -> Column:
    """A number before 两 in taels."""
    def said(t):
        n = _numeral(t[:-1]) if t and t.endswith("两") else None
        return None if n is None else f"{magnitude(n)} lượng"

    return F.udf(said, "string", useArrow=True)(col(text))


def number_spans(text, keys: list[str] | None = None) -> Column:
    """array<struct<start, length, text>> of the numbers in a text."""
    known = frozenset(keys or ())
    found = lambda t: [{"start": s, "length": n, "text": x} for s, (n, x) in spans(t or "", known).items()]
    return F.udf(found, "array<struct<start:int,length:int,text:string>>", useArrow=True)(col(text))


def is_number_character(c) -> Column:
    return col(c).rlike(f"^[0-9{NUMBER_CHARS}]$")


def positive_digit(c, two: bool = False) -> Column:
    """1 to 9 of a numeral, and 2 of 两 if allowed; else null."""
    known = _POSITIVE + ("两" if two else "")
    return F.when(col(c).rlike(f"^[{known}]$"), F.translate(col(c), known, "1234567892"[: len(known)]).cast("long"))


def consecutive_digits(text) -> Column:
    """Three or more numeral digits and nothing else, as ASCII digits; else null."""
    return F.when(col(text).rlike(f"^[{''.join(_DIGIT)}]{{3,}}$"), F.translate(col(text), "".join(_DIGIT), "".join(map(str, _DIGIT.values()))))


def number_class(text) -> Column:
    """digits, decimal, positional (numeral digits without units), units, mixed, or null."""
    t, digits = col(text), "".join(_DIGIT)
    return F.when(t.rlike("^[0-9]+$"), "digits").when(t.rlike("^[0-9]+[.,][0-9]+$"), "decimal").when(t.rlike(f"^[{digits}]+$"), "positional").when(t.rlike(f"^[{NUMBER_CHARS}]+$"), "units").when(t.rlike(f"^[0-9{NUMBER_CHARS}]+$"), "mixed")


decimal_phrase = _decimal
