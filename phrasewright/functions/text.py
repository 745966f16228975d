"""Column functions over text: widths, cases, readings, numerals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerals and their digits.
NUMERALS, DIGITS = "零〇一二三四五六七八九两", "001234567892"
UNITS = {"十": 10, "百": 100, "千": 1000}
#: Punctuation replaced one for one, and by several characters.
SINGLE = {"。": ".", "．": ".", "“": '"', "「": '"', "‘": "'", "？": "?", "！": "!", "　": " "}
SEVERAL = {"，": ", ", "、": ", ", "：": ": ", "”": '" ', "」": '" ', "’": "' ", "…": "..."}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def narrow(text) -> Column:
    """Full-width forms U+FF01 to U+FF5E as ASCII."""
    return F.translate(col(text), "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)))


def widen(text) -> Column:
    """ASCII U+0021 to U+007E as full-width forms."""
    return F.translate(col(text), "".join(chr(c) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0xFF01, 0xFF5F)))


def punctuation(text) -> Column:
    out = col(text)
    for a, b in SEVERAL.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(F.translate(out, "".join(SINGLE), "".join(SINGLE.values())), "\0", "")


def collapse_spaces(text) -> Column:
    """Two spaces to one in a single pass, and none before line ends and commas."""
    out = col(text)
    for a, b in (("  ", " "), (" \r\n", "\n"), (" \n", "\n"), (" ,", ",")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalized(text, simplify: tuple[str, str] = ("", ""), ignored: list[str] | None = None) -> Column:
    """Simplify, punctuation, spaces, narrow, then remove ignored phrases, longest first."""
    out = F.translate(col(text), *simplify) if simplify[0] else col(text)
    return without(narrow(collapse_spaces(punctuation(out))), ignored or [])


def without(text, phrases: list[str]) -> Column:
    """Phrases removed, the longest first."""
    out = col(text)
    for phrase in sorted(filter(None, set(phrases)), key=lambda p: (-len(p), p)):
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return out


def utf16_length(text) -> Column:
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("int")


def title_words(text) -> Column:
    """The first letter of each space-separated word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(col(text), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def transliterated(text, readings: dict[str, str]) -> Column:
    """The reading of each character, or itself, with a space between every two."""
    table = F.create_map(*(F.lit(x) for kv in readings.items() for x in kv))
    return F.array_join(F.transform(F.split(col(text), ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), " ")


def first_meaning(value) -> Column:
    return F.regexp_extract(col(value), r"^([^/|]*)", 1)


def pretty(text) -> Column:
    """Without leading white space, the first letter in upper case."""
    t = F.regexp_replace(col(text), r"^\s+", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def title_cased(text) -> Column:
    """Whether every space-separated word begins with an upper-case letter."""
    return F.forall(F.split(col(text), " "), lambda w: (w != "") & (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)))


def modifiers_last(text) -> Column:
    """余 and 多 before a unit change places with it."""
    return F.regexp_replace(col(text), "([余多])([百千万亿])", "$2$1")


def under_ten_thousand(text) -> Column:
    """Value of numerals up to thousands: digit x unit summed; a unit alone or after zero counts one; other characters are nothing."""
    digit = lambda c: F.when(c.rlike(f"^[{NUMERALS}]$"), F.translate(c, NUMERALS, DIGITS)).try_cast("long")
    unit = F.create_map(*(F.lit(x) for u, v in UNITS.items() for x in (u, v)))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("digit"))
    step = lambda acc, c: F.when(
        F.map_contains_key(unit, c), F.struct((acc["total"] + F.greatest(acc["digit"], F.lit(1)) * F.element_at(unit, c).cast("long")).alias("total"), zero.alias("digit"))
    ).otherwise(F.struct(acc["total"].alias("total"), F.coalesce(digit(c), acc["digit"]).alias("digit")))
    return F.aggregate(F.split(col(text), ""), start, step, lambda acc: acc["total"] + acc["digit"])


_DIGIT = {n: int(d) for n, d in zip(NUMERALS, DIGITS, strict=True)}
_MIXED = re.compile(r"([0-9]+)\s*([万亿])\s*([0-9])")
_LARGE = {"亿": 100_000_000, "万": 10_000}


def _whole(n: int | None) -> int | None:
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _numeral(text: str | None) -> int | None:
    if text is None:
        return None
    text = text.strip()
    if not text:
        return 0
    if re.fullmatch("[+-]?[0-9]+", text) and _whole(int(text)) is not None:
        return int(text)
    if m := _MIXED.fullmatch(text):
        left, unit = int(m[1]), _LARGE[m[2]]
        if _whole(left * unit + int(m[3]) * unit // 10) is not None:
            return left * unit + int(m[3]) * unit // 10
    for name, unit in _LARGE.items():
        leading, found, trailing = text.rpartition(name)
        if found:
            high = _numeral(leading) if leading else 1
            low = _DIGIT[trailing] * unit // 10 if trailing in _DIGIT else _numeral(trailing)
            return None if high is None or low is None or _whole(high * unit) is None else _whole(high * unit + low)
    if len(text) >= 3 and all(c in _DIGIT for c in text):
        return _whole(int("".join(str(_DIGIT[c]) for c in text)))
    total = digit = 0
    for c in text:
        if c in _DIGIT:
            digit = _DIGIT[c]
        elif c in UNITS:
            total, digit = total + (digit or 1) * UNITS[c], 0
    return _whole(total + digit)


def _decimal(text: str | None) -> str | None:
    text = (text or "").strip()
    if not text:
        return None
    whole, point, fraction = text.partition("点")
    if point:
        n = _numeral(whole)
        return None if n is None else f"{n}." + "".join(str(_DIGIT.get(c, c)) for c in fraction)
    if len(text) >= 2 and all(c in _DIGIT for c in text):
        return "".join(str(_DIGIT[c]) for c in text)
    if len(text) == 3 and text[2] == "十" and text[0] in _DIGIT and text[1] in _DIGIT:
        return f"{_DIGIT[text[0]] * 10}-{_DIGIT[text[1]] * 10}"
    n = _numeral(text)
    return None if n is None else str(n)


def numeral_value(text) -> Column:
    """Value of numerals split by the last 亿, then by the last 万, either of which counts one if it leads; null beyond 64 bits.

    A digit that ends the text right after 亿 or 万 means the next lower unit, as it does in 3万5; three or more digits without
    units are read by position, and ASCII digits are a number.
    """
    return F.udf(_numeral, "long", useArrow=True)(col(text))


def decimal_text(text) -> Column:
    """Numerals as digits: with 点 a fraction, digits without units one by one, 三四十 the range 30-40."""
    return F.udf(_decimal, "string", useArrow=True)(col(text))


def grouped(n) -> Column:
    return F.format_number(col(n).cast("long"), 0)


def magnitude_text(n, deep: int = 2) -> Column:
    """Whole numbers in units of ức (10^8) and vạn (10^4), the rest grouped; ức themselves are counted the same way, which two
    levels do for 64 bits. Numbers below -9,999 are empty."""
    v = col(n).cast("long")
    whole = lambda by: F.call_function("div", v, F.lit(by))
    high, mid, low = whole(100_000_000), F.floor(F.pmod(v, F.lit(100_000_000)) / 10_000), F.pmod(v, F.lit(10_000))
    said = magnitude_text(high, deep - 1) if deep else grouped(high)
    parts = F.concat_ws(" ", F.when(high > 0, F.concat(said, F.lit(" ức"))), F.when(mid > 0, F.concat(grouped(mid), F.lit(" vạn"))), F.when(low > 0, grouped(low)))
    return F.when(v <= -10_000, "").when(v < 10_000, grouped(v)).otherwise(parts)


def numerals_of(n) -> Column:
    """A number below 10,000 digit by digit with its units: 1203 is 一千二百零三 without the filler, 一千二百三."""
    v = col(n).cast("long")
    digit = lambda k: F.floor(v / k) % 10
    name = lambda d: F.element_at(F.split(F.lit("零一二三四五六七八九"), ""), (d + 1).cast("int"))
    return F.concat(*(F.when(digit(k) > 0, F.concat(name(digit(k)), F.lit(u))).otherwise("") for k, u in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))))


def whole_numerals_of(n) -> Column:
    """A number below 10^12 in units of 亿 and 万; 零 stands before a part below a thousand that follows one of them."""
    v = col(n).cast("long")
    high, mid, low = F.floor(v / 100_000_000), F.floor(F.pmod(v, F.lit(100_000_000)) / 10_000), F.pmod(v, F.lit(10_000))
    filled = lambda part, above: F.concat(F.when((part < 1000) & above, "零").otherwise(""), numerals_of(part))
    parts = (
        F.when(high > 0, F.concat(numerals_of(high), F.lit("亿"))).otherwise(""),
        F.when(mid > 0, F.concat(filled(mid, high > 0), F.lit("万"))).otherwise(""),
        F.when(low > 0, filled(low, v >= 10_000)).otherwise(""),
    )
    return F.when(v == 0, "零").otherwise(F.concat(*parts))
