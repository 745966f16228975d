"""License scan by ordered signature rules, in DataFrame operations only.

A text is reduced to its lower-case words, one space between them. Hundreds of regular
expressions describe how licenses are named and granted; each is tried only where its
keyword occurs, and none where no general keyword does. Detections are word intervals. One
that lies inside another of the same or higher priority is suppressed, so "gnu general
public license version 3" stands and the plain "general public license" inside it does not.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside

#: The phrases whose places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Priorities of rules, and what a detection of each says for its label.
EXACT, NAMED, LOOSE = 3, 2, 1
CONFIDENCE = {EXACT: 0.99, NAMED: 0.9, LOOSE: 0.6}
_GRANT = "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"
#: A text with none of these has no detections: every rule's expression needs one of them.
GENERAL = ("licen", "copyright", "rights", "cc by", "cc0", "creative commons", "public domain", "gpl", "spdx", "unlicense", "gnu", "bsd", "warranty", "trademark", "patent", "copyleft", "permission", "redistribution", "proprietary")


def _named() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression), by hand."""
    out = [
        ("mit", NAMED, "mit licen", "mit license"),
        ("mit", EXACT, "mit licen", _GRANT + "mit license"),
        ("mit", EXACT, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("mit-0", EXACT, "mit no attribution", "mit no attribution(?: license)?"),
        ("x11", NAMED, "x11 licen", "x11 license"),
        ("isc", NAMED, "isc licen", "isc license"),
        ("isc", EXACT, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
        ("zlib", NAMED, "zlib licen", "zlib license"),
        ("boost", NAMED, "boost software licen", "boost software license(?: version 1 0| 1 0)?"),
        ("unlicense", NAMED, "unlicense", "(?:the )?unlicense"),
        ("wtfpl", NAMED, "what you want to public licen", "do what the [a-z]+ you want to public license"),
        ("public-domain", NAMED, "public domain", "(?:in|into|to) the public domain"),
        ("public-domain", LOOSE, "public domain", "public domain"),
        ("cc0", NAMED, "cc0", "cc0(?: 1 0)?(?: universal)?"),
        ("cc0", EXACT, "cc0", _GRANT + "cc0(?: 1 0)?(?: universal)?"),
        ("apache", LOOSE, "apache licen", "apache license"),
        ("apache-1.1", NAMED, "apache", "apache (?:software )?license (?:version )?1 1"),
        ("apache-2.0", NAMED, "apache", "apache (?:software )?license (?:version )?2 0"),
        ("apache-2.0", EXACT, "apache", _GRANT + "apache (?:software )?license (?:version )?2 0"),
        ("artistic-2.0", NAMED, "artistic licen", "artistic license(?: version)? 2 0"),
        ("artistic", LOOSE, "artistic licen", "artistic license"),
        ("python", NAMED, "python software foundation licen", "python software foundation license(?: version 2)?"),
        ("postgresql", NAMED, "postgresql licen", "postgresql license"),
        ("ofl", NAMED, "open font licen", "(?:sil )?open font license(?: version 1 1| 1 1)?"),
        ("openssl", NAMED, "openssl licen", "openssl license"),
        ("ncsa", NAMED, "ncsa", "(?:university of illinois )?ncsa open source license"),
        ("cddl", NAMED, "common development and distribution licen", "common development and distribution license(?: version)?(?: 1 [01])?"),
        ("cpl", NAMED, "common public licen", "common public license(?: version)?(?: 1 0)?"),
        ("odbl", NAMED, "open database licen", "open database license(?: version)?(?: 1 0)?"),
        ("odc-by", NAMED, "open data commons attribution", "open data commons attribution license"),
        ("pddl", NAMED, "public domain dedication and licen", "public domain dedication and license"),
        ("copyleft", LOOSE, "copyleft", "copyleft"),
        ("copyright", LOOSE, "copyright", "copyright"),
        ("copyright", NAMED, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
        ("reserved", NAMED, "all rights reserved", "all rights reserved"),
        ("reserved", EXACT, "all rights reserved", "copyright(?: [^ ]+){1,8} all rights reserved"),
        ("some-reserved", NAMED, "some rights reserved", "some rights reserved"),
        ("no-reserved", NAMED, "no rights reserved", "no rights reserved"),
        ("proprietary", NAMED, "proprietary and confidential", "proprietary and confidential"),
        ("proprietary", LOOSE, "unauthorized", "unauthorized (?:copying|use|reproduction)(?: [^ ]+){0,6} (?:license|copyright|permission)"),
        ("no-reuse", NAMED, "without permission", "(?:reproduced|copied|distributed|used) without permission"),
        ("no-reuse", NAMED, "written permission", "without (?:prior |express |the )*written permission"),
        ("no-warranty", LOOSE, "without warranty", "without warranty of any kind"),
        ("bsd-3-clause", NAMED, "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?"),
        ("bsd-2-clause", NAMED, "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?"),
        ("bsd-4-clause", NAMED, "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
        ("bsd-0-clause", NAMED, "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?"),
        ("bsd", LOOSE, "bsd licen", "bsd licenses?"),
        ("bsd", EXACT, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("spdx", LOOSE, "spdx", "spdx license identifier"),
        ("licensed", LOOSE, "licensed under", "licensed under"),
        ("gfdl", NAMED, "free documentation licen", "(?:gnu )?free documentation license(?: version)?(?: 1 [1-3])?"),
    ]
    return out


def _creative_commons() -> list[tuple[str, int, str, str]]:
    """Every kind of Creative Commons license with every version, by rule: label cc-by-nc-4.0 and cc-by-nc."""
    words = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    kinds = [("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")]
    out = []
    for kind in kinds:
        code, full, name = " ".join(kind), " ".join(words[k] for k in kind), "cc-" + "-".join(kind)
        out += [(name, NAMED, "cc by", f"cc {code}"), (name, NAMED, "creative commons", f"creative commons {full}"), (name, EXACT, "cc by", f"{_GRANT}cc {code}")]
        for major, minor in ((1, 0), (2, 0), (2, 5), (3, 0), (4, 0)):
            out += [
                (f"{name}-{major}.{minor}", EXACT, "cc by", f"(?:{_GRANT})?cc {code} (?:version )?{major} {minor}(?: international| unported| generic)?"),
                (f"{name}-{major}.{minor}", EXACT, "creative commons", f"(?:{_GRANT})?creative commons {full} (?:license )?(?:version )?{major} {minor}(?: international| unported| generic)?(?: license)?"),
            ]
    return out


def _gnu() -> list[tuple[str, int, str, str]]:
    """The GNU licenses with their versions, alone or with what follows them, by rule."""
    names = {"gpl": ("general public license", (1, 2, 3)), "lgpl": ("(?:lesser|library) general public license", (2, 3)), "agpl": ("affero general public license", (1, 3))}
    out = []
    for code, (full, versions) in names.items():
        keyword = "general public licen"
        out += [(code, NAMED, keyword, f"(?:gnu )?{full}"), (code, EXACT, keyword, f"{_GRANT}(?:gnu )?{full}"), (code, NAMED, code, f"(?:gnu )?{code}")]
        for v, tail in product(versions, ("", " only", " or later", " or (?:at your option )?any later version")):
            label = f"{code}-{v}" + (".1" if (code, v) == ("lgpl", 2) else "") + ("-or-later" if "later" in tail else "-only" if tail else "")
            minor = "(?: 1)?" if (code, v) == ("lgpl", 2) else "(?: 0)?"
            out += [
                (label, EXACT, keyword, f"(?:{_GRANT})?(?:gnu )?{full} (?:as published by the free software foundation )?(?:either )?(?:version |v)?{v}{minor}(?: of the license)?{tail}"),
                (label, EXACT, code, f"(?:gnu )?{code} ?(?:version |v)?{v}{minor}{tail}"),
            ]
    return out


def _families() -> list[tuple[str, int, str, str]]:
    """Licenses told apart by version only, by rule."""
    rows = [
        ("mpl", "mozilla public license", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse public license", ("1 0", "2 0")),
        ("eupl", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
        ("osl", "open software license", ("1 0", "2 0", "2 1", "3 0")),
        ("afl", "academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        ("ms-pl", "microsoft public license", ()),
        ("ms-rl", "microsoft reciprocal license", ()),
        ("apsl", "apple public source license", ("1 0", "1 1", "1 2", "2 0")),
        ("cecill", "cecill license", ("1 0", "1 1", "2 0", "2 1")),
        ("ecl", "educational community license", ("1 0", "2 0")),
        ("qpl", "q public license", ("1 0",)),
        ("lppl", "latex project public license", ("1 0", "1 1", "1 2", "1 3")),
        ("zpl", "zope public license", ("1 1", "2 0", "2 1")),
        ("sspl", "server side public license", ("1",)),
        ("bsl", "business source license", ("1 1",)),
        ("elastic", "elastic license", ("2 0",)),
    ]
    out = []
    for label, full, versions in rows:
        keyword = full.split(" licen")[0]
        out += [(label, NAMED, keyword, full), (label, EXACT, keyword, _GRANT + full)]
        out += [(f"{label}-{v.replace(' ', '.')}", EXACT, keyword, f"(?:{_GRANT})?{full} (?:version |v)?{v}") for v in versions]
    return out


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order: (label, priority, keyword, expression over words)."""
    return _named() + _creative_commons() + _gnu() + _families()


def words_line(text: str = "text"):
    """The lower-case (A-Z) words of a text, each with a space before and after it, as one string: ' a b '."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value, body):
    """body(value), the value computed once: a lambda's argument is at hand as it is, while a column inside a lambda is computed
    for each of its elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _indices(words, test):
    """Where in an array of words the test holds."""
    return F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())


def _places(line, expression):
    """Word intervals [start, end) of an expression's matches, left to right, as array<struct<start, end>>: matches are put
    between two marks, and the marked words' numbers are read off."""
    bounded = F.concat(F.lit("(?<= )("), expression, F.lit(")(?= )"))

    def intervals(words):
        # The line begins with a space, so the first word has number 1.
        starts, ends = _indices(words, lambda w: F.startswith(w, F.lit("\u0001"))), _indices(words, lambda w: F.endswith(w, F.lit("\u0002")))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct((x["a"] - 1).alias("start"), x["b"].alias("end")))

    both = _let(F.split(F.regexp_replace(line, bounded, F.lit("\u0001$1\u0002")), " "), intervals)
    return F.when(F.rlike(line, bounded), both).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _base_places(line, phrase: str):
    """Starts of all places of a phrase, overlapping or not."""
    first, *rest = phrase.split(" ")

    def starts(words):
        def here(w, i):
            test = w == first
            for k, x in enumerate(rest, 1):
                test = test & (F.try_element_at(words, i + k + 1) == x)
            return F.when(test, i - 1)

        return F.filter(F.transform(words, here), lambda i: i.isNotNull())

    return F.when(F.contains(line, F.lit(f" {phrase} ")), _let(F.split(line, " "), starts)).otherwise(F.array().cast("array<int>"))


def _labelled(starts, label: str):
    return F.transform(starts, lambda x: F.struct(F.lit(label).alias("label"), x.alias("start")))


_SPAN = "struct<label:string,priority:int,start:int,end:int>"


def scan(docs: DataFrame) -> DataFrame:
    """docs with __n_words, __base (array<struct<label, start>>), __detections (unsuppressed, by start), __labels, __score.

    Null texts are empty; texts without words have no detections. Everything happens in the row: nothing is shuffled, and
    repeated rows come out alike. Finding places costs in proportion to a text, suppression in proportion to its detections (and
    copying a few bytes for each to the power of 1.5). The score is the largest confidence of a detection or base place (0 without any). An
    empty table stays empty. Columns of docs with one of the five names are replaced; others are left alone.
    """
    table = F.from_json(F.lit(_as_json()), "array<struct<label:string,priority:int,keyword:string,expression:string>>")
    docs = docs.drop("__n_words", "__base", "__detections", "__labels", "__score")
    moved, back = aside(docs, "__line")
    keep = moved.withColumn("__line", words_line())
    line = F.col("__line")
    general = F.lit(False)
    for word in GENERAL:
        general = general | F.contains(line, F.lit(word))
    gated = F.filter(table, lambda r: F.contains(line, r["keyword"]))
    spans = F.flatten(F.transform(gated, lambda r: F.transform(_places(line, r["expression"]), lambda p: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), p["start"].alias("start"), p["end"].alias("end")))))
    detections = F.when(general, unsuppressed(spans)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    base = F.concat(*(_labelled(_base_places(line, phrase), label) for phrase, label in BASE))
    base = F.when(F.contains(line, F.lit(" cc by ")) | F.contains(line, F.lit("general public license")) | F.contains(line, F.lit("all rights reserved")), base).otherwise(F.array().cast("array<struct<label:string,start:int>>"))
    n_words = F.when(F.length(line) <= 2, 0).otherwise(_spaces(line) - 1).cast("long")
    out = keep.select(*back, n_words.alias("__n_words"), base.alias("__base"), detections.alias("__detections"))
    names = F.array_sort(F.array_distinct(F.concat(F.col("__base.label"), F.col("__detections.label"))))
    sure = F.aggregate("__detections", F.when(F.size("__base") > 0, CONFIDENCE[NAMED]).otherwise(0.0), lambda a, x: F.greatest(a, F.element_at(F.create_map(*(F.lit(v) for pair in CONFIDENCE.items() for v in pair)), x["priority"])))
    return out.withColumns({"__labels": names, "__score": sure})


def unsuppressed(spans):
    """Spans not inside another of the same or higher priority; of equal intervals and priorities the first label stays.

    Spans are taken in order with the farthest end so far of each priority. What stays is gathered in blocks of the root of
    their number, since appending to an array copies it.
    """
    key = lambda every: F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-s["priority"]).alias("low"), s["label"].alias("label")))
    none = F.array().cast(f"array<{_SPAN}>")
    span = lambda x: F.struct(x["label"].alias("label"), (-x["low"]).alias("priority"), x["start"].alias("start"), (-x["back"]).alias("end"))
    one = lambda acc, x: F.struct(
        F.transform(acc["far"], lambda f, i: F.when(i < -x["low"], F.greatest(f, -x["back"])).otherwise(f)).alias("far"),
        F.when(F.element_at(acc["far"], -x["low"]) >= -x["back"], acc["out"]).otherwise(F.concat(acc["out"], F.array(span(x)))).alias("out"),
    )
    block = lambda acc, xs: _let(
        F.aggregate(xs, F.struct(acc["far"].alias("far"), none.alias("out")), one),
        lambda found: F.struct(found["far"].alias("far"), F.concat(acc["out"], F.array(found["out"])).alias("out")),
    )

    def kept(ordered):
        size = F.ceil(F.sqrt(F.size(ordered))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice(ordered, i * size + 1, size))
        start = F.struct(F.array(*[F.lit(-1)] * 3).alias("far"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))

    return _let(spans, lambda every: F.when(F.size(every) > 0, _let(F.array_sort(key(every)), kept)).otherwise(none))


def _as_json() -> str:
    return json.dumps([{"label": a, "priority": p, "keyword": k, "expression": e} for a, p, k, e in rules()])
