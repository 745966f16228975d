"""The scan against a plain version: dictionaries as dicts, every window of every place cut out and matched against every rule."""

import os
import random
import re

import pytest

from phrasewright.functions import normal, numbers
from phrasewright.operators import keys as K
from phrasewright.operators import rules as R
from phrasewright.operators import scan as S
from phrasewright.plans import catalogue as C

FOLDER = "/root/testdata/sf0.001"


def u16(text):
    return len(text.encode("utf-16-le")) // 2


class Plain:
    def __init__(self, rows, readings, phrases, names, raw, nouns, surnames, suffixes):
        self.readings, self.phrases, self.names, self.raw, self.nouns, self.surnames, self.suffixes = readings, phrases, names, raw, nouns, surnames, suffixes
        self.render = R.Rules.of(rows, nouns=nouns, surnames=surnames, suffixes=suffixes).render
        by = lambda family: [(r["key"], re.compile(r["pattern"]), set(r["literals"])) for r in sorted(rows, key=lambda r: r["rank"]) if r["family"] == family]
        self.noun_rules, self.number_rules = by("noun"), by("number")

    def best(self, window):
        found = None
        for key, shape, need in self.noun_rules:
            for m in shape.finditer(window) if need <= set(window) else ():
                noun = m[1]
                cuts = range(len(noun)) if key.startswith("{n}") or key.endswith("{n}") else (0,)
                for cut in cuts:
                    short = noun[: len(noun) - cut] if key.endswith("{n}") else noun[cut:]
                    if short in self.nouns:
                        found = R.Match(m.start() + (0 if key.endswith("{n}") else cut), len(m[0]) - cut, key, self.nouns[short])
                        break
                if found:
                    break
            if found:
                break
        for i in range(found.index if found else len(window)):
            sizes = [n for n in range(6, 1, -1) if i + n <= len(window) and self.person(window[i : i + n]) and window[i : i + n] not in self.phrases]
            sizes = [n for n in sizes if not any(window[i : i + m] in self.phrases for m in range(n + 1, min(20, len(window) - i) + 1))]
            if sizes:
                found = R.Match(i, sizes[0], R.PERSON)
                break
        if (found is None or found.index) and re.search(f"[0-9{numbers.NUMBER_CHARS}]", window):
            for key, shape, need in self.number_rules:
                m = shape.search(window) if need <= set(window) else None
                if m and m[1] and m[1].strip() and m[0] not in self.raw:
                    if found is None or m.start() < found.index:
                        return R.Match(m.start(), len(m[0]), key, m[1])
                    break
        return found

    def person(self, whole):
        return any(whole[:c] in self.surnames and whole[c:] in self.suffixes for c in range(1, len(whole)))

    def hides(self, text, at, size, table, floor):
        return any(text[i : i + n] in table for i in range(at + 1, at + size) for n in range(floor + 1, min(20, len(text) - i) + 1))

    def accepts(self, text, at, size, o):
        name = text[at : at + size] in self.names
        if o.names_first and size > 1 and not name and self.hides(text, at, size, self.names, 1):
            return False
        if o.algorithm == 1 or (o.names_first and name):
            return True
        return size < 2 or not self.hides(text, at, size, self.phrases, size if o.algorithm == 0 else max(size, 3))

    def scan(self, text, ranges, o):
        found = numbers.spans(text, self.raw)
        text = S.swapped(text)
        out, last, pairs, at = "", "", [], 0
        free, pending, failed = -1, -1, -1

        def word(said):
            nonlocal out, last
            ends = ("\n", "\t", ". ", '"', "'", "? ", "! ", '." ', '?" ', '!" ', ": ")
            new = S.capital(said) if last.endswith(ends) else said if last.endswith((" ", "(")) else " " + said
            if said[:1] in ("", ",", ".", "?", "!") and out.endswith(" "):
                out = out[:-1]
            out, last = out + new, new

        def raw(said):
            nonlocal out, last
            out, last = out + said, last + said

        def source(size):
            begin = min(s for s, _ in ranges[at : at + size])
            return begin, max(s + n for s, n in ranges[at : at + size]) - begin

        opened = lambda size: failed != at and free < at + size - 1 and at >= pending
        while at < len(text):
            window, said, taken = min(o.scan, len(text) - at), None, 0
            least = found[at][0] if at in found else 1
            line = len(re.match(r"[^\n\t]*", text[at : at + window])[0]) if opened(window) else 0
            for size in range(window, least - 1, -1):
                part = text[at : at + size]
                if part in self.phrases:
                    if self.accepts(text, at, size, o):
                        said, taken = self.phrases[part], size
                elif 2 < size <= line and opened(size):
                    m = self.best(part)
                    if m:
                        pending = at + m.index
                        if not m.index and ("{n}" in m.key or m.length < 2 or part[: m.length] in self.names or not self.hides(text, at, m.length, self.names, 1)):
                            filled = self.render(part[: m.length], m)
                            said, taken = (None, 0) if filled is None else (filled.strip(), m.length)
                    else:
                        pending, free, failed, wide = at - 1, at + size - 1, at, 100
                        while at + wide < len(text) and text[at + wide - 1] in self.readings:
                            wide += 1
                        if at + wide <= len(text) and self.best(text[at : at + wide]) is None:
                            free = at + wide - 1
                    if said is None and not opened(size - 1):
                        line = 0
                if said is not None:
                    break
            if said is None and at in found and (said := numbers.phrase(found[at][1])) is not None:
                taken = found[at][0]
            if said is not None:
                said = f"[{said}]" if o.wrap else said
                word(said)
                pairs.append((source(taken), (max(0, u16(out) - u16(said)), u16(said))))
                if text[at + taken : at + taken + 1] in self.readings:
                    raw(" ")
                at += taken
                continue
            c, after, start = text[at], text[at + 1 : at + 2], u16(out)
            said = c
            if c in self.readings:
                said = f"[{self.readings[c]}]" if o.wrap else self.readings[c]
                word(said)
                if after in self.readings:
                    raw(" ")
            elif c in "\"'" and not last.endswith((" ", ".", "?", "!", "\t")) and after not in ("", " ", ","):
                raw(" " + c)
            else:
                decimal = c == "." and re.match("[0-9]", text[at - 1 : at]) and re.match("[0-9]", after)
                raw(c + " " * (c in ".?!" and after not in ("", " ", '"', "'") and not decimal))
            pairs.append((source(1), (start, u16(said))))
            at += 1
        return out, pairs


def prepared(rules):
    out = []
    for family, pattern, place, first in (("noun", R.noun_pattern, "{n}", R.measure), ("number", R.number_pattern, "{s}", lambda key: 0)):
        own = sorted((k for k in rules if place in k), key=lambda k: (-first(k), -len(k), k))
        out += [{"rank": i, "family": family, "key": k, "value": rules[k], "pattern": pattern(k), "literals": R.literals(k), "anchor": R.anchor(k)} for i, k in enumerate(own)]
    return out


TEMPLATES = {
    "很{n}好": "ở {n}", "{n}红甲": "{n} mặc", "乙{s}中": "thứ {s}", "在[了]?{n}(身后|后)": "sau {n}", "{s}两": "{s} lượng", "百分[之]?{s}": "{s}%", "{s}年{s}月{s}号": "ngày {3} tháng {2} năm {1}",
    "第{s}(更|章)": "chương {s}:", "{s}多人": "hơn {s}", "比{n}[更]?快": "hơn {n}", "{s}分之{s}": "{2}/{1}", "[甲乙]{n}": "với {n}", "中?{n}身(后|前)": "lưng {n}", "{s}. 第{s}章": "{1}.{2}",
}


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rnd = random.Random(seed)
    letters = "他很好红中人甲乙"
    for _ in range(60):
        text = "".join(rnd.choice(letters + "在身后第章百分之年月号多两一二三四12 .,\"'!\n\t(x比快😀") for _ in range(rnd.randint(0, 130)))
        for _ in range(rnd.randint(0, 5)):
            key = re.sub(r"\[(.)[^]]*\]\??|\(([^|)]*)[^)]*\)\??|中\?", r"\1\2", rnd.choice(list(TEMPLATES)))
            at = rnd.randint(0, len(text))
            text = text[:at] + key.replace("{n}", rnd.choice(("他", "甲乙"))).replace("{s}", rnd.choice(("三", "12", "二十", "三四万"))) + text[at:]
        some = lambda n, most: {"".join(rnd.choice(letters + "一x") for _ in range(rnd.randint(1, most))): rnd.choice(("ab", "Tam 😀", "", ", c")) for _ in range(n)}  # noqa: B023, E731
        raw, names = some(25, 5), some(4, 3)
        slots = {"phrases": raw | names, "names": names, "raw": raw, "nouns": some(3, 2) | {"他": "hắn"}, "surnames": some(2, 2), "suffixes": some(3, 3)}
        readings = {c: rnd.choice(("ba", "")) for c in letters + "在身后第章"}
        rows = prepared(dict(rnd.sample(sorted(TEMPLATES.items()), rnd.randint(0, len(TEMPLATES)))))
        options = S.Options(scan=rnd.choice((30, 8)), algorithm=rnd.randint(0, 2), names_first=rnd.random() < 0.5, wrap=rnd.random() < 0.2)
        x = normal.Aligned(text)
        said, source, target = S.scan(x, S.Lexicon.of(readings=readings, rules=rows, **slots), options)
        assert (said, list(zip(zip(*source, strict=True), zip(*target, strict=True), strict=True))) == Plain(rows, readings, **slots).scan(text, x.ranges, options)


def _catalogue():
    one = lambda d: {k: v.split("/")[0] for k, v in d.items()}
    return Plain(prepared(C.GRAMMAR), C.READINGS, one(C.PHRASES) | C.NAMES, C.NAMES, C.PHRASES, C.NAMES | C.NOUNS, C.SURNAMES, C.SUFFIXES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_queries(spark):
    plain, known = _catalogue(), normal.tables(("", ""), C.READINGS)
    scripted = {r.doc_id: r.text for r in C._script(spark, FOLDER).where("doc_id % 4 = 1").collect()}
    got = {r.doc_id: (r.translated, r.n_spans) for r in C.translate_documents(spark, FOLDER).collect()}
    for doc, text in scripted.items():
        x = normal.standardize(text or "", *known)
        said, pairs = plain.scan(x.text, x.ranges, S.Options())
        assert got[doc] == (said, len(pairs)), doc
    turns = {r.doc_id: r.text for r in C._turns(spark, FOLDER).distinct().collect()}
    ranges: dict = {}
    for r in C.translate_ranges(spark, FOLDER).orderBy("doc_id", "nth").collect():
        ranges.setdefault(r.doc_id, []).append(((r.start, r.length), (r.said_at, r.said_length)))
    rules = {r.doc_id: (r["index"], r.length, r.key, r.rendered) for r in C.rule_best_match(spark, FOLDER).collect()}
    plain.phrases = C.PHRASES | C.NAMES
    for doc, text in turns.items():
        x = normal.standardize(text, *known)
        assert ranges.get(doc, []) == _catalogue().scan(x.text, x.ranges, S.Options())[1]
        m = plain.best(text)
        assert rules.get(doc) == (m and (m.index, m.length, m.key, plain.render(text[m.index : m.index + m.length], m)))


def test_dictionaries_of_any_size(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abcé中😀", k=rnd.randint(1, 9))) for _ in range(60_000)} | {"x" * K.LONGEST}
    frame = spark.createDataFrame([(w, f"<{w}>" if len(w) % 2 else "") for w in words] + [("", "empty"), (None, "null"), ("null", None), ("y" * (K.LONGEST + 1), "long")], "key string, value string")
    keys = K.mapped(K.written({"phrases": frame, "names": frame.where("char_length(key) = 3"), "raw": frame.limit(0)}))
    assert len(keys.mask) == len(words) and keys.astral
    for w in rnd.sample(sorted(words), 400):
        assert keys.get("phrases", w) == (f"<{w}>" if len(w) % 2 else "") and keys.has("names", w) == (len(w) == 3) and not keys.has("raw", w)
        assert (w + "q" in words) == keys.has("phrases", w + "q")
    text = "".join(rnd.choices("abcé中😀z", k=3000)) + "x" * (K.LONGEST + 3)
    start, length, record = keys.find(normal.points(text))
    want = sorted((n, i) for i in range(len(text)) for n in (*range(1, 10), K.LONGEST) if i + n <= len(text) and text[i : i + n] in words)
    assert list(zip(length.tolist(), start.tolist(), strict=True)) == want
    assert all(keys.value("phrases", r) == (f"<{text[i : i + n]}>" if n % 2 else "") for i, n, r in zip(start.tolist(), length.tolist(), record.tolist(), strict=True))
    empty = K.mapped(K.written({"phrases": frame.limit(0)}))
    assert not len(empty.find(normal.points("abc"))[0]) and empty.get("phrases", "a") is None
