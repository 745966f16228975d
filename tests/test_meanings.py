"""Full meanings against a plain version."""

import random

from phrasewright.functions import numbers
from phrasewright.operators import meanings as W
from phrasewright.operators import rules as R

LISTS = {
    "phrases": {"他": "y/hắn", "他很": "nó rất", "很好": "tốt", "一二": "một hai", "好好好好好好好好好好好好好好好好好好好好好": "quá dài"},
    "names": {"他很好": "Tha", "红": "Hồng/Đỏ"},
    "names2": {"红": "Hồng phụ", "他": ""},
    "lookup": {"他": "✚[ta]\\n1. nó", "很": "rất/lắm"},
}
RULES = {"他{n}好": "ở {n} tốt", "{s}年": "năm {s}"}
NOUNS = {"红": "đỏ", "很": "rất"}


def _plain(text, rules):
    if not text:
        return [], "", 0
    cut, out, length = text[:20], [], 0
    line = cut
    for c in "余多":
        for unit in "百千万亿":
            line = line.replace(c + unit, unit + c)
    match = rules.best(line) if rules else None
    said = rules.render(line[: match.length], match) if match and match.index == 0 else None
    if said:
        out.append(("rule", line[: match.length], said))
        length = match.length
    else:
        found = numbers.spans(line).get(0)
        if found and found[1] not in LISTS["phrases"] and (said := numbers.phrase(found[1])):
            out.append(("number", line[: found[0]], said))
            length = found[0]
    for n in range(len(cut), 0, -1):
        for source in ("names2", "names", "phrases"):
            if cut[:n] in LISTS[source]:
                out.append((source, cut[:n], LISTS[source][cut[:n]].replace("/", "; ")))
                length = length or n
    for n in range(len(cut), 0, -1):
        if cut[:n] in LISTS["lookup"]:
            out.append(("lookup", cut[:n], LISTS["lookup"][cut[:n]]))
    if not out:
        return [], text[0] + W.RULED + W.NOTHING, 1
    return out, "".join(key + W.MARKS[source] + value + W.RULED for source, key, value in out), length or 1


def _tables(spark):
    return {name: spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs.items())], "line_no int, key string, value string") for name, pairs in LISTS.items()}


def test_like_plain(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("他很好红中一二三十年百万多") for _ in range(draw.randrange(1, 26))) for _ in range(300)] + [None, "", "?", "好" * 30, "他", "他", "十年", "一二", "多万", "他红好", "20年"]
    rows = R.prepared(spark.createDataFrame(list(RULES.items()), "key string, value string")).collect()
    given = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, head string")
    for rules in (None, R.Rules(rows)):
        got = {r.id: r for r in W.full_meanings(given, _tables(spark), rules).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            sections, said, length = _plain(t, rules)
            assert [(s.source, s.key, s.value) for s in got[i].sections] == sections, t
            assert (got[i].meanings, got[i].phrase_length, got[i].head) == (said, length, "kept"), t


def test_rules_with_nouns(spark):
    rows = R.prepared(spark.createDataFrame(list(RULES.items()), "key string, value string")).collect()
    rules = R.Rules.of(rows, nouns=NOUNS)
    match = rules.best("他红好人")
    assert (match.index, match.length, rules.render("他红好", match)) == (0, 3, "ở đỏ tốt")


def test_empty_tables(spark):
    none = {name: t.where("false") for name, t in _tables(spark).items()}
    texts = spark.createDataFrame([("他",)], "text string")
    assert [(r.meanings, r.phrase_length) for r in W.full_meanings(texts, none).collect()] == [("他" + W.RULED + W.NOTHING, 1)]
    assert W.full_meanings(texts.where("false"), _tables(spark)).count() == 0
