"""The scan's remembered words: keys that hold blanks or line feeds, numbers over blanks, rules far from each other."""

import random

import pytest
from test_scan_plain import TEMPLATES, Plain, prepared

from phrasewright.functions import normal
from phrasewright.operators import rules as R
from phrasewright.operators import scan as S
from phrasewright.plans import catalogue as C


def _lexicon():
    first = {k: v.split("/")[0] for k, v in C.PHRASES.items()}
    return S.Lexicon.of(readings=C.READINGS, rules=prepared(C.GRAMMAR), phrases=first | C.NAMES, names=C.NAMES, raw=C.PHRASES, nouns=C.NAMES | C.NOUNS, surnames=C.SURNAMES, suffixes=C.SUFFIXES)


@pytest.mark.parametrize("among", ["", " ", "\n", "."])
def test_words_and_what_reaches_over_them(among):
    rnd, letters = random.Random(len(among) + ord(among or "x")), "他很好红中人甲乙丁"
    some = lambda n, most: {"".join(rnd.choice(letters + 2 * among) for _ in range(rnd.randint(1, most))): rnd.choice(("ab", "Tam 😀", "", ", c", "ß")) for _ in range(n)}
    rules = dict(TEMPLATES) | {"红 {n} 好": "r {n}", "好{n}人甲": "h {n}", "乙{s}丁": "d {s}"}
    for _ in range(25):
        raw, names = some(25, 5), some(4, 3)
        slots = {"phrases": raw | names, "names": names, "raw": raw, "nouns": some(3, 2) | {"他": "hắn"}, "surnames": some(2, 2), "suffixes": some(3, 3)}
        readings = {c: rnd.choice(("ba", "ba", "")) for c in letters}
        rows, options = prepared(dict(rnd.sample(sorted(rules.items()), rnd.randint(0, 6)))), S.Options(scan=rnd.choice((30, 8)), algorithm=rnd.randint(0, 2), wrap=rnd.random() < 0.2)
        lex, plain = S.Lexicon.of(readings=readings, rules=rows, **slots), Plain(rows, readings, **slots)
        words = ["".join(rnd.choice(letters + "bg一二3万余") for _ in range(rnd.randint(1, 6))) + rnd.choice(("", "", "", ".", ",", "\"")) for _ in range(20)]
        for _ in range(3):
            text = "".join(rnd.choice(words) + rnd.choice(("  ", "\n", "\t", " ", " ", " ")) for _ in range(40)) + rnd.choice(("", rnd.choice(words)))
            x = normal.Aligned(text)
            said, source, target = S.scan(x, lex, options)
            assert (said, list(zip(zip(*source, strict=True), zip(*target, strict=True), strict=True))) == plain.scan(text, x.ranges, options)
            assert S.scan(x, lex, options, ranges=False) == (said, (len(source[0]),), (len(target[0]),))


def test_a_rule_far_away_is_not_looked_for_at_each_place(monkeypatch):
    looked, best = [], R.Places.best
    monkeypatch.setattr(R.Places, "best", lambda self, at, end: looked.append(at) or best(self, at, end))
    text = ("中人bg 丁红v 好红 " * 40 + "很他好 ") * 20
    assert S.scan(normal.Aligned(text), _lexicon(), S.Options(), ranges=False)[0].count("ở chỗ hắn") == 20
    assert len(looked) <= 200


def test_known_words_are_not_walked_again(monkeypatch):
    walked, word = [], S._Line.word
    monkeypatch.setattr(S._Line, "word", lambda self, *x: walked.append(x) or word(self, *x))
    lex, text = _lexicon(), "他红 丁好bg 中人.\n" * 300
    S.scan(normal.Aligned(text), lex, S.Options(), ranges=False)
    assert len(walked) <= 60


def test_normal_text_without_ranges():
    rnd = random.Random(7)
    for ignored in ((), ("他 b", "红")):
        known = normal.tables(("x", "他"), C.READINGS, ignored)
        for _ in range(200):
            text = "".join(rnd.choice(C.SCRIPT + "  .,;!?\"'(bx\n\r\t12３：，。》&#65;“”…😀\x07") for _ in range(rnd.randint(0, 80)))
            assert normal.standardize(text, *known, ranges=False).text == normal.standardize(text, *known).text
