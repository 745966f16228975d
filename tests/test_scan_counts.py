"""The scan without ranges, its remembered chains of words, and where rules are tried at all."""

import random

from phrasewright.functions import normal
from phrasewright.operators import rules as R
from phrasewright.operators import scan as S
from phrasewright.plans import catalogue as C

RULES = [
    {"rank": 0, "family": "noun", "key": "很{n}好", "value": "ở {n}", "pattern": R.noun_pattern("很{n}好"), "literals": R.literals("很{n}好"), "anchor": R.anchor("很{n}好")},
    {"rank": 0, "family": "number", "key": "乙{s}丁", "value": "thứ {s}", "pattern": R.number_pattern("乙{s}丁"), "literals": R.literals("乙{s}丁"), "anchor": R.anchor("乙{s}丁")},
]


def _lexicon(rules=RULES):
    first = {k: v.split("/")[0] for k, v in C.PHRASES.items()}
    return S.Lexicon.of(readings=C.READINGS, rules=rules, phrases=first | C.NAMES, names=C.NAMES, raw=C.PHRASES, nouns=C.NAMES | C.NOUNS)


def test_counts_are_those_of_ranges():
    rnd, lex = random.Random(5), _lexicon()
    for _ in range(150):
        text = "".join(rnd.choice(C.SCRIPT + "  .,\"'x\n😀") for _ in range(rnd.randint(0, 300)))
        x = normal.standardize(text, *normal.tables(("", ""), C.READINGS))
        said, source, target = S.scan(x, lex, S.Options())
        assert S.scan(x, lex, S.Options(), ranges=False) == (said, (len(source[0]),), (len(target[0]),))


def test_remembered_chains_change_nothing(monkeypatch):
    rnd, lex = random.Random(6), _lexicon()
    words = ["".join(rnd.choice(C.SCRIPT) for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    texts = [" ".join(rnd.choice(words) + rnd.choice(("", "", ",", ".")) for _ in range(60)) for _ in range(40)]
    shown = lambda lex: [(said, [list(map(int, x)) for x in (*a, *b)]) for said, a, b in (S.scan(normal.Aligned(t), lex, S.Options()) for t in texts)]
    got = shown(lex)
    assert lex.chains[S.Options()]
    monkeypatch.setattr(S, "_CHAIN", 0)
    assert got == shown(_lexicon())


def test_rules_are_tried_only_around_known_nouns_and_fitting_numbers():
    lex = _lexicon()
    places = lambda text: R.Places(lex.matcher, text, normal.points(text), lex.keys.find(normal.points(text)))
    assert not places("很红好甲很人中好乙红丁他很中" * 20)
    found = places("很红好很他好乙一丁")
    assert (found.start, found.end) == ([3, 6], [6, 7])
    assert found.best(3, 6).key == "很{n}好" and found.best(6, 9).key == "乙{s}丁" and found.best(0, 3) is None


def test_templates_that_the_filters_leave_alone():
    assert R.beside("{n}比{n}") is None and R.beside("[甲乙]{n}") is None and R.beside("很了?{n}") is None and R.beside("很了{n}(好|人)") == ("很了", "")
    assert R.starting("{s}两") is None and R.starting(r"{s}\b丁") is None and R.starting("{s}(?!丁)") is None
