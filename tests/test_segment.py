"""Segmentation against a search of all paths and of all states."""

import itertools
import math
import random

import pytest

from phrasewright.operators import keys as K
from phrasewright.operators import segment as G


def _cuts(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        out, begin = [], 0
        for i, m in enumerate((*marks, 1)):
            if m:
                out.append(run[begin : i + 1])
                begin = i + 1
        yield out


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(1)
    return {"".join(rnd.choices("甲乙丙丁", k=rnd.randint(1, 4))): rnd.randint(1, 5000) for _ in range(40)} | {"甲": 900}


@pytest.fixture(scope="module")
def model(spark, words):
    return G.estimated(spark.createDataFrame(list(words.items()), "word string, n long"))


def test_best_path(words):
    total = sum(words.values())
    own = G.Segmenter(K.Keys.of(words={w: str(n) for w, n in words.items()}), total, None)
    weigh = lambda cut: sum(math.log(words.get(w, 1) / total) for w in cut)
    rnd = random.Random(2)
    for _ in range(150):
        run = "".join(rnd.choices("甲乙丙丁戊", k=rnd.randint(1, 9)))
        best = max(weigh(c) for c in _cuts(run) if all(w in words or len(w) == 1 for w in c))
        got = own.path(run)
        assert "".join(got) == run and all(w in words or len(w) == 1 for w in got) and math.isclose(weigh(got), best, rel_tol=1e-12)


def test_states(words, model):
    def weigh(states, run):
        if states[0] not in (G.BEGIN, G.ALONE) or states[-1] not in G.LAST or any(a not in G.BEFORE[b] for a, b in itertools.pairwise(states)):
            return -math.inf
        return model.start[states[0]] + sum(model.follow[p] for p in itertools.pairwise(states)) + sum(model.said.get(c, model.unseen)[s] for c, s in zip(run, states, strict=True))

    rnd = random.Random(3)
    for _ in range(60):
        run = "".join(rnd.choices("甲乙丙丁戊", k=rnd.randint(1, 6)))
        best = max(weigh(s, run) for s in itertools.product(range(4), repeat=len(run)))
        assert math.isclose(weigh(model.states(run), run), best, rel_tol=1e-12) and "".join(model.cut(run)) == run


def test_estimate(words, model):
    n = {s: 0 for s in range(4)}
    for w, k in words.items():
        for i in range(len(w)):
            n[G.ALONE if len(w) == 1 else G.BEGIN if i == 0 else G.END if i == len(w) - 1 else G.INSIDE] += k
    for s in range(4):
        seen = sum(math.exp(model.said[c][s]) for c in model.said)
        assert math.isclose(seen + math.exp(model.unseen[s]), 1.0) and math.isclose(math.exp(model.unseen[s]), 1 / (n[s] + len(model.said) + 1))
    for s in range(4):
        assert math.isclose(sum(math.exp(model.follow[s, t]) for t in range(4) if (s, t) in model.follow), 1.0)


def test_tokens_as_a_table(spark):
    words = spark.createDataFrame([("红中", 50), ("中人", 40), ("他", 9), ("甲乙", 30), ("丙丁", 30), (None, 5), ("", 5), ("无", 0)], "word string, n long")
    texts = spark.createDataFrame([(1, "他红中人 Hello 3.5%!"), (2, None), (3, ""), (4, "甲乙丙丁"), (5, "戊己"), (5, "戊己")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in G.segmented(texts, words).collect())
    by = lambda d: [w for i, _, w in rows if i == d]
    assert by(1) in (["他", "红中", "人", " ", "Hello", " ", "3.5%", "!"], ["他红", "中人", " ", "Hello", " ", "3.5%", "!"]) and by(4) == ["甲乙", "丙丁"]
    assert not by(2) and not by(3) and "".join(by(5)) == "戊己戊己"
    whole = {1: "他红中人 Hello 3.5%!", 4: "甲乙丙丁", 5: "戊己"}
    assert all(whole[i][s : s + len(w)] == w for i, s, w in rows)
    assert G.segmented(texts, words.limit(0)).where("doc_id = 4").count() >= 1 and G.segmented(texts.limit(0), words).count() == 0
