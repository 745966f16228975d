"""The language model of the quality classifier against a plain one, other scripts, and texts that repeat themselves."""

import collections
import math
import random
import re

import pytest

from phrasewright.llm import kneser_ney


def _texts():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("aeinrst", k=rnd.randint(1, 4))) for _ in range(40)] + ["Дом", "мир", ".", "!"]
    return [" ".join(rnd.choices(vocabulary, weights=range(44, 0, -1), k=rnd.randint(1, 60))) for _ in range(60)] + ["кот и пёс", "漢字漢字 漢漢", "a a a a b", "zq", ". . ."]


def _plain_symbols(text):
    out, last, gap = [], None, []
    for part in re.findall(r"[^\W一-鿿]+|[\W一-鿿]", text):
        if re.match(r"[^\W一-鿿]", part):
            out += [*([] if part == last and not "".join(gap).strip() else gap), *(["<same>"] if part == last else part)]
            last, gap = part, []
        else:
            gap.append(part)
    return out + gap


def _plain_model(taught):
    """p(context, symbol): the same model by dictionaries."""
    counts = collections.Counter()
    for t in taught:
        w = ["<s>"] * 4 + _plain_symbols(t)
        counts.update(tuple(w[i - 4 : i + 1]) for i in range(4, len(w)))
    levels = {5: counts}
    for k in (4, 3, 2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    cut, free, total = {}, collections.Counter(), collections.Counter()
    for k, level in levels.items():
        n = [sum(c == i for c in level.values()) for i in range(5)]
        d = [0.5, 1.0, 1.5]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            d = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
        d = [min(max(x, 0.01 * i), 0.99 * i) for i, x in enumerate(d, 1)]
        for g, c in level.items():
            cut[g] = min(c, d[min(c, 3) - 1])
            free[k, g[:-1]] += cut[g]
            total[k, g[:-1]] += c

    def p(context, symbol):
        k = len(context) + 1
        below = p(context[1:], symbol) if context else 1 / (len(levels[1]) + 1)
        if not total[k, context]:
            return below
        g = (*context, symbol)
        return (levels[k][g] - cut.get(g, 0)) / total[k, context] + free[k, context] / total[k, context] * below

    return p, levels


def test_model_against_plain(spark):
    texts, hot = _texts(), kneser_ney.HOT
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(900, None, 1, 2), (901, "", 1, 2), (0, texts[0], 1, 2)], "doc_id long, text string, __row int, `a.b` int")
    taught = docs.where("doc_id < 50")
    p, levels = _plain_model([*texts[:50], texts[0]])
    symbols = [x for (x,) in levels[1]]
    assert abs(sum(p(("<s>",) * 4, x) for x in symbols) + p(("<s>",) * 4, "unseen") - 1) < 1e-9
    model = kneser_ney.train(taught)
    try:
        for kneser_ney.HOT in (0, 20, hot):
            got = kneser_ney.score(docs, model).collect()
            assert len(got) == docs.count() and all(r["__row"] == 1 and r["a.b"] == 2 for r in got)
            for r in got:
                if r.doc_id >= 900:
                    assert r["__perplexity"] is None
                    continue
                w = ["<s>"] * 4 + _plain_symbols(r.text)
                bits = -sum(math.log2(p(tuple(w[i - 4 : i]), w[i])) for i in range(4, len(w)))
                size = sum(x != "<same>" for x in w[4:])
                assert abs(bits / size - math.log2(r["__perplexity"])) < 1e-9, r.text
    finally:
        kneser_ney.HOT = hot


def test_other_scripts_and_growth(spark):
    rnd, letters = random.Random(5), "абвгдежзиклмнопрст"
    known = ["".join(rnd.choices(letters, k=4)) for _ in range(60)]
    strange = ["".join(rnd.choices(letters, k=4)) for _ in range(400)]
    rows = [(i, " ".join(rnd.choices(known, k=40))) for i in range(300)] + [(1000 + i, " ".join(rnd.sample(strange, 40))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, None if i % 3 == 0 else "ru") for i, t in rows], "doc_id long, text string, lang string").selectExpr("*", "1 as __keep", "2 as __lang", "3 as __perplexity")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(280)], "doc_id long, quality int, toxic int")
    rows = kneser_ney.classify(docs, labels).collect()
    got = {r.doc_id: r["__keep"] for r in rows}
    assert not any(got[1000 + i] for i in range(20)) and sum(got[i] for i in range(300)) >= 290 and all(r["__lang"] == 2 for r in rows)
    few, many = (kneser_ney.train(docs.where(f"doc_id < {n}"))[0].count() for n in (5, 20))
    assert many > 1.5 * few


def test_limit_is_the_quantile(spark):
    rows = [(i, "a" if i % 3 else None, float(i)) for i in range(1, 301)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, __perplexity double")
    got = {(r.lang, r.every): r.limit for r in kneser_ney.thresholds(scored).collect()}
    assert got == {("a", False): 296.0, (None, False): 297.0, (None, True): 297.0}


def test_repeated_words_are_rejected(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("aeinrst", k=rnd.randint(2, 6))) for _ in range(300)]
    draw = lambda n: rnd.choices(vocabulary, weights=[1 / k for k in range(1, 301)], k=n)
    good = [(i, " ".join(draw(60))) for i in range(300)]
    poor = [(1000 + i, " ".join(w for w in draw(6) for _ in range(15))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in good + poor], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(280)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r["__keep"] for r in kneser_ney.classify(docs, labels).collect()}
    assert not any(got[i] for i, _ in poor) and sum(got[i] for i, _ in good) >= 290


def test_text_slices_hand_out_every_text_once():
    import pyarrow as pa

    from phrasewright.llm.common import text_slices

    texts = ["ab", None, "", "x" * 50, "😀é", "c"] * 3
    for kind in (pa.string(), pa.large_string()):
        for budget in (1, 5, 1000):
            out = list(text_slices(pa.array(texts, kind), budget))
            assert [t for _, some in out for t in some] == [t or "" for t in texts]
            assert all(some == [t or "" for t in texts[a : a + len(some)]] for a, some in out)
    assert list(text_slices(pa.array([], pa.string()), 5)) == []


def test_query_with_and_without_the_join(spark, monkeypatch):
    import os

    from phrasewright.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    whole = {r.doc_id: r for r in queries.op8_kneser_ney(spark, folder).collect()}
    joined, sent = [], kneser_ney.sent_to_tasks
    monkeypatch.setattr(kneser_ney, "HOT", 3000)
    monkeypatch.setattr(kneser_ney, "sent_to_tasks", lambda gains: joined.append((out := sent(gains))[1].count()) or out)
    for r in queries.op8_kneser_ney(spark, folder).collect():
        own = whole[r.doc_id]
        assert r.keep == own.keep and (r.perplexity is None) == (own.perplexity is None)
        assert r.perplexity is None or math.isclose(r.perplexity, own.perplexity, rel_tol=1e-9)
    assert joined and joined[0] > 3000


def test_honest_repetition_is_kept(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("aeinrst", k=rnd.randint(2, 6))) for _ in range(300)]
    draw = lambda n: rnd.choices(vocabulary, weights=[1 / k for k in range(1, 301)], k=n)
    # A song: every fifth text of the trusted ones and of the others says a word twice, once or twice in it.
    def song(i):
        words = draw(60)
        for at in rnd.sample(range(60), 1 + i % 2) if i % 5 == 0 else ():
            words[at] = f"{words[at]} {words[at]}"
        return " ".join(words)

    docs = spark.createDataFrame([(i, song(i), "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r["__keep"] for r in kneser_ney.classify(docs, labels).collect()}
    twice = [kept[i] for i in range(400, 600) if i % 5 == 0]
    assert sum(twice) >= 0.9 * len(twice) and sum(kept.values()) >= 580
