"""Large groups of near copies against all pairs."""

from __future__ import annotations

import random

import pytest
from phrasewright.llm import common, dart_minhash


def _plain_classes(texts: dict[int, str], similarity: float) -> dict[int, int]:
    sets = {}
    for i, text in texts.items():
        words, seen = text.split(), {}
        for j in range(len(words) - 4):
            s = tuple(words[j : j + 5])
            seen[s] = seen.get(s, 0) + 1
        sets[i] = {(s, k) for s, n in seen.items() for k in range(n)}
    label = {i: i for i in texts}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in texts}


@pytest.mark.parametrize("rare", [0, 2, 8])
def test_group_of_near_copies(spark, monkeypatch, rare):
    monkeypatch.setattr(dart_minhash, "RARE", rare)
    monkeypatch.setattr(dart_minhash, "BLOCK", 2000)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(90):
        words = list(texts[rng.randrange(i)].split()) if i and rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["common", f"own{rng.randrange(100_000)}"])
        texts[i] = " ".join(words)
    got = dart_minhash.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == _plain_classes(texts, 0.8)


def test_plans_stay_small(spark, monkeypatch):
    """A plan begins all its shuffles at once, and the driver keeps the tables of all its joins: so each plan has few of them, and
    no job only asks whether a table has rows."""
    plans, counted, settle, count = {}, [], common.settle, type(spark.range(1)).count

    def looked(df, tag):
        df.createOrReplaceTempView("looked")
        plan = spark.sql("EXPLAIN EXTENDED SELECT * FROM looked").first()[0]
        plan = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        plans[tag] = max(plans.get(tag, 0), sum(x.lstrip(" :+-").startswith("Join") for x in plan.splitlines()))
        return settle(df, tag)

    monkeypatch.setattr(dart_minhash, "settle", looked)
    monkeypatch.setattr(common, "settle", looked)
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: counted.append(df.columns) or count(df))
    rng = random.Random(3)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for i in range(90):
        words = texts[rng.randrange(i)][1].split() if i and rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["common", f"own{rng.randrange(100_000)}"])
        texts.append((i, " ".join(words)))
    dart_minhash.one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert "placed" in plans and max(plans.values()) <= 4, plans
    assert counted in ([], [["h"]]), counted


@pytest.mark.parametrize("texts", [[], [(1, None), (2, "")], [(1, "one two three four five six"), (2, "other words that are in no other text")]])
def test_observed_tables_without_rows(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in dart_minhash.one_of_each(docs).collect()) == [i for i, _ in texts]
    got, seen = common.observed(docs.where("doc_id < 0").join(docs.select("doc_id"), "doc_id"), "none", rows=common.F.count(common.F.lit(1)))
    assert seen == {"rows": 0} and got.isEmpty()
