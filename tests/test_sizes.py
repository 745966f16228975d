"""What must not grow with the tables: sides of joins that are sent whole, rows that an explode makes, groups held in memory."""

from __future__ import annotations

import time

from phrasewright.functions import normal
from phrasewright.operators import dictionaries as D
from phrasewright.operators import mining as M
from phrasewright.operators import keys as K
from phrasewright.operators import segment as G
from phrasewright.operators import spans as S


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_look_up_sends_no_side_whole(spark, tmp_path):
    spark.createDataFrame([(i, f"ab c{i % 3}") for i in range(50)], "id long, text string").write.parquet(str(tmp_path / "t"))
    pairs = spark.createDataFrame([("ab", "x\\ny"), ("c", "z"), ("ab c1", "w")], "key string, value string")
    found = D.look_up(spark.read.parquet(str(tmp_path / "t")), pairs)
    assert "Broadcast" not in _plan(found)
    rows = [(r.pos, r.source, r.definition) for r in found.where("id = 1").orderBy("pos").collect()]
    assert rows == [(0, "ab c1", "w"), (3, "ab", "x\ny"), (7, "c", "z")] and found.count() == 50 * 2 + 17


def test_longest_match_holds_no_group(spark):
    texts = spark.createDataFrame([(1, "abcabab"), (2, ""), (3, None), (4, "xcx")], "doc_id long, text string")
    pairs = spark.createDataFrame([("ab", "1"), ("ab", "2"), ("abc", "3"), ("bab", "4"), ("ca", "5")], "key string, value string")
    found = S.longest(texts, pairs)
    assert "Aggregate" not in _plan(found) and "Exchange" not in _plan(found)
    assert [(r.doc_id, r.start, r.length, r.value) for r in found.orderBy("doc_id", "start").collect()] == [(1, 0, 3, "3"), (1, 3, 2, "2"), (1, 5, 2, "2")]
    picked = S.chosen(S.candidates(texts, pairs)).collect()
    assert [(r.doc_id, [tuple(p) for p in r.picked]) for r in picked] == [(1, [(0, 3, "3"), (3, 2, "2"), (5, 2, "2")])]


def test_triggers_in_proportion_to_a_text(spark):
    """Without a word that introduces a name, the text was read again from each of its characters."""
    long = "甲乙 " * 100_000
    texts = spark.createDataFrame([(1, long), (2, "我叫甲乙名字叫丙，叫叫"), (3, None), (4, long + "自称")], "doc_id long, text string")
    began = time.time()
    assert [tuple(r) for r in M.triggered(texts).orderBy("doc_id", "start").collect()] == [(2, 2), (2, 7), (2, 10), (2, 11), (4, 300_002)]
    assert time.time() - began < 40


def test_part_of_names_looks_each_word_up_once(spark):
    """Pieces were cut from a word again for each document that has it."""
    words = spark.createDataFrame([(d, w) for d in range(50) for w in ("other", "th", "x", "ab")], "doc_id long, word string")
    names = spark.createDataFrame([("the",), ("the",), ("o",)], "key string")
    found = M.part_of_names(words, names, names.limit(0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode(array_distinct") :]
    assert "doc_id" not in below[below.index("Aggregate [") :].splitlines()[0] and sorted({(r.doc_id, r.word) for r in found.collect()}) == [(d, w) for d in range(50) for w in ("other", "th")]


def test_refiltered_makes_rows_of_held_words_alone(spark):
    listed = spark.createDataFrame([(1, "甲乙"), (1, "甲乙丙丁"), (1, "丁丙甲乙"), (1, "甲乙"), (2, "甲乙")], "doc_id long, word string")
    texts = spark.createDataFrame([(1, "甲乙 甲乙"), (2, "甲乙 甲乙 甲乙")], "doc_id long, text string")
    some = spark.createDataFrame([("甲", "giáp"), ("乙", "ất")], "key string, value string")
    found = M.refiltered(listed, texts, {"names": some, "surnames": some.limit(0), "nouns": some.limit(0), "readings": some})
    assert [(r.doc_id, r.word, r.n, r.listed) for r in found.orderBy("doc_id").collect()] == [(1, "甲乙", 2, 4), (2, "甲乙", 3, 1)]


def test_references_are_decoded_without_python(spark):
    said = "&#0;|&#65;&#x41;&#X000041;|&#xFEFF;|&#x10FFFF;&#x110000;&#xDFFF;|&#99999999999999999999;|&#0000000000065;|&amp;amp;|&lt;&quot;&&lt;|&#;&x"
    df = spark.createDataFrame([(said,), (None,), ("",), ("&copy;",), ("a&b",)], "text string")
    for legacy, names in ((True, normal.LEGACY), (False, normal.name2codepoint)):
        found = df.select("text", normal.decoded_entities("text", legacy).alias("x"))
        assert "Python" not in _plan(found) and "ArrowEval" not in _plan(found)
        for r in found.collect():
            assert r.x == (None if r.text is None else normal._ENTITY.sub(lambda m: normal.entity(m, names) or m[0], r.text))  # noqa: B023


def test_segments_of_a_piece_are_cut_once():
    words = {"甲乙": "9", "乙丙": "4", "甲": "2", "\n甲": "50", "丁丁": "3"}
    whole, own = (G.Segmenter(K.Keys.of(words=words), 68.0, None, inside="甲乙丙丁") for _ in range(2))
    texts = ["甲乙丙 ab甲乙丙12.5%,丁丁", "", "  甲乙丙\n\n甲 x", "甲乙丙" * 20 + " 甲乙丙", "\x1c甲　甲乙丙 "]
    asked, cut = [], own.tokens
    own.tokens = lambda t: asked.append(t) or cut(t)
    for _ in range(2):
        row, start, word = own.columns(texts)
        assert list(zip(row.tolist(), start.tolist(), word.to_pylist(), strict=True)) == [(i, s, w) for i, t in enumerate(texts) for s, w in whole.tokens(t)]
    assert asked[0].split("\n").count("甲乙丙") == 1 and asked[1:] == ["甲乙丙" * 20, ] and not len(own.columns([])[0])
