"""Facts about single operators on tiny tables."""

from pyspark.sql import functions as F

from phrasewright.functions import text as X
from phrasewright.operators import dictionaries as D
from phrasewright.operators import names as N
from phrasewright.operators import paragraphs as P
from phrasewright.operators import spans as S
from phrasewright.sources import files


def _one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def _pairs(spark, *entries):
    return spark.createDataFrame([("d", i, k, v) for i, (k, v) in enumerate(entries)], "dict string, line_no int, key string, value string")


def test_parse_pairs(spark):
    lines = D.lines_of(spark.createDataFrame([("d", "﻿a=1\r\nb\nc=1=2\n#x=y\na=2\nk=")], "dict string, value string"))
    assert {(r.key, r.value) for r in D.parse_pairs(lines).collect()} == {("a", "1"), ("#x", "y"), ("a", "2"), ("k", "")}
    assert {(r.key, r.value) for r in D.first_wins(D.parse_pairs(lines)).collect()} == {("a", "1"), ("#x", "y"), ("k", "")}
    assert [r.key for r in D.parse_rules(lines).collect()] == ["a", "k"]


def test_key_cap(spark):
    pairs = _pairs(spark, ("字" * 16, "LONG"), ("字" * 15, "KEPT"))
    assert [r.value for r in D.scannable(pairs).collect()] == ["KEPT"]


def test_layers(spark):
    got = D.overlaid(_pairs(spark, ("a", "2")), _pairs(spark, ("a", "1"), ("b", "1"), ("b", "x")))
    assert {(r.key, r.value) for r in got.collect()} == {("a", "2"), ("b", "1")}


def test_look_up(spark):
    pairs = _pairs(spark, ("金美", "1"), ("金", "2\\n"), ("美", "3"), ("婷", "4"))
    rows = D.look_up(spark.createDataFrame([(1, " 金美婷 ")], "id int, text string"), D.first_wins(pairs)).orderBy("pos").collect()
    assert [(r.source, r.definition) for r in rows] == [("金美", "1"), ("金", "2\n"), ("美", "3"), ("婷", "4")]


def test_numerals(spark):
    cases = {"十": 10, "一百二十三": 123, "一二三": 123, "一亿二千三百四十五万六千七百八十九": 123456789, "": 0, "三万五": 35000}
    for text, value in cases.items():
        assert _one(spark, X.numeral_value(F.lit(text))) == value, text
    assert _one(spark, X.magnitude_text(F.lit(1234))) == "1,234"
    assert _one(spark, X.magnitude_text(F.lit(123456789))) == "1 ức 2,345 vạn 6,789"
    assert _one(spark, X.modifiers_last(F.lit("三余万五多百"))) == "三万余五百多"


def test_text(spark):
    assert _one(spark, X.normalized(F.lit("ＡＢＣ１２３，等等……"))) == "ABC123, 等等......"
    assert _one(spark, X.collapse_spaces(F.lit("a   b"))) == "a  b"
    assert _one(spark, X.utf16_length(F.lit("😀a"))) == 3
    assert _one(spark, X.title_words(F.lit("tiêu viêm xY"))) == "Tiêu Viêm XY"
    assert _one(spark, X.first_meaning(F.lit("rất tốt/rất ổn"))) == "rất tốt"
    assert _one(spark, X.pretty(F.lit("  tha rất"))) == "Tha rất"


def test_translation(spark):
    texts = spark.createDataFrame([(1, "他很好"), (2, "他。他"), (3, None), (4, "xyz"), (5, "")], "doc_id long, text string")
    pairs = _pairs(spark, ("他", "tha"), ("很好", "rất tốt"), ("很", "ngận"))
    got = {r.doc_id: (r.translated, r.n_spans) for r in S.translated(texts, pairs).collect()}
    assert got == {1: (" tha rất tốt", 2), 2: (" tha。 tha", 2), 3: ("", 0), 4: ("xyz", 0), 5: ("", 0)}


def test_sentence_starts():
    assert S.joined([("tha", True), (". ", False), ("tha", True)]) == " tha. Tha"


def test_names(spark):
    found = spark.createDataFrame([(1, "abc", 2, 0.5), (1, "ab", 3, 0.9), (1, "bc", 1, 0.9)], "doc_id int, word string, n int, score float")
    assert {r.word for r in N.pruned(found).collect()} == {"ab", "bc"}
    titles = N.titles(spark.createDataFrame([(1, "《甲》x《乙\n》《甲》")], "doc_id int, text string"))
    assert [r.title for r in titles.collect()] == ["甲"]
    yes, no = F.lit(True), F.lit(False)
    assert abs(_one(spark, N.hybrid_score(F.lit(1), yes, yes, no, no, no, no)) - 0.77) < 1e-6


def test_paragraphs(spark):
    answer = spark.createDataFrame([(1, "[[1]] Đoạn một.\n\n[[3]] Đoạn ba.")], "doc_id int, payload string")
    assert {(r.n, r.translated) for r in P.parsed_labels(answer).collect()} == {(1, "Đoạn một."), (3, "Đoạn ba.")}
    chunks = P.line_chunks(spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\n")], "doc_id int, text string"), 10).orderBy("chunk").collect()
    assert [c.text for c in chunks] == ["aaaa\nbbbb\n", "cccc\n"]


def test_natural_order(spark):
    names = spark.createDataFrame([("Chap10",), ("chap2",), ("Chap1",)], "name string").orderBy(files.natural_key("name"))
    assert [r.name for r in names.collect()] == ["Chap1", "chap2", "Chap10"]
