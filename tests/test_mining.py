"""The name filter on the facts known of it."""

from pyspark.sql import functions as F

from phrasewright.operators import mining as M
from phrasewright.operators import names as N

READINGS = dict(萧="tiêu", 炎="viêm", 林="lâm", 动="động", 冷="lãnh", 涯="nhai", 郡="quận", 姜="khương", 太="thái", 阿="a", 转="chuyển", 身="thân", 来="lai", 人="nhân", 名="danh", 为="vi", 走="tẩu", 士="sĩ", 兵="binh", 释="thích", 帝="đế", 书="thư", 看="khán", 见="kiến", 到="đáo")


def _tables(spark, **given):
    kinds = ("surnames", "nouns", "suffixes", "names", "raw", "phrases", "readings")
    make = lambda entries: spark.createDataFrame(list(entries.items()), "key string, value string")
    return {k: make(given.get(k, READINGS if k == "readings" else {})) for k in kinds}


def _texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def _inside():
    return "[" + "".join(READINGS) + "]"


def test_hybrid(spark):
    tables = _tables(spark, surnames={"萧": "Tiêu", "姜": "Khương"}, raw={"太阿": "Thái A/thanh kiếm", "来人": "người tới"})
    texts = _texts(spark, "来人名为萧炎。", "姜太阿转身。", "林动走来。", "萧炎见到了萧炎。", "", None)
    known = spark.createDataFrame([("林动", "Lâm Động")], "key string, value string")
    got = {(r.doc_id, r.word): r for r in M.hybrid(texts, tables, _inside(), known=known, least=1).collect()}
    assert got[0, "萧炎"].suggested == "Tiêu Viêm" and got[0, "萧炎"].entity_type == "person" and got[0, "萧炎"].n == 1
    assert got[1, "姜太阿"].suggested == "Khương Thái A"
    assert got[2, "林动"].known and got[2, "林动"].score == 1.0
    assert not any(word == "来人" for _, word in got)
    rejected = spark.createDataFrame([("萧炎",)], "key string")
    assert not [r for r in M.hybrid(texts, tables, _inside(), rejected=rejected, least=1).collect() if r.word == "萧炎"]


def test_local(spark):
    tables = _tables(spark, nouns={"郡": "{0} quận"})
    texts = _texts(spark, "冷涯郡士兵。", "看着《释帝书》。")
    tokens = spark.createDataFrame([(0, 0, "冷涯"), (0, 2, "郡"), (0, 3, "士兵")], "doc_id int, start int, word string")
    got = {(r.doc_id, r.word): r for r in M.local(texts, tokens, tables, least=1).collect()}
    assert got[0, "冷涯郡"].suggested == "Lãnh Nhai quận"
    assert (1, "《 释帝书 》") in got and (0, "士兵") not in got


def test_parts(spark):
    words = spark.createDataFrame([(1, "药老人"), (1, "药"), (1, "老药老"), (1, "药老")], "doc_id int, word string")
    names = spark.createDataFrame([("药老", "x"), ("老药老鬼", "x")], "key string, value string")
    surnames = spark.createDataFrame([("老", "x")], "key string, value string")
    assert {r.word for r in M.part_of_names(words, names, surnames).collect()} == {"药老人", "药老", "老药老"}
    texts = spark.createDataFrame([(1, "甲乙甲丙")], "doc_id int, text string")
    chain = N.chained(spark.createDataFrame([(1, "甲乙甲丙")], "doc_id int, word string"), spark.createDataFrame([("甲乙甲",)], "key string"), texts)
    assert chain.count() == 0
    texts = spark.createDataFrame([(1, "甲乙甲乙甲丙")], "doc_id int, text string")
    assert N.chained(spark.createDataFrame([(1, "甲乙甲丙")], "doc_id int, word string"), spark.createDataFrame([("甲乙甲",)], "key string"), texts).count() == 1


def test_contexts(spark):
    row = spark.range(1).select(N.contexts(F.lit("a the b the c the d the e"), F.lit("the"), 3).alias("x"), N.places(F.lit("aaaaa.b"), F.lit("aa")).alias("p"), N.contexts(F.lit("none"), F.lit("the")).alias("n")).first()
    assert row.x == ["a 【the】 b ", " b 【the】 c ", " c 【the】 d "] and row.p == [1, 3] and row.n == []


def test_decisions(spark):
    found = spark.createDataFrame([(1, "a", 0.5, False, 1), (1, "b", 0.5, False, 2), (1, "c", 0.9, False, 3)], "doc_id int, word string, score float, known boolean, rank int")
    assert [r.word for r in M.review_selection(found, 1).collect()] == ["a"]
    told = spark.createDataFrame([(1, "a", False, 0.9, 1), (1, "a", True, 0.8, 2), (1, "b", False, 0.7, 1), (1, "c", False, 0.1, 1)], "doc_id int, word string, accept boolean, confidence double, pos int")
    assert {r.word: round(r.score, 3) for r in M.decided(found, told).collect()} == {"a": 0.9, "c": 0.9}
    entities = spark.createDataFrame([(1, " x ", 2.0, 1), (1, "x", 0.1, 2), (1, " ", 0.5, 3)], "doc_id int, word string, confidence double, pos int")
    assert [(r.word, r.confidence) for r in M.sanitised_entities(entities).collect()] == [("x", 1.0)]
