"""Readings, names and the overlap test in a translation."""

from phrasewright.operators import spans as S


def test_readings_names_and_overlap(spark):
    pairs = spark.createDataFrame([("d", i, k, v) for i, (k, v) in enumerate({"甲乙": "A", "乙丙丁": "B", "乙丙": "N", "甲": "C"}.items())], "dict string, line_no int, key string, value string")
    texts = spark.createDataFrame([(1, "甲乙丙丁"), (2, "甲乙人x"), (3, None)], "doc_id long, text string")
    names = pairs.where("key = '乙丙'")
    read = {"丙": "bính", "丁": "đinh", "人": "nhân"}
    got = lambda **k: {r.doc_id: r.translated for r in S.translated(texts, pairs, readings=read, **k).collect()}
    assert got() == {1: " A bính đinh", 2: " A nhânx", 3: ""}
    assert got(algorithm=0)[1] == " C B" and got(algorithm=2)[1] == " A bính đinh"
    assert got(names=names)[1] == " C B"
