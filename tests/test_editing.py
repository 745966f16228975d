"""Dictionary files under edit, glossaries and layouts."""

import pytest
from pyspark.sql import functions as F

from phrasewright.operators import dictionaries as D
from phrasewright.operators import editing as E
from phrasewright.sources import files


def _files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "dict string, value string")


def _one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_round_trip(spark):
    given = _files(spark, a="﻿k=v\r\nraw\r\n=x\r\nb=1=2\r\n", b="x=1\n\ny=2", c="")
    found, marks = E.records(given), E.documents(given)
    assert {r.dict: r.value for r in E.serialised(found, marks).collect()} == {"a": "﻿k=v\r\nraw\r\n=x\r\nb=1=2\r\n", "b": "x=1\n\ny=2", "c": ""}
    assert {(r.dict, r.entries, r.raw) for r in E.statistics(found).collect()} == {("a", 1, 3), ("b", 2, 1)}
    edits = spark.createDataFrame([("b", 1, "x", "9")], "dict string, line_no int, key string, value string")
    added = spark.createDataFrame([("b", 1, "z", "3"), ("b", 2, "w", "4")], edits.schema)
    gone = spark.createDataFrame([("b", 2)], "dict string, line_no int")
    assert {r.dict: r.value for r in E.serialised(found, marks, edits, gone, added).collect()}["b"] == "x=9\ny=2\nz=3\nw=4"
    keys = spark.createDataFrame([("b", "x")], "dict string, key string")
    assert {r.key for r in E.without_key(found.where("dict = 'b'"), keys).collect()} == {"", "y"}
    defaults = spark.createDataFrame([("b", 7, "entry", "x", "old")], "dict string, line_no int, kind string, key string, value string")
    assert ("x", "old") in {(r.key, r.value) for r in E.restored(found, defaults, keys).collect()}
    assert [r.dict for r in E.changed(given, _files(spark, a="q", b="x=1\n\ny=2", c="")).collect()] == ["a"]


def test_appending(spark):
    assert _one(spark, E.appended(F.lit("a=1\r\nb=2"), F.lit("c=3"))) == "a=1\r\nb=2\r\nc=3"
    assert _one(spark, E.appended(F.lit("a=1\n"), F.lit("c=3"))) == "a=1\nc=3" and _one(spark, E.appended(F.lit(" \n "), F.lit("c"))) == "c"
    lines = spark.createDataFrame([(1, "a=1"), (2, "b=2")], "line_no int, raw string")
    edits = spark.createDataFrame([("z", "3", 1), ("y", "4", 2), ("a", "9", 3)], "key string, value string, line_no int")
    assert [r.raw for r in D.upserted(lines, edits).orderBy("line_no").collect()] == ["a=9", "b=2", "z=3", "y=4"]


def test_patches(spark):
    pairs = spark.createDataFrame([("他好", " tha  hảo ")], "source string, readings string")
    assert {(r.key, r.value) for r in E.character_patches(pairs).collect()} == {("他", "tha"), ("好", "hảo")}
    with pytest.raises(Exception, match="differ"):
        E.character_patches(spark.createDataFrame([("他好", "tha")], "source string, readings string")).collect()
    with pytest.raises(Exception, match="not a key"):
        E.valid_patches(spark.createDataFrame([("他好", "x")], "key string, value string"), True).collect()
    one = spark.createDataFrame([("张", "Trương ")], "key string, value string")
    assert [tuple(r) for r in E.surname_phrases(one, spark.createDataFrame([("先生", "tiên sinh")], "key string, value string")).collect()] == [("张先生", "Trương tiên sinh")]
    memory = E.name_memory(_files(spark, a="x=1\nx=2\nbad"), _files(spark, r=" y \n\n"))
    assert {tuple(r) for r in memory.collect()} == {("x", "2", "accept"), ("y", None, "reject")}


def test_glossary_and_prompts(spark):
    entries = spark.createDataFrame([("names", " a ", "1", 1), ("names", "b", " ", 2), ("names", "a", "2", 3)], "kind string, key string, value string, line_no int")
    story = spark.createDataFrame([("names", "a", "story", 1)], entries.schema)
    found = E.glossary(entries, story)
    assert [tuple(r) for r in found.collect()] == [("names", "a", "story")]
    stories = spark.createDataFrame([(1, "N", "", "calm", " "), (2, None, None, None, "own")], "story int, name string, summary string, style string, prompt string")
    said = {r.story: r.prompt for r in E.prompts(stories, found, "BASE", "END").collect()}
    assert said[1].startswith("BASE\n# Story") and '{"names":{"a":"story"}}' in said[1] and "# Style" in said[1] and said[2].startswith("own\n# Glossary") and said[2].endswith("END")


def test_layouts(spark):
    assert _one(spark, E.laid_out(F.lit("a  \r\nb\n\n\n\nc \n"))) == "a\nb\n\nc\n" and _one(spark, E.laid_out(F.lit(" \n "))) == ""
    assert _one(spark, E.stripped_labels(F.lit("[[1]] x [[2]]y"))) == "x y" and _one(spark, E.indented(F.lit(" a \n\n b"))) == "\ta\n\tb"
    parts = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "doc_id int, n int")
    assert [r.doc_id for r in E.missing_paragraphs(parts, parts.where("doc_id = 1 and n = 1")).collect()] == [1]
    asked = spark.createDataFrame([(1, "ab c")], "id int, text string")
    layer = spark.createDataFrame([("ab", "x"), ("b", "y")], "key string, value string")
    assert [tuple(r) for r in E.all_meanings(asked, {"names": layer}).select("source", "key", "length").collect()] == [("names", "ab", 2)]


def test_files(spark, tmp_path):
    for name, text in {"Resources/ChinesePhienAmWords.txt": "他=tha", "VietPhrase/VietPhrase.txt": "很好=rất tốt"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {r.dict: r.value for r in files.read_dictionaries(spark, str(tmp_path)).collect()}
    assert got["readings"] == "他=tha" and got["names"] == ""
    book = tmp_path / "book"
    book.mkdir()
    (book / "c10.txt").write_bytes("他".encode("gb18030"))
    (book / "c2.txt").write_bytes(b"\xff\xfe" + "x".encode("utf-16-le"))
    (book / "big.txt").write_bytes(b"y" * 50)
    assert [(r["name"], r["text"]) for r in files.read_chapters(spark, str(book), 40).orderBy("order").collect()] == [("c2.txt", "x"), ("c10.txt", "他")]
    pairs = spark.createDataFrame([("a", "1", 2), ("bb", "2", 1)], "key string, value string, line_no int")
    files.save_dictionary(pairs, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["bb=2", "a=1"]
    log = spark.sql("select 'k' entry, 'add' action, 'u' user, timestamp'2024-01-02 03:04:05' at")
    E.append_history(log, str(tmp_path / "log"))
    assert files.read_history(spark, str(tmp_path / "log")).first().at.year == 2024
