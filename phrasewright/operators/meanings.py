"""All that the dictionaries say about the beginning of a text: rule or number, names, phrases and definitions, in sections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasewright.functions import numbers
from phrasewright.functions.text import col, modifiers_last
from phrasewright.operators import rules as R
from phrasewright.operators.dictionaries import first_wins

#: So many characters of a text are looked at.
MOST = 20
#: The marks of the sections, what parts them, and what is said where there is none.
MARKS = {"rule": " (Luật Nhân) ", "number": " (Luật S) ", "names2": " (Names phụ) ", "names": " (Name chính) ", "phrases": " (VietPhrase) ", "lookup": " (Lạc Việt)\n"}
RULED, NOTHING = "\n-----------------\n", "Not Found"
#: The lists that give a phrase its length, in the order of their sections; definitions come after them all.
_SIZED = ("names2", "names", "phrases")
_SECTION = "array<struct<source:string,key:string,value:string,length:int>>"


def head(text) -> Column:
    return F.substring(col(text), 1, MOST)


def merged_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """(key, names2, names, phrases, lookup): one row for each key no longer than MOST of lists (line_no, key, value), the first
    line of a key counts. Lists that aren't given are empty."""
    if unknown := set(lists) - set(MARKS):
        raise ValueError(f"unknown lists: {sorted(unknown)}")
    every = None
    for name, pairs in lists.items():
        part = first_wins(pairs.where(F.length("key").between(1, MOST))).select("key", F.lit(name).alias("list"), "value")
        every = part if every is None else every.unionByName(part)
    found = lambda name: F.max(F.when(F.col("list") == name, F.col("value"))).alias(name)
    return every.groupBy("key").agg(*(found(name) for name in (*_SIZED, "lookup")))


def full_meanings(texts: DataFrame, lists: dict[str, DataFrame], rules: R.Rules | str | None = None, rows: list | None = None) -> DataFrame:
    """texts (text) with sections array<struct<source, key, value, length>>, meanings (the sections as one text) and phrase_length.

    The first section is that of the rule that matches at the start of the text's first MOST characters, or else of the number that
    stands there, unless the number is a phrase itself. Then, for each beginning of the text from the longest to one character,
    what the lists names2, names and phrases say about it, then the definitions of lookup in the same order. phrase_length is the
    length of the rule or number, else of the longest beginning in a sized list, else 1. A text that nothing is known of has no
    sections; its meanings say so under its first character. Null and empty texts have no sections, '' and 0.
    Repeated texts are rows of their own; columns of texts with one of the three names are replaced.

    Equal beginnings are looked up once. Every beginning meets at most one row of the merged lists, whatever their size, so a join
    by key does; a beginning that most texts share is split by the adaptive join, as the lists hold it once. rules and rows: as
    for rules.best_match.
    """
    heads = texts.select(head("text").alias("head")).where("head <> ''").distinct()
    known = merged_lists(lists)
    begins = heads.select("head", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda n: F.substr("head", F.lit(1), n))).alias("key"))
    hits = begins.join(known, "key").groupBy("head").agg(F.collect_list(F.struct(F.length("key").alias("length"), "key", *_SIZED, "lookup")).alias("hits"))
    longest = F.reverse(F.array_sort("hits"))
    section = lambda source, hit, value: F.struct(F.lit(source).alias("source"), hit["key"].alias("key"), value.alias("value"), hit["length"].cast("int").alias("length"))
    sized = F.flatten(F.transform(longest, lambda h: F.array(*(section(s, h, F.replace(h[s], F.lit("/"), F.lit("; "))) for s in _SIZED))))
    defined = F.transform(longest, lambda h: section("lookup", h, h["lookup"]))
    listed = hits.select("head", F.filter(F.concat(sized, defined), lambda x: x["value"].isNotNull()).cast(_SECTION).alias("listed"))
    led = _led(heads, lists.get("phrases"), rules, rows).select("head", "first")
    told = heads.join(listed, "head", "left").join(led, "head", "left")
    sections = F.concat(*(F.coalesce(c, F.array().cast(_SECTION)) for c in ("first", "listed")))
    answered = told.select("head", sections.alias("sections"))
    texts = texts.drop("sections", "meanings", "phrase_length")
    own = f"head {uuid.uuid4().hex}"
    back = texts.withColumn(own, head("text")).join(answered.withColumnRenamed("head", own), own, "left")
    return back.select(*(F.col(f"`{c}`") for c in texts.columns), F.coalesce("sections", F.array().cast(_SECTION)).alias("sections"), _said(own).alias("meanings"), _length(own).alias("phrase_length"))


def _led(heads: DataFrame, phrases: DataFrame | None, rules, rows) -> DataFrame:
    """(head, first): the section of the rule or number at the start of a text, as an array that is null where there is none."""
    line = heads.withColumn("line", modifiers_last("head"))
    rule = R.best_match("line", rules, rows) if rules is not None else F.lit(None).cast("struct<index:int,length:int,key:string,rendered:string>")
    number = F.get(F.filter(numbers.number_spans("line"), lambda x: x["start"] == 0), F.lit(0))
    seen = line.select("head", "line", rule.alias("rule"), number.alias("number")).withColumn("digits", F.col("number.text"))
    if phrases is None:
        seen = seen.withColumn("phrase", F.lit(None).cast("boolean"))
    else:
        seen = seen.join(phrases.select(F.col("key").alias("digits")).distinct().withColumn("phrase", F.lit(True)), "digits", "left")
    said = seen.withColumn("said", numbers.number_phrase("digits"))
    section = lambda source, size, value: F.array(F.struct(F.lit(source).alias("source"), F.substr("line", F.lit(1), size).alias("key"), value.alias("value"), size.alias("length"))).cast(_SECTION)
    by_rule = F.when(F.expr("rule.index = 0 and rule.length > 0 and rule.rendered <> ''"), section("rule", F.col("rule.length"), F.col("rule.rendered")))
    by_number = F.when(F.expr("phrase is null and said <> ''"), section("number", F.col("number.length"), F.col("said")))
    return said.select("head", F.coalesce(by_rule, by_number).alias("first"))


def _said(head: str) -> Column:
    marks = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    parts = F.transform("sections", lambda s: F.concat(s["key"], marks[s["source"]], s["value"], F.lit(RULED)))
    unknown = F.concat(F.substring(head, 1, 1), F.lit(RULED + NOTHING))
    return F.when(F.coalesce(F.col(head), F.lit("")) == "", "").when(F.size(F.coalesce("sections", F.array().cast(_SECTION))) == 0, unknown).otherwise(F.array_join(parts, ""))


def _length(head: str) -> Column:
    first = F.get(F.filter("sections", lambda s: s["source"] != "lookup"), F.lit(0))["length"]
    return F.when(F.coalesce(F.col(head), F.lit("")) == "", 0).otherwise(F.coalesce(first, F.lit(1)))
