"""Proper-name candidates: mining, facts, scores, pruning, ranking, memory and merging, as joins and groupings by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ngrams(texts: DataFrame, least: int = 2, most: int = 8, inside: str = r"\p{IsHan}") -> DataFrame:
    """(doc_id, start, gram): all substrings of these lengths inside runs of script characters. A text is cut to characters
    once, and only its substrings become rows."""
    chars = F.split(F.regexp_replace("text", f"(?s)(?!{inside}).", "\n"), "")
    at = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.size("chars") - n + 1), lambda p: F.struct((p - 1).alias("start"), F.array_join(F.slice("chars", p, n), "").alias("gram"))), lambda x: ~F.contains(x["gram"], F.lit("\n")))
    each = F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.size("chars"))), at))
    cut = texts.where(F.length("text") >= least).select("doc_id", chars.alias("chars"))
    return cut.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.start", "x.gram")


def token_counts(tokens: DataFrame, stop: list[str], least: int = 2, sizes: tuple[int, int] = (2, 5)) -> DataFrame:
    """(doc_id, word, n): tokens of these lengths that occur often enough and hold no stop string."""
    kept = tokens.where(F.length("word").between(*sizes))
    for s in stop:
        kept = kept.where(~F.contains("word", F.lit(s)))
    return kept.groupBy("doc_id", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shortest_per_prefix(words: DataFrame, size: int = 2) -> DataFrame:
    """The shortest word (ties: the smaller) of each beginning in each document."""
    best = words.groupBy("doc_id", F.substring("word", 1, size).alias("begin")).agg(F.min(F.struct(F.length("word"), "word")).alias("x"))
    return best.select("doc_id", F.col("x.word").alias("word"))


def affixes(word, least: int = 1, most: int = 3):
    """Proper beginnings and endings of these lengths."""
    sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: n < F.length(word))
    return F.array_distinct(F.concat(F.transform(sizes, lambda n: F.substr(word, F.lit(1), n)), F.transform(sizes, lambda n: F.substr(word, F.length(word) - n + 1, n))))


def occurrences(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, word, n, first): how often each word (doc_id, word) stands in its text, none inside another, and where first, from
    0; words that don't are left out. A text meets all its words in one row."""
    asked = words.where("word <> ''").groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    text = F.col("text")
    each = F.transform("words", lambda w: F.struct(w.alias("word"), ((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("long").alias("n"), (F.instr(text, w) - 1).alias("first")))
    return texts.select("doc_id", "text").join(asked, "doc_id").select("doc_id", F.inline(F.filter(each, lambda x: x["n"] > 0)))


def chained(words: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """Words whose proper beginning is a known name that ends with the word's first character, if the name with the word's
    other characters after it stands in the text."""
    begins = words.select("doc_id", "word", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.length("word")), lambda n: n < F.length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("key"))
    hit = begins.join(names.select("key").distinct(), "key", "left_semi").where(F.substr("key", F.length("key"), F.lit(1)) == F.substring("word", 1, 1))
    whole = hit.withColumn("whole", F.concat("key", F.substr("word", F.lit(2))))
    there = occurrences(texts, whole.select("doc_id", F.col("whole").alias("word"))).select("doc_id", F.col("word").alias("whole"))
    return whole.join(there, ["doc_id", "whole"]).select("doc_id", "word").distinct()


def titles(texts: DataFrame, open_: str = "《", close: str = "》") -> DataFrame:
    """(doc_id, title): what stands between brackets on one line, once each."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{open_}([^{close}\n]*){close}"), F.lit(1)))
    return texts.select("doc_id", F.explode(found).alias("title")).where("title <> ''")


def entity_type(person, organisation, location, title):
    return F.when(person, "person").when(organisation, "organization").when(location, "location").when(title, "title").otherwise("unknown")


def _f(x: float):
    return F.lit(x).cast("float")


def hybrid_score(occurrences, token, trigger, surname, suffix, remainder, common):
    """Single-precision sum of the evidence in a fixed order, held between 0 and 0.99."""
    some = lambda flag, w: F.when(flag, _f(w)).otherwise(_f(0.0))
    s = (_f(0.18) + (_f(0.07) * F.least(occurrences, F.lit(4)).cast("float")).cast("float")).cast("float")
    for flag, w in ((token, 0.12), (trigger, 0.30), (surname, 0.30), (suffix, 0.20), (remainder, 0.25)):
        s = (s + some(flag, w)).cast("float")
    s = (s + F.when(common, _f(-0.12)).when(token, _f(0.10)).otherwise(_f(0.0))).cast("float")
    return F.greatest(_f(0.0), F.least(_f(0.99), s))


def local_score(occurrences, threshold: int):
    return F.least(_f(0.82), (_f(0.58) + (_f(0.04) * (occurrences - threshold).cast("float")).cast("float")).cast("float"))


def pruned(found: DataFrame) -> DataFrame:
    """Candidates (doc_id, word, n, score) without those whose proper beginning or ending (two characters or more) is a
    candidate at least as frequent and better by 0.15."""
    parts = found.select("doc_id", "word", "n", "score", F.explode(affixes(F.col("word"), 2, 7)).alias("part"))
    other = found.select("doc_id", F.col("word").alias("part"), F.col("n").alias("pn"), F.col("score").alias("ps"))
    beaten = parts.join(other, ["doc_id", "part"]).where((F.col("pn") >= F.col("n")) & (F.col("ps") >= (F.col("score") + _f(0.15)).cast("float")))
    return found.join(beaten.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_anti")


def ranked(found: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` of each document: known first, then score, occurrences, first place, word."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("known"), F.desc("score"), F.desc("n"), F.asc("first"), F.asc("word"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def combined(a, b):
    """Confidence of two sources together."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - a) * (1 - b)))


def merged_entities(found: DataFrame, entities: DataFrame, rejected: DataFrame, least: float = 0.65) -> DataFrame:
    """Candidates (doc_id, word, score) and entities (doc_id, word, confidence, pos): the first entity of a text counts,
    doubtful and rejected ones go, the rest raise a candidate's score or are added."""
    sure = entities.where(F.col("confidence") >= least).groupBy("doc_id", "word").agg(F.min_by("confidence", "pos").alias("confidence"))
    sure = sure.join(rejected.select("word"), "word", "left_anti")
    both = found.select("doc_id", "word", "score").join(sure, ["doc_id", "word"], "full")
    score = F.when(F.col("score").isNotNull() & F.col("confidence").isNotNull(), combined(F.col("score"), F.col("confidence"))).otherwise(F.coalesce("score", "confidence"))
    return both.select("doc_id", "word", score.alias("score"))


def _quoted(word):
    """A word as an expression that matches it alone; the quote's own end inside the word is quoted apart."""
    return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def places(text, word):
    """Starts (from 1) of the places of a word from left to right, none inside another."""
    parts = F.transform(F.split(text, _quoted(word), -1), lambda x: F.length(x))
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(parts) > 1, F.transform(F.slice(upto, 1, F.size(parts) - 1), lambda x, i: x + i * F.length(word) + 1)).otherwise(F.array().cast("array<int>"))


def contexts(text, word, radius: int = 36, most: int = 3):
    """What stands around the first `most` places of a word, which is marked; array<string>."""
    def around(at):
        first = F.greatest(F.lit(1), at - radius)
        return F.concat(F.substr(text, first, at - first), F.lit("【"), word, F.lit("】"), F.substr(text, at + F.length(word), F.lit(radius)))

    # Only as much of the text as holds the places: the rest stays in one piece.
    few = F.split(text, _quoted(word), most + 1)
    sizes = F.transform(F.slice(few, 1, F.size(few) - 1), lambda x: F.length(x))
    starts = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, y: a + y) + i * F.length(word) + 1)
    return F.transform(starts, around)


def memory(events: DataFrame) -> DataFrame:
    """(book, key, value, action, at) accept, reject and undo events -> the last state of each key that isn't undone."""
    last = events.groupBy("book", "key").agg(F.max_by(F.struct("action", "value"), "at").alias("x"))
    return last.where("x.action <> 'undo'").select("book", "key", "x.action", "x.value")


def quality(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 of keys against gold keys."""
    a, b = found.select("key").distinct(), gold.select("key").distinct()
    counts = a.join(b, "key", "left_semi").agg(F.count("*").alias("hit")).crossJoin(a.agg(F.count("*").alias("found"))).crossJoin(b.agg(F.count("*").alias("gold")))
    p, r = F.col("hit") / F.nullif("found", F.lit(0)), F.col("hit") / F.nullif("gold", F.lit(0))
    return counts.select("hit", "found", "gold", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))
