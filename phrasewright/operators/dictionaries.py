"""Dictionaries as tables (dict, line_no, key, value) and their algebra: parse, dedupe, merge, override, patch, look up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewright.functions.text import first_meaning

KEY_MOST = 15
#: Line numbers of appended keys begin here.
LATE = 1 << 40


def lines_of(files: DataFrame) -> DataFrame:
    """(dict, value: the whole file) -> (dict, line_no, raw); a mark of byte order at the start is dropped."""
    text = F.regexp_replace("value", "^﻿", "")
    return files.select("dict", F.posexplode(F.split(text, "\r?\n", -1)).alias("line_no", "raw"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """Lines with exactly one '=' as key and value; nothing is trimmed, '#' is no comment."""
    parts = F.split("raw", "=", -1)
    return lines.where(F.size(parts) == 2).select("dict", "line_no", parts[0].alias("key"), parts[1].alias("value"))


def parse_rules(lines: DataFrame) -> DataFrame:
    """Pairs whose line doesn't begin with '#', first key wins, ranked by length (longest first) and key."""
    kept = first_wins(parse_pairs(lines.where(~F.col("raw").startswith("#"))))
    return kept.withColumn("length", F.length("key")).orderBy(F.desc("length"), "key")


def parse_phrases(lines: DataFrame) -> DataFrame:
    """Value-only lines without the empty ones."""
    return lines.where("raw <> ''").select("dict", "line_no", F.col("raw").alias("key"))


def first_wins(pairs: DataFrame, *order: str) -> DataFrame:
    """One row per key: that of the smallest line_no, or of the given columns."""
    by = F.struct(*(order or ("line_no",)))
    return pairs.groupBy("key").agg(F.min_by("value", by).alias("value"))


def last_wins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def scannable(pairs: DataFrame, most: int = KEY_MOST) -> DataFrame:
    return pairs.where(F.length("key") <= most)


def readings(pairs: DataFrame) -> DataFrame:
    """One-character keys."""
    return first_wins(pairs.where(F.length("key") == 1))


def overlaid(*layers: DataFrame) -> DataFrame:
    """(key, value) of the first layer that has the key; each layer is deduped by line."""
    ranked = [x.select("key", "value", F.col("line_no").cast("long").alias("line_no"), F.lit(i).alias("layer")) for i, x in enumerate(layers)]
    every = ranked[0]
    for x in ranked[1:]:
        every = every.unionByName(x)
    return first_wins(every, "layer", "line_no")


def one_meaning(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("value", first_meaning("value"))


def noun_values(pronouns: DataFrame, names: DataFrame) -> DataFrame:
    """What stands for a noun in rules: pronouns, then names by their first meaning."""
    return overlaid(pronouns, one_meaning(names))


def key_lengths(pairs: DataFrame) -> DataFrame:
    """(first, longest): the longest key by first character."""
    return pairs.where("key <> ''").groupBy(F.substring("key", 1, 1).alias("first")).agg(F.max(F.length("key")).alias("longest"))


def look_up(queries: DataFrame, pairs: DataFrame, most: int = 20) -> DataFrame:
    """(id, text) -> (id, pos, source, definition): the beginnings of the trimmed text's first `most` characters, longest
    first, then its characters; each once, those that have a definition. Equal beginnings are looked up once. No side of a
    join is sent whole: Spark doesn't count the rows that an explode makes, and would take the probes for a small table."""
    t = F.col("_t")
    asked = queries.select("id", F.substring(F.trim("text"), 1, most).alias("_t"))
    begins = F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))), lambda n: F.substr(t, F.lit(1), n))
    probes = F.filter(F.array_distinct(F.concat(begins, F.split(t, ""))), lambda p: p != "")
    told = pairs.select(F.col("key").alias("source"), F.replace(F.replace("value", F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")).alias("definition"))
    each = asked.select("_t").distinct().select("_t", F.posexplode(probes).alias("pos", "source"))
    said = each.hint("merge").join(told, "source").groupBy("_t").agg(F.collect_list(F.struct("pos", "source", "definition")).alias("said"))
    return asked.hint("merge").join(said, "_t").select("id", F.inline("said"))


def missing_readings(texts: DataFrame, known: DataFrame, letters: str = r"\p{IsHan}") -> DataFrame:
    """(ch, n): characters of a class that have no reading, with how often they occur."""
    chars = texts.select(F.explode(F.regexp_extract_all("text", F.lit(letters), F.lit(0))).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n")).join(known.select(F.col("key").alias("ch")), "ch", "left_anti")


def upserted(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Raw lines with the edits (key, value, line_no; null value: removed): the first line of a key takes its new value, keys
    not found are appended in the order of the edits, from LATE on."""
    at = F.instr("raw", "=")
    keyed = lines.withColumn("key", F.when(at > 1, F.substr("raw", F.lit(1), at - 1)))
    firsts = keyed.where("key is not null").groupBy("key").agg(F.min("line_no").alias("line_no")).withColumn("first", F.lit(True))
    edits = edits.select("key", F.col("value").alias("new"), F.lit(True).alias("edited"), F.col("line_no").cast("long").alias("nth"))
    marked = keyed.join(firsts, ["key", "line_no"], "left").join(edits, "key", "left")
    changed = F.when(F.col("edited") & F.col("first") & F.col("new").isNotNull(), F.concat("key", F.lit("="), "new")).otherwise(F.col("raw"))
    kept = marked.where("edited is null or new is not null").select(F.col("line_no").cast("long").alias("line_no"), changed.alias("raw"))
    fresh = edits.where("new is not null").join(firsts.select("key"), "key", "left_anti")
    return kept.unionByName(fresh.select((F.lit(LATE) + F.col("nth")).alias("line_no"), F.concat("key", F.lit("="), "new").alias("raw")))


def compacted_history(log: DataFrame) -> DataFrame:
    """(entry, action, user, at, line_no): the last row of each entry."""
    return log.groupBy("entry").agg(F.max_by(F.struct("action", "user", "at"), F.struct("at", "line_no")).alias("x")).select("entry", "x.action", "x.user", "x.at")
