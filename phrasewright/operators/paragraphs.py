"""Chunks, paragraphs and checks around model translation: everything but the model call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(texts: DataFrame) -> DataFrame:
    """(doc_id, n from 1, paragraph, start): trimmed lines that aren't empty, with their place in the text."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    before = F.coalesce(F.sum(F.length("raw") + 1).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = lines.withColumn("before", before).where(F.trim("raw") != "")
    start = F.col("before") + F.length("raw") - F.length(F.ltrim("raw"))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).alias("n"), F.trim("raw").alias("paragraph"), start.cast("long").alias("start"))


def labelled(parts: DataFrame) -> DataFrame:
    """(doc_id, payload): '[[n]] paragraph' blocks."""
    block = F.concat(F.lit("[["), F.col("n").cast("string"), F.lit("]] "), F.col("paragraph"))
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("all"))
    return rows.select("doc_id", F.array_join("all.block", "\n\n").alias("payload"))


def parsed_labels(outputs: DataFrame) -> DataFrame:
    """(doc_id, n, translated): the first non-empty text of each label in a model's answer."""
    parts = F.split("payload", r"\[\[", -1)
    each = outputs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    n = F.regexp_extract("part", r"^\s*(\d+)\s*\]\]", 1)
    found = each.where(n != "").select("doc_id", "pos", n.cast("int").alias("n"), F.trim(F.regexp_replace("part", r"^\s*\d+\s*\]\]", "")).alias("translated"))
    found = found.withColumn("translated", F.regexp_replace("translated", r"^\s+|\s+$", "")).where("translated <> ''")
    return found.groupBy("doc_id", "n").agg(F.min_by("translated", "pos").alias("translated"))


def aligned(parts: DataFrame, translations: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each paragraph with its translation, else its repair, else itself."""
    out = parts.join(translations, ["doc_id", "n"], "left").join(repairs.select("doc_id", "n", F.col("translated").alias("repaired")), ["doc_id", "n"], "left")
    return out.select("doc_id", "n", F.coalesce("translated", "repaired", "paragraph").alias("text"))


def line_chunks(texts: DataFrame, limit: int) -> DataFrame:
    """(doc_id, chunk, text): whole lines together up to the limit with their line feeds, longer lines cut, blank chunks dropped.
    A line joins the chunk while it fits, which depends on the lines before it, so a row folds its own lines."""
    lines = F.flatten(F.transform(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1), lambda x: F.regexp_extract_all(F.concat(x, F.lit("\n")), F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))))
    fold = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda acc, x: F.when(F.length(acc["open"]) + F.length(x) > limit, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], x).alias("open"))),
        lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(""))) != ""),
    )
    return texts.select("doc_id", F.posexplode(fold).alias("chunk", "text"))


def violations(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, line, message, text): lines that match a rule (message, pattern), shortened to 120 characters. The rules are
    few and become one expression, so each pattern is compiled once and a line is read once."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    tests = [F.when(F.col("raw").rlike(r.pattern), F.lit(r.message)) for r in rules.select("message", "pattern").distinct().orderBy("message", "pattern").collect()]
    hit = lines.withColumn("message", F.explode(F.array_compact(F.array(*tests) if tests else F.array().cast("array<string>"))))
    return hit.select("doc_id", (F.col("line") + 1).alias("line"), "message", F.substring("raw", 1, 120).alias("text"))


def tidy(text):
    """Without blanks at line ends, and at most one empty line between lines."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def coalesced(ranges: DataFrame) -> DataFrame:
    """(id, start, end) -> maximal ranges without overlap; those that touch join."""
    w = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(w)
    marked = ranges.withColumn("island", island)
    return marked.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end")
