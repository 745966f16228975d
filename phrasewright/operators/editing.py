"""Dictionary files under edit: their lines with what they are, changes, statistics, and the text they become again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewright.operators.dictionaries import overlaid


def documents(files: DataFrame) -> DataFrame:
    """(dict, value: the whole file) -> (dict, bom, ending, closed): marks of the file, to be kept when it is written."""
    return files.select("dict", F.startswith("value", F.lit("﻿")).alias("bom"), F.when(F.contains("value", F.lit("\r\n")), "\r\n").otherwise("\n").alias("ending"), F.endswith("value", F.lit("\n")).alias("closed"))


def records(files: DataFrame, value_only: bool = False) -> DataFrame:
    """(dict, line_no from 1, kind, key, value): each line as an entry, if it has one '=' and not at its start, or as it is."""
    body = F.regexp_replace("value", "^﻿", "")
    lines = F.split(F.regexp_replace(body, "\r?\n$", ""), "\r?\n", -1)
    rows = files.where(body != "").select("dict", F.posexplode(lines).alias("nth", "raw"))
    at = F.instr("raw", "=")
    entry = F.lit(False) if value_only else (at > 1) & (F.length("raw") - F.length(F.replace("raw", F.lit("="), F.lit(""))) == 1)
    key, value = F.when(entry, F.substr("raw", F.lit(1), at - 1)).otherwise(""), F.when(entry, F.substr("raw", at + 1)).otherwise(F.col("raw"))
    return rows.select("dict", (F.col("nth") + 1).alias("line_no"), F.when(entry | F.lit(value_only), "entry").otherwise("raw").alias("kind"), key.alias("key"), value.alias("value"))


def statistics(found: DataFrame) -> DataFrame:
    """(dict, entries, raw) from records()."""
    return found.groupBy("dict").agg(F.count_if(F.col("kind") == "entry").alias("entries"), F.count_if(F.col("kind") == "raw").alias("raw"))


def serialised(found: DataFrame, marks: DataFrame, edits: DataFrame | None = None, deleted: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """(dict, value): records as a file again. edits (dict, line_no, key, value) replace lines, deleted (dict, line_no) drop
    them, added (dict, line_no, key, value) follow the last in their order."""
    line = lambda x: F.when(x("key") == "", x("value")).otherwise(F.concat(x("key"), F.lit("="), x("value")))
    rows = found.select("dict", "line_no", line(F.col).alias("raw"))
    if edits is not None:
        rows = rows.join(edits.select("dict", "line_no", line(F.col).alias("new")), ["dict", "line_no"], "left").select("dict", "line_no", F.coalesce("new", "raw").alias("raw"))
    if deleted is not None:
        rows = rows.join(deleted.select("dict", "line_no"), ["dict", "line_no"], "left_anti")
    rows = rows.select("dict", F.lit(0).alias("late"), "line_no", "raw")
    if added is not None:
        rows = rows.unionByName(added.select("dict", F.lit(1).alias("late"), F.col("line_no").cast("int").alias("line_no"), line(F.col).alias("raw")))
    each = rows.groupBy("dict").agg(F.array_sort(F.collect_list(F.struct("late", "line_no", "raw"))).alias("all"))
    out = marks.join(each, "dict", "left")
    # The separator differs by file, so the lines are folded and not joined by a literal.
    text = F.aggregate(F.coalesce("all.raw", F.array().cast("array<string>")), F.lit(None).cast("string"), lambda acc, x: F.concat(F.coalesce(F.concat(acc, F.col("ending")), F.lit("")), x))
    closing = F.when(F.col("closed") & text.isNotNull(), F.col("ending")).otherwise("")
    return out.select("dict", F.concat(F.when(F.col("bom"), "﻿").otherwise(""), F.coalesce(text, F.lit("")), closing).alias("value"))


def appended(existing, incoming):
    """One text after the other on a line of its own, with the first one's line end; a blank first text is left out."""
    ending = F.when(F.contains(existing, F.lit("\r\n")), "\r\n").otherwise("\n")
    return F.when(F.trim(F.regexp_replace(existing, r"\s+", " ")) == "", incoming).otherwise(F.concat(existing, F.when(F.endswith(existing, F.lit("\n")), "").otherwise(ending), incoming))


def without_key(found: DataFrame, keys: DataFrame) -> DataFrame:
    """Records whose key isn't one of these."""
    return found.join(keys.select("dict", "key").distinct(), ["dict", "key"], "left_anti")


def without_record(found: DataFrame, gone: DataFrame) -> DataFrame:
    """Records that aren't exactly one of these (dict, key, value)."""
    return found.join(gone.select("dict", "key", "value").distinct(), ["dict", "key", "value"], "left_anti")


def restored(found: DataFrame, defaults: DataFrame, keys: DataFrame) -> DataFrame:
    """Records in which the entries of these keys (dict, key) are the defaults' again."""
    wanted = keys.select("dict", "key").distinct()
    return without_key(found, wanted).unionByName(defaults.join(wanted, ["dict", "key"], "left_semi").select(found.columns))


def changed(files: DataFrame, defaults: DataFrame) -> DataFrame:
    """Files (dict, value) that differ from the default of their name."""
    return files.join(defaults.select("dict", F.col("value").alias("old")), "dict", "left").where(~F.col("value").eqNullSafe(F.col("old"))).select("dict", "value")


def character_patches(pairs: DataFrame) -> DataFrame:
    """(source, readings) -> (key, value) of each character with its reading; an error where their numbers differ."""
    chars, said = F.split("source", ""), F.filter(F.split(F.trim("readings"), r"\s+"), lambda x: x != "")
    zipped = F.when(F.size(chars) == F.size(said), F.arrays_zip(chars.alias("key"), said.alias("value"))).otherwise(F.raise_error(F.concat(F.lit("characters and readings differ: "), F.col("source"))))
    return pairs.select(F.explode(zipped).alias("x")).select("x.key", "x.value")


def valid_patches(patches: DataFrame, one_character: bool) -> DataFrame:
    """Patches (key, value); an error for an empty key, or one that isn't one character where it must be."""
    ok = F.length("key") == 1 if one_character else F.length("key") > 0
    return patches.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("not a key: "), F.coalesce("key", F.lit("null"))))))


def surname_phrases(surnames: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(key, value) of every surname with every suffix: two small tables whose sizes are checked, at most ten million phrases."""
    if (n := surnames.count() * suffixes.count()) > 10_000_000:
        raise ValueError(f"{n} phrases")
    both = surnames.select(F.col("key").alias("a"), F.trim("value").alias("va")).join(F.broadcast(suffixes.select(F.col("key").alias("b"), F.trim("value").alias("vb"))))
    return both.select(F.concat("a", "b").alias("key"), F.concat_ws(" ", "va", "vb").alias("value"))


def known_names(keys: DataFrame, *layers: DataFrame) -> DataFrame:
    """keys (key) with known: whether one of the name lists has it."""
    every = overlaid(*layers).select("key", F.lit(True).alias("hit"))
    return keys.join(every, "key", "left").select(*keys.columns, F.coalesce("hit", F.lit(False)).alias("known"))


def all_meanings(queries: DataFrame, layers: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """(id, source, key, value, length): what each list (in order) says about the beginnings of a text, the longest first."""
    t = F.substring(F.trim("text"), 1, most)
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda n: F.substr(t, F.lit(1), n))
    asked = queries.select("id", F.explode(F.array_distinct(begins)).alias("key")).where("key <> ''")
    parts = [x.select("key", "value", F.lit(name).alias("source"), F.lit(i).alias("nth")) for i, (name, x) in enumerate(layers.items())]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return asked.join(every, "key").select("id", "source", "nth", "key", "value", F.length("key").alias("length"))


def glossary(entries: DataFrame, story: DataFrame | None = None) -> DataFrame:
    """(kind, key, value) without blank keys and values; a story's entries replace the workspace's, the last of a key counts."""
    rows = entries.select("kind", "key", "value", F.col("line_no").cast("long").alias("line_no"), F.lit(0).alias("late"))
    if story is not None:
        rows = rows.unionByName(story.select("kind", "key", "value", F.col("line_no").cast("long").alias("line_no"), F.lit(1).alias("late")))
    kept = rows.where("trim(key) <> '' and trim(value) <> ''")
    return kept.groupBy("kind", F.trim("key").alias("key")).agg(F.max_by(F.trim("value"), F.struct("late", "line_no")).alias("value"))


def glossary_size(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"))


def prompts(stories: DataFrame, found: DataFrame, base: str, suffix: str) -> DataFrame:
    """(story, prompt): a story's own prompt or the base, then its name and summary, the glossary by kind, the style, and the suffix.
    stories: (story, name, summary, style, prompt). The glossary is one row, so it joins every story."""
    kinds = found.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("entries"))
    part = F.to_json(F.create_map("kind", "entries"))
    one = kinds.select("kind", F.substr(part, F.lit(2), F.length(part) - 2).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "part"))), lambda x: x["part"]), ",").alias("all"))
    section = lambda title, body: F.when(body.isNotNull() & (body != "") & (body != "{}"), F.concat(F.lit(f"\n# {title}\n\n"), body, F.lit("\n"))).otherwise("")
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    about = F.to_json(F.struct(blank("name").alias("name"), blank("summary").alias("summary")))
    prompt = F.concat(F.coalesce(blank("prompt"), F.lit(base)), section("Story", about), section("Glossary", F.concat(F.lit("{"), "all", F.lit("}"))), section("Style", F.coalesce("style", F.lit(""))), F.lit(suffix))
    return stories.crossJoin(F.broadcast(one)).select("story", prompt.alias("prompt"))


def stripped_labels(text):
    """Without [[n]] marks."""
    return F.regexp_replace(text, r"\[\[\s*\d+\s*\]\]\s?", "")


def missing_paragraphs(parts: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, source, translated): texts whose translation lacks two paragraphs or more."""
    have = translations.groupBy("doc_id").agg(F.count("*").alias("translated"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("source")).join(have, "doc_id", "left").select("doc_id", "source", F.coalesce("translated", F.lit(0).cast("long")).alias("translated")).where("translated + 2 <= source")


def laid_out(text):
    """Lines without blanks at their ends, blocks of lines parted by one empty line, one line feed at the end."""
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    return F.when(whole == "", whole).otherwise(F.concat(whole, F.lit("\n")))


def indented(text, blank_lines: bool = False):
    """Lines trimmed and set in by a tab, empty ones dropped, with an empty line between if wanted."""
    lines = F.filter(F.transform(F.split(text, "\r?\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\t"), x)), "\n\n" if blank_lines else "\n")


def names_lines(found: DataFrame) -> DataFrame:
    """(value): candidates as 'word=suggested' lines."""
    return found.select(F.concat("word", F.lit("="), "suggested").alias("value"))


def candidates_json(found: DataFrame) -> DataFrame:
    """(value): candidates as JSON objects, nulls left out."""
    return found.select(F.to_json(F.struct("word", "suggested", "entity_type", "score", "n", "known")).alias("value"))


def append_history(log: DataFrame, path: str) -> None:
    """Add rows (entry, action, user, at) to a tab-separated log."""
    log.select("entry", "action", "user", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")).write.mode("append").csv(path, sep="\t", header=True)


def name_memory(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(key, value, action) from files (dict, value) of key=value lines, the last of a key, and of rejected lines."""
    kept = records(accepted).where("kind = 'entry'").groupBy("key").agg(F.max_by("value", "line_no").alias("value"))
    gone = rejected.select(F.explode(F.split("value", "\r?\n")).alias("key")).select(F.trim("key").alias("key")).where("key <> ''").distinct()
    return kept.select("key", "value", F.lit("accept").alias("action")).unionByName(gone.select("key", F.lit(None).cast("string").alias("value"), F.lit("reject").alias("action")))
