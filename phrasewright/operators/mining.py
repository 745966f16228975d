"""The name filter: candidates with their facts, evidence, suggestions and scores, as joins and groupings by document.

Every dictionary is a DataFrame (key, value), broadcast by Spark where it is small. Tokens of
a segmenter come as a DataFrame too; without one, candidates are n-grams alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasewright.functions.numbers import NUMBER_CHARS
from phrasewright.functions.text import first_meaning, title_words
from phrasewright.operators import names as N
from phrasewright.sources.shared import settled

#: What introduces a name; endings of persons, places and organisations; strings that no name holds.
TRIGGERS = "名为 名字叫 叫做 叫 姓 名叫 自称 号称 称为 乃是".split()
PERSONS = "先生 小姐 姑娘 公子 少爷 夫人 长老 师父 师傅 师兄 师姐 师弟 师妹 大人 真人 道长 掌门 宗主 教主 老祖 陛下 殿下 王爷 将军 队长 院长 主任 老师 同学".split()
PLACES = "国 州 郡 省 市 县 镇 乡 村 城 山 峰 谷 岛 海 湖 河 江 域 界 宫 殿 楼 阁 宗 门 派 寺 观 院 府 庄 寨 森林 沙漠 大陆 广场 学院".split()
ORGANISATIONS = "宗 门 派 教 帮 盟 会 阁 殿 宫 院 学院 公司 集团 协会 军 队 局 部 家族 一族 王朝 帝国".split()
STOPS = "她 着 的 你 我 了 他 什么 也 什 们 在 您 那 这 这个 不过 尔 啊 吧 一边 没 哪个 就是 有些 很 非常 还是 再有 发现 数 十几".split()
OFTEN, TITLE_SCORE = 5, 0.90
#: What no name of an external list holds.
MARKS = "[0-9\"'\t。，！？；：、—\\\\/@.]|……"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _flag(rows: DataFrame, key, table: DataFrame, name: str) -> DataFrame:
    """rows with name: whether key is one of the table's."""
    own = table.select(F.col("key").alias("_key")).distinct().withColumn(name, F.lit(True))
    return rows.join(own, key == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(False)))


def _tail(word, n: int):
    return F.when(F.length(word) >= n, F.substr(word, F.length(word) - n + 1, F.lit(n)))


def numeral_run(word):
    """Three or more numerals and nothing else, or two in a row."""
    return F.col(word).rlike(f"^[{NUMBER_CHARS}]{{3,}}$|[{NUMBER_CHARS}]{{2}}")


def triggered(texts: DataFrame) -> DataFrame:
    """(doc_id, start): places right after words that introduce a name. A text is read twice, whatever it holds: what stands
    between the words, and the words."""
    words = F.lit(_any(sorted(TRIGGERS, key=len, reverse=True)))
    hit = texts.where(F.regexp("text", words))
    each = F.arrays_zip(F.split("text", words, -1).alias("before"), F.regexp_extract_all("text", words, F.lit(0)).alias("mark"))
    parts = hit.select("doc_id", F.posexplode(each).alias("nth", "x")).where("x.mark is not null")
    sizes = F.sum(F.length("x.before") + F.length("x.mark")).over(Window.partitionBy("doc_id").orderBy("nth"))
    return parts.select("doc_id", sizes.cast("int").alias("start"))


def seeds(texts: DataFrame, inside: str, most: int, tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, word, n, first, token, trigger): n-grams and tokens with how often they occur and what they follow."""
    grams = N.ngrams(texts, 2, most, inside).select("doc_id", "start", F.col("gram").alias("word"), F.lit(False).alias("token"))
    if tokens is not None:
        grams = grams.unionByName(tokens.where(F.length("word").between(2, most)).select("doc_id", F.col("start").cast("int").alias("start"), "word", F.lit(True).alias("token")))
    marked = grams.join(triggered(texts).distinct().withColumn("trigger", F.lit(True)), ["doc_id", "start"], "left")
    once = marked.groupBy("doc_id", "word", "start").agg(F.max("token").alias("token"), F.max(F.coalesce("trigger", F.lit(False))).alias("trigger"))
    return once.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("token").alias("token"), F.max("trigger").alias("trigger"))


def facts(found: DataFrame, surnames: DataFrame, nouns: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Candidates (word) with surname, suffix and entity_type: persons by ending or surname, then organisations, places, titles."""
    word, size = F.col("word"), F.length("word")
    for n in (1, 2):
        found = _flag(found, F.when(size > n, F.substring("word", 1, n)), surnames, f"_s{n}")
    endings = nouns.select("key").unionByName(suffixes.select("key"))
    for n in (1, 2, 3):
        found = _flag(found, _tail(word, n), endings, f"_e{n}")
    person, place, organisation = (word.rlike(_any(x) + "$") for x in (PERSONS, PLACES, ORGANISATIONS))
    found = found.withColumns({"surname": F.col("_s1") | F.col("_s2"), "_listed": F.col("_e1") | F.col("_e2") | F.col("_e3")})
    kind = N.entity_type(person | F.col("surname"), organisation, place, F.col("_listed"))
    return found.withColumns({"suffix": person | place | organisation | F.col("_listed"), "entity_type": kind}).drop("_s1", "_e1", "_e2", "_e3", "_listed").withColumnRenamed("_s2", "compound")


def title_cased(value):
    """Whether the first letter of every word is in upper case; words without letters don't matter."""
    first = lambda w: F.regexp_extract(w, r"(\p{L})", 1)
    words = F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: (first(w) == "") | (F.upper(first(w)) == first(w)) & (F.lower(first(w)) != first(w)))


def proper_remainder(found: DataFrame, surnames: DataFrame, raw: DataFrame) -> DataFrame:
    """Candidates with remainder: whether a surname is followed by a phrase whose first meaning is in title case."""
    proper = raw.where(title_cased(first_meaning("value"))).select("key")
    for n in (1, 2):
        found = _flag(found, F.when(F.length("word") > n, F.substring("word", 1, n)), surnames, f"_s{n}")
        found = _flag(found, F.when(F.length("word") > n, F.substr("word", F.lit(n + 1))), proper, f"_p{n}")
    return found.withColumn("remainder", (F.col("_s1") & F.col("_p1")) | (F.col("_s2") & F.col("_p2"))).drop("_s1", "_s2", "_p1", "_p2")


def spelled(words: DataFrame, readings: DataFrame) -> DataFrame:
    """(word, spelled): the readings of a word's characters, each in title case; characters without one stay."""
    each = words.select("word").distinct().select("word", F.posexplode(F.split("word", "")).alias("nth", "ch"))
    known = each.join(readings.select(F.col("key").alias("ch"), "value"), "ch", "left").select("word", F.struct("nth", F.coalesce(title_words("value"), "ch").alias("said")).alias("x"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), " ")
    return known.groupBy("word").agg(F.trim(F.regexp_replace(said, r"\s+", " ")).alias("spelled"))


def templated(words: DataFrame, nouns: DataFrame, phrases: DataFrame, readings: DataFrame) -> DataFrame:
    """(word, filled): words of three characters or more that end with a noun, by the longest noun's template around what
    stands before it: its readings if that is two characters or fewer or no phrase, else the phrase in title case."""
    ends = words.select("word").distinct().where("length(word) > 2")
    ends = ends.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substr("word", F.length("word") - n + 1, n))).alias("key"))
    hit = ends.join(nouns.select("key", F.col("value").alias("template")), "key")
    best = hit.groupBy("word").agg(F.max_by(F.struct("key", "template"), F.length("key")).alias("x"))
    best = best.select("word", F.trim(F.substr("word", F.lit(1), F.length("word") - F.length("x.key"))).alias("head"), F.col("x.template").alias("template"))
    best = best.join(spelled(best.select(F.col("head").alias("word")), readings).withColumnRenamed("word", "head"), "head", "left")
    best = best.join(phrases.select(F.col("key").alias("head"), F.col("value").alias("phrase")), "head", "left")
    phrase = F.when(title_cased("phrase"), F.col("phrase")).otherwise(title_words("phrase"))
    said = F.when((F.length("head") > 2) & F.col("phrase").isNotNull(), phrase).otherwise(F.col("spelled"))
    filled = F.when(F.contains("template", F.lit("{0}")), F.replace("template", F.lit("{0}"), said)).otherwise(F.concat_ws(" ", said, "template"))
    return best.select("word", F.trim(filled).alias("filled"))


def suggested(found: DataFrame, nouns: DataFrame, raw: DataFrame, phrases: DataFrame, readings: DataFrame, by_reading) -> DataFrame:
    """Candidates with suggested: the noun's template, else the first meaning of a phrase in title case unless readings are
    preferred (by_reading), else the readings."""
    out = found.join(templated(found, nouns, phrases, readings), "word", "left").join(spelled(found, readings), "word", "left")
    out = out.join(raw.select(F.col("key").alias("word"), title_words(first_meaning("value")).alias("_meaning")), "word", "left")
    meaning = F.when(~by_reading, F.col("_meaning"))
    return out.withColumn("suggested", F.coalesce("filled", meaning, "spelled")).drop("filled", "spelled", "_meaning")


def hybrid(texts: DataFrame, tables: dict[str, DataFrame], inside: str = r"\p{IsHan}", tokens: DataFrame | None = None, known: DataFrame | None = None, rejected: DataFrame | None = None, least: int = 2, score: float = 0.60, longest: int = 8, most: int = 200, include_known: bool = True) -> DataFrame:
    """(doc_id, word, suggested, entity_type, score, n, first, known, rank) of the name candidates of each text.

    tables: surnames, nouns, suffixes, names, raw, phrases, readings and, for tokens, lexicon. known (key, value) and rejected
    (key) are the memory: rejected candidates go, known ones pass with score 1 and their own value.
    """
    empty = tables["names"].limit(0)
    known, rejected, lexicon = known if known is not None else empty, rejected if rejected is not None else empty, tables.get("lexicon", empty)
    found = seeds(texts, inside, longest, tokens)
    found = found.join(rejected.select(F.col("key").alias("word")).distinct(), "word", "left_anti")
    found = found.join(known.select(F.col("key").alias("word"), F.col("value").alias("told")), "word", "left").withColumn("known", F.col("told").isNotNull())
    found = _flag(found, F.col("word"), tables["names"], "named").where("known or not named").drop("named")
    if not include_known:
        found = found.where("not known")
    found = found.where(F.col("known") | ~(F.col("word").rlike(_any(STOPS)) | numeral_run("word")))
    found = facts(found, tables["surnames"], tables["nouns"], tables["suffixes"])
    found = proper_remainder(found, tables["surnames"], tables["raw"])
    found = _flag(_flag(found, F.col("word"), tables["raw"], "phrase"), F.col("word"), lexicon, "common")
    named = F.col("trigger") | (F.col("surname") & (~F.col("common") | (F.col("n") >= OFTEN)))
    seen = F.col("trigger") | F.col("suffix") | F.col("token") | ((F.length("word") > 2) & F.col("compound")) | F.col("remainder") | (F.col("n") >= 3)
    found = found.where(F.col("known") | ((~F.col("phrase") | named) & seen))
    value = N.hybrid_score(F.col("n"), F.col("token"), F.col("trigger"), F.col("surname"), F.col("suffix"), F.col("remainder"), F.col("common"))
    found = found.withColumn("score", F.when(F.col("known"), F.lit(1.0).cast("float")).otherwise(value))
    told = F.col("trigger") | F.col("surname") | F.col("suffix") | (F.col("n") >= least)
    # Written, as its words are spelled and matched with templates: candidates are few beside the n-grams they come from.
    found = settled(found.where(F.col("known") | ((F.col("score") >= F.lit(score).cast("float")) & told)), "candidates")
    found = suggested(found, tables["nouns"], tables["raw"], tables["phrases"], tables["readings"], F.col("surname") | F.col("trigger"))
    found = found.withColumn("suggested", F.coalesce("told", "suggested")).where(F.col("known") | F.contains("suggested", F.lit(" ")))
    return N.ranked(N.pruned(found), most).select("doc_id", "word", "suggested", "entity_type", "score", "n", "first", "known", "rank")


def part_of_names(words: DataFrame, names: DataFrame, surnames: DataFrame) -> DataFrame:
    """Words (two characters or more) that begin a name or begin with one, or hold one and begin with no surname. Which do is
    found once for each word, however many documents have it, and only from pieces as long as a name."""
    keys = names.where("length(key) > 1").select("key").distinct()
    whole = words.where("length(word) > 1").select("doc_id", "word").distinct()
    each = whole.select("word").distinct()
    starts = keys.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr("key", F.lit(1), n))).alias("word")).distinct()
    begins = each.join(starts, "word", "left_semi")
    sizes = keys.agg(F.collect_set(F.length("key")).alias("sizes"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda p: F.struct((p == 1).alias("first"), F.substr("word", p, n).alias("key")))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("word")), at)))
    cut = each.crossJoin(F.broadcast(sizes)).select("word", F.explode(pieces).alias("x")).select("word", "x.first", "x.key")
    held = cut.join(keys, "key", "left_semi").groupBy("word").agg(F.max("first").alias("first"))
    for n in (1, 2):
        held = _flag(held, F.when(F.length("word") > n, F.substring("word", 1, n)), surnames, f"_s{n}")
    inside = held.where(F.col("first") | ~(F.col("_s1") | F.col("_s2"))).select("word")
    return whole.join(begins.unionByName(inside).distinct(), "word", "left_semi").select("doc_id", "word")


def led_by_segments(words: DataFrame, tokens: DataFrame, raw: DataFrame, phrases: DataFrame, nouns: DataFrame, surnames: DataFrame) -> DataFrame:
    """Words (doc_id, word) after the checks on two and four characters: two that are no phrase need a noun right behind (then
    both together are a word as well) or a surname before; four need a noun at the end and not a phrase in either half."""
    after = F.lead("word").over(Window.partitionBy("doc_id").orderBy("start"))
    pairs = _flag(tokens.withColumn("next", after), F.col("next"), nouns, "noun").where("noun").select("doc_id", "word", "next").distinct()
    w = _flag(_flag(words.select("doc_id", "word").distinct(), F.col("word"), raw, "phrase"), F.substring("word", 1, 1), surnames, "surname")
    two = w.where("length(word) = 2 and not phrase")
    joined = two.join(pairs, ["doc_id", "word"])
    kept = two.join(pairs.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_semi").unionByName(two.where("surname"))
    four = w.where("length(word) = 4").withColumns({"left": F.substring("word", 1, 2), "right": F.substring("word", 3, 2)})
    four = _flag(_flag(_flag(four, F.col("right"), nouns, "noun"), F.col("left"), phrases, "_l"), F.col("right"), phrases, "_r")
    rest = w.where("not (length(word) = 2 and not phrase) and length(word) <> 4")
    parts = [kept.select("doc_id", "word"), joined.select("doc_id", F.concat("word", "next").alias("word")), four.where("noun and not (_l and _r)").select("doc_id", "word"), rest.select("doc_id", "word")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def local(texts: DataFrame, tokens: DataFrame, tables: dict[str, DataFrame], least: int = 2, most: int = 200) -> DataFrame:
    """(doc_id, word, suggested, score, n, first, rank): frequent tokens (doc_id, start, word) of two to five characters,
    thinned by common beginnings and known names, in the order of their first places; book titles besides."""
    names2 = tables.get("names2", tables["names"].limit(0))
    tokens = settled(tokens, "tokens")
    words = settled(N.shortest_per_prefix(N.token_counts(tokens, STOPS, least)).select("doc_id", "word"), "words")
    for _ in range(2):
        words = settled(words.join(N.chained(words, names2, texts), ["doc_id", "word"], "left_anti"), "words")
    words = settled(led_by_segments(words, tokens, tables["raw"], tables["phrases"], tables["nouns"], tables["surnames"]), "words")
    words = words.join(tables["phrases"].select(F.col("key").alias("word")), "word", "left_anti").join(part_of_names(words, names2, tables["surnames"]), ["doc_id", "word"], "left_anti")
    words = words.where(~F.col("word").rlike(f"^[{NUMBER_CHARS}]{{3,}}$")).withColumn("title", F.lit(False))
    titled = N.titles(texts).select("doc_id", F.concat(F.lit("《"), "title", F.lit("》")).alias("word"), F.lit(True).alias("title"))
    every = settled(words.unionByName(titled), "words")
    found = settled(every.join(N.occurrences(texts, every), ["doc_id", "word"]), "found")
    found = suggested(found, tables["nouns"], tables["phrases"].limit(0), tables["phrases"], tables["readings"], F.lit(True))
    found = found.where(F.col("title") | F.contains("suggested", F.lit(" ")))
    found = found.withColumns({"score": F.when(F.col("title"), F.lit(TITLE_SCORE).cast("float")).when(F.col("n") < least, F.lit(0.0).cast("float")).otherwise(N.local_score(F.col("n"), least)), "word": F.when(F.col("title"), F.concat(F.lit("《 "), F.substr("word", F.lit(2), F.length("word") - 2), F.lit(" 》"))).otherwise(F.col("word"))})
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "word"))
    return found.withColumn("rank", order).where(F.col("rank") <= most).select("doc_id", "word", "suggested", "score", "n", "first", "rank")


def refiltered(listed: DataFrame, texts: DataFrame, tables: dict[str, DataFrame], stops: list[str] = STOPS) -> DataFrame:
    """(doc_id, word, spelled, n, listed, rank): an external list of names (doc_id, word) after the checks of a text.

    Words go that are names already, hold digits, quotes or marks, hold a stop string, are part of a name of the second list
    (names2), or are the beginning of a listed word one character longer. The others stay if they stand twice in the text, or
    once with a surname before, a noun behind or in title brackets, and if they have readings. Order: how many entries of the
    list hold the word, then its length and itself.
    """
    names2 = tables.get("names2", tables["names"].limit(0))
    each = listed.where("trim(word) <> ''").select("doc_id", "word")
    words = each.distinct()
    # One longer: a word without its last character, met by equality.
    begun = words.where("length(word) > 1").select("doc_id", F.substr("word", F.lit(1), F.length("word") - 1).alias("word")).distinct()
    kept = words.join(begun, ["doc_id", "word"], "left_anti").join(tables["names"].select(F.col("key").alias("word")).distinct(), "word", "left_anti")
    kept = kept.where(~F.col("word").rlike(MARKS)).join(part_of_names(kept, names2, tables["surnames"]), ["doc_id", "word"], "left_anti")
    kept = settled(kept.where(F.lit(True) if not stops else ~F.col("word").rlike(_any(map(_escaped, stops)))), "kept")
    # How many entries hold a word: an entry meets its document's words in one row, and only those it holds become rows.
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("entry")), lambda a: F.transform(F.sequence(F.lit(1), F.length("entry") - a + 1), lambda n: F.substr("entry", a, n))))
    entries = each.groupBy("doc_id", F.col("word").alias("entry")).agg(F.count("*").alias("times"))
    own = kept.groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    inside = entries.hint("merge").join(own, "doc_id").select("doc_id", "times", F.explode(F.array_intersect(pieces, F.col("words"))).alias("word"))
    counted = inside.groupBy("doc_id", "word").agg(F.sum("times").alias("listed"))
    found = N.occurrences(texts, kept).select("doc_id", "word", "n")
    for n in (1, 2):
        found = _flag(found, F.substring("word", 1, n), tables["surnames"], f"_s{n}")
    for n in (1, 2, 3):
        found = _flag(found, _tail(F.col("word"), n), tables["nouns"], f"_e{n}")
    backed = F.col("_s1") | F.col("_s2") | F.col("_e1") | F.col("_e2") | F.col("_e3") | F.col("word").rlike("《.*》")
    found = found.where((F.col("n") >= 2) | backed).select("doc_id", "word", "n").join(counted, ["doc_id", "word"])
    found = settled(found, "found")
    said = found.join(spelled(found, tables["readings"]), "word").where((F.lower("spelled") != F.lower("word")) & (F.col("spelled") != ""))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("listed"), F.length("word"), "word"))
    return said.select("doc_id", "word", "spelled", "n", "listed", order.alias("rank"))


def _escaped(word: str) -> str:
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", word)


def automatic_threshold(characters):
    """How often a name must occur in a text of this length."""
    return F.when(characters < 50_000, 1).when(characters < 100_000, 2).when(characters < 200_000, 3).otherwise(4)


def review_selection(found: DataFrame, most: int = 25) -> DataFrame:
    """Unknown candidates of middling score, the first of each document's ranking."""
    some = found.where("not known and score >= 0.40 and score <= 0.82")
    return some.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))).where(F.col("nth") <= most).drop("nth")


def decided(found: DataFrame, decisions: DataFrame, least: float = 0.65) -> DataFrame:
    """Candidates after decisions (doc_id, word, accept, confidence, pos): the last on a word counts if it is sure enough; what
    it refuses goes, what it accepts gets both confidences together."""
    last = decisions.where(F.col("confidence") >= least).groupBy("doc_id", "word").agg(F.max_by(F.struct("accept", "confidence"), "pos").alias("d"))
    both = found.join(last, ["doc_id", "word"], "left").where("d is null or d.accept")
    return both.withColumn("score", F.when(F.col("d").isNull(), F.col("score").cast("double")).otherwise(N.combined(F.col("score").cast("double"), F.col("d.confidence").cast("double")))).drop("d")


def sanitised_entities(entities: DataFrame, most: int = 500, size: int = 100) -> DataFrame:
    """Entities (doc_id, word, confidence, pos) trimmed, cut to a length and a number, the first of a word; confidence in 0 to 1."""
    clean = entities.withColumn("word", F.substring(F.trim("word"), 1, size)).where("word <> ''")
    first = clean.groupBy("doc_id", "word").agg(F.min("pos").alias("pos"), F.min_by("confidence", "pos").alias("confidence"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "word"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", "word", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), "pos")


def lists_combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists (key, value, pos): the first, and from the second the keys it lacks, by place."""
    return first.unionByName(second.join(first.select("key"), "key", "left_anti"))
