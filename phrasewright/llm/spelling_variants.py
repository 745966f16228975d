"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words that differ by one
inserted, deleted or replaced code point share exactly one of these strings, so an equi-join on
them finds each such pair once; the pair is then verified on the words themselves. A word's form
is its most frequent neighbour, where that is much more frequent, and its root is where the
forms lead, found by joins that double the distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, mix64, settle, slices

#: Words have at least so many code points and occurrences; a form has so many times the word's occurrences.
SHORTEST, OCCURRENCES, TIMES = 6, 5, 5
#: A run of letters in a document is spelt with a letter less if this divides the checksum of document and run.
SLIPS = 199
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base of the rolling hash, odd and so with an inverse modulo 2^64; code points hashed at a time.
_BASE, _BATCH = 0x9E3779B97F4A7C15, 500_000
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def _without(word, at):
    """A word without the code point at a position from 0."""
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, (at + 2).cast("int"), F.length(word)))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the runs of letters in whole texts, with A-Z in lower case and some spelt with a letter less."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({RUN})"), F.lit(1))).alias("run")
    runs = docs.select("doc_id", run).where(F.length("run") >= shortest)
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    seen = runs.select(low.alias("run"), F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), low)).alias("h"))
    word = F.when(F.col("h") % SLIPS == 0, _without(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    return seen.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _keys(batches):
    """(key, id, at) of each word's own key (at -1) and of those of its distinct single deletions, each by the first position
    that gives it. A key takes a few operations whatever the word's length."""
    for batch in batches:
        ids, words = np.asarray(batch.column("id")), batch.column("word").to_pylist()
        for a, b in slices([len(w) for w in words], _BATCH):
            points, starts = code_points(words[a:b])
            size, of = np.diff(starts), np.repeat(np.arange(b - a), np.diff(starts))
            place = np.arange(len(points)) - starts[of]
            power = np.ones(int(size.max(initial=0)) + 1, dtype=np.uint64)
            power[1:] = np.uint64(_BASE)
            power = np.cumprod(power, dtype=np.uint64)
            each = mix64(points.astype(np.uint64)) * power[place]
            total = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum(each, dtype=np.uint64, out=total[1:])
            whole = total[starts[1:]] - total[starts[:-1]]
            first = np.ones(len(points), dtype=bool)
            first[1:] = (points[1:] != points[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(first)
            before, after = total[at] - total[starts[of[at]]], total[starts[of[at] + 1]] - total[at + 1]
            less = before + after * _BACK
            key = mix64(np.concatenate([whole, less]) ^ mix64(np.concatenate([size, size[of[at]] - 1]).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a:b][np.concatenate([np.arange(b - a), of[at]])]), pa.array(np.concatenate([np.full(b - a, -1), place[at]]).astype(np.int32))], names=["key", "id", "at"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of each two words at a distance of exactly one, in both directions. words: (word, n), settled.

    Keys are numbers and words go with them as numbers too, so a long word costs as many bytes as it has code points and not
    their square. Both numbers may collide: what is joined is verified on the words.
    """
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    keys = settle(named.select("id", "word").mapInArrow(_keys, "key long, id long, at int"), "deletions")
    side = lambda k: keys.select("key", F.col("id").alias(f"id{k}"), F.col("at").alias(f"at{k}"))
    met = side(1).join(side(2), "key").where("id1 < id2").drop("key")
    for k in "12":
        met = met.join(named.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}")), f"id{k}").drop(f"id{k}")
    shared = lambda k: F.when(F.col(f"at{k}") < 0, F.col(f"w{k}")).otherwise(_without(F.col(f"w{k}"), F.col(f"at{k}")))
    sure = met.where((shared(1) == shared(2)) & (F.levenshtein("w1", "w2", 1) == 1))
    way = lambda a, b: F.struct(F.col(f"w{a}").alias("word"), F.col(f"n{a}").alias("n"), F.col(f"w{b}").alias("near"), F.col(f"n{b}").alias("near_n"))
    return sure.select(F.inline(F.array(way(1, 2), way(2, 1))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms lead. Each round joins the table with itself and doubles the distance; a
    form is more frequent than its word, so there are no circles."""
    found = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while found.where("moved").limit(1).count():
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = found.drop("moved").join(further, "root", "left")
        found = settle(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return found.select("word", "root")


def group_variants(docs: DataFrame, shortest: int = SHORTEST, occurrences: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of docs (doc_id, text).

    A word is a run of letters with A-Z in lower case, of at least `shortest` code points and `occurrences` in all texts.
    n_near counts the words that differ from it by one inserted, deleted or replaced code point. form is the one of these with
    the largest n, form_n (ties: the first in code-point order), if form_n >= times * n, else both are null. root is the last
    word that forms lead to, the word itself without one.

    Null and empty texts and such without letters have no words. Rows without doc_id are read as they are spelt. Repeated rows
    count as often as they stand there. Very long runs are words like others. Empty tables give an empty result; other columns
    are ignored.
    """
    words = settle(vocabulary(docs.select("doc_id", "text"), shortest, occurrences), "words")
    best = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    form_n = -F.col("best.less")
    taken = F.col("best").isNotNull() & (form_n >= times * F.col("n"))
    near = settle(best.select("word", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, form_n).alias("form_n")), "near-words")
    led = roots(near.where("form is not null").select("word", "form"))
    joined = words.join(near, "word", "left").join(led, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
