"""Longest-match translation as joins: candidate spans, acceptance tests, the greedy choice, and rendering.

Every text is searched for all keys of a dictionary at once (`keys`). The greedy left-to-right choice takes, from
the longest span at each position, those that begin where the last ended.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewright.functions.normal import points
from phrasewright.operators import keys as K

_ENDERS = ("\n", "\t", ". ", '"', "'", "? ", "! ", '." ', '?" ', '!" ', ": ")


def candidates(texts: DataFrame, pairs: DataFrame, scan: int = 30) -> DataFrame:
    """(doc_id, start, length, key, value): all dictionary keys of up to `scan` characters in all texts; start from 0. A key that
    stands twice counts once. The dictionary goes to the tasks as a file, so it may have any number of keys."""
    name = K.written({"keys": pairs.where(F.length("key") <= scan).groupBy("key").agg(F.max("value").alias("value"))})

    def found(batches):
        table = K.mapped(name)
        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                start, length, record = table.find(points(text or ""))
                for a in range(0, len(start), 50_000):
                    s, n, r = (x[a : a + 50_000].tolist() for x in (start, length, record))
                    keys = [text[i : i + k] for i, k in zip(s, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(s), pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(keys, pa.string()), pa.array([table.value("keys", x) for x in r], pa.string())], names=["doc_id", "start", "length", "key", "value"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, start int, length int, key string, value string")


def covered_by_longer(spans: DataFrame, floor: int = 0) -> DataFrame:
    """Spans inside which a longer key begins (longer than floor too): those that the overlap test rejects."""
    inner = spans.select("doc_id", F.col("start").alias("s"), F.col("length").alias("n"))
    later = spans.where("length > 1").withColumn("s", F.explode(F.expr("sequence(start + 1, start + length - 1)")))
    return later.join(inner, ["doc_id", "s"]).where(F.col("n") > F.greatest(F.col("length"), F.lit(floor))).select(spans.columns).distinct()


def hiding_names(spans: DataFrame, names: DataFrame) -> DataFrame:
    """Spans inside which a name of two characters or more begins, unless the span is a name itself."""
    own = names.select("key").distinct()
    inner = spans.join(own, "key", "left_semi").where("length >= 2").select("doc_id", F.col("start").alias("s"))
    later = spans.join(own, "key", "left_anti").where("length > 1").withColumn("s", F.explode(F.expr("sequence(start + 1, start + length - 1)")))
    return later.join(inner.distinct(), ["doc_id", "s"], "left_semi").select(spans.columns).distinct()


def longest(texts: DataFrame, pairs: DataFrame, scan: int = 30) -> DataFrame:
    """(doc_id, start, length, value): the greedy longest match from left to right, which is chosen() of all candidates(). A text
    is searched and walked where it lies: no candidate becomes a row, and nothing is grouped."""
    name = K.written({"keys": pairs.where(F.length("key") <= scan).groupBy("key").agg(F.max("value").alias("value"))})

    def walked(batches):
        table = K.mapped(name)
        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                start, length, record = table.find(points(text or ""))
                size, of = np.zeros((2, len(text or "")), dtype=np.int64)
                # Keys come the shortest first, so the longest stays.
                size[start], of[start] = length, record
                at = np.flatnonzero(size)
                taken = at[_greedy(at.tolist(), size[at].tolist())]
                known, which = np.unique(of[taken], return_inverse=True)
                said = pa.array([table.value("keys", r) for r in known.tolist()], pa.string()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(taken), pa.int64()), pa.array(taken, pa.int32()), pa.array(size[taken], pa.int32()), said], names=["doc_id", "start", "length", "value"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(walked, "doc_id long, start int, length int, value string")


def chosen(spans: DataFrame) -> DataFrame:
    """(doc_id, picked array<struct<start, length, value>>): the greedy longest match from left to right."""
    best = spans.groupBy("doc_id", "start").agg(F.max(F.struct("length", "value")).alias("x"))
    rows = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", F.col("x.length").alias("length"), F.col("x.value").alias("value")))).alias("all"))

    def walked(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column("all").slice(i, 1).flatten()
                took = one.take(pa.array(_greedy(one.field("start").to_pylist(), one.field("length").to_pylist()), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(took)], pa.int32()), took)], names=["doc_id", "picked"])

    return rows.mapInArrow(walked, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, picked array<struct<start:int,length:int,value:string>>")


def _greedy(start: list[int], length: list[int]) -> list[int]:
    """Of sorted spans the numbers of those that begin where the last taken one ended, or later."""
    at, taken = 0, []
    for i, (s, n) in enumerate(zip(start, length, strict=True)):
        if s >= at:
            taken.append(i)
            at = s + n
    return taken


def joined(words: list[tuple[str, bool]]) -> str:
    """Words (true) and raw characters (false) as one line of text: words get a space before them unless one is there, and
    begin in upper case after the end of a sentence."""
    out = ""
    for text, is_word in words:
        if not is_word:
            out += text
            continue
        if text[:1] in (",", ".", "?", "!", "") and out.endswith(" "):
            out = out[:-1]
        if out.endswith(_ENDERS) and out:
            text = text[:1].upper() + text[1:]
        elif out[-1:] not in (" ", "("):
            out += " "
        out += text
    return out


def accepted(spans: DataFrame, names: DataFrame | None = None, algorithm: int = 1) -> DataFrame:
    """Spans that a translation may take: none that hide a name, if names go first; but for algorithm 1, none in which a
    longer key begins (algorithm 2: longer than three too), unless they are names that go first."""
    at = ["doc_id", "start", "length", "key"]
    out = spans
    if names is not None:
        out = out.join(hiding_names(spans, names).select(at).distinct(), at, "left_anti")
    if algorithm != 1:
        rejected = covered_by_longer(spans, 0 if algorithm == 0 else 3)
        if names is not None:
            rejected = rejected.join(names.select("key").distinct(), "key", "left_anti")
        out = out.join(rejected.select(at).distinct(), at, "left_anti")
    return out


def _renderer(readings: dict[str, str]):
    def rendered(text: pd.Series, picked: pd.Series) -> pd.Series:
        each, out = lambda part: [(readings.get(c, c), c in readings) for c in part], []
        for t, spans in zip(text, picked, strict=True):
            words, at = [], 0
            for s in spans if spans is not None else ():
                words += each(t[at : s["start"]])
                words.append((s["value"], True))
                at = s["start"] + s["length"]
            out.append(joined(words + each(t[at:])))
        return pd.Series(out, dtype=object)

    return rendered


def translated(texts: DataFrame, pairs: DataFrame, scan: int = 30, readings: dict[str, str] | None = None, names: DataFrame | None = None, algorithm: int = 1) -> DataFrame:
    """(doc_id, translated, n_spans) of each text; characters without a match come as their readings or as they are, null texts are empty."""
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    picks = chosen(accepted(candidates(texts, pairs, scan), names, algorithm))
    return texts.join(picks, "doc_id", "left").select("doc_id", F.pandas_udf(_renderer(readings or {}), "string")("text", "picked").alias("translated"), F.coalesce(F.size("picked"), F.lit(0)).cast("long").alias("n_spans"))


def segments(length, picked):
    """Plain and mapped slices of a text between picked spans, as array<struct<start, length, mapped>>."""
    ends = F.concat(F.array(F.lit(0)), F.transform(picked, lambda s: s["start"] + s["length"]))
    starts = F.concat(F.transform(picked, lambda s: s["start"]), F.array(length))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.struct(z["a"].alias("start"), (z["b"] - z["a"]).alias("length"), F.lit(False).alias("mapped")))
    own = F.transform(picked, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.lit(True).alias("mapped")))
    return F.array_sort(F.filter(F.concat(gaps, own), lambda s: s["length"] > 0))
