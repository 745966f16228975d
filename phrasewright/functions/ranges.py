"""Ranges between UTF-16 units, code points and UTF-8 bytes, by an index of a text's boundaries.

Editors count UTF-16 units, Spark counts code points, files count bytes. An index holds where
each character begins in units and in bytes, as prefix sums; a range is looked up in it by
binary search. Ranges that begin or end inside a character are refused, and so are those of a
scan that are empty or touch what was blocked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewright.functions import normal
from phrasewright.functions.normal import points


class Boundaries:
    """Where the characters of a text begin, in UTF-16 units and in UTF-8 bytes; the last entry is the text's length."""

    def __init__(self, text: str):
        codes = points(text)
        self.units = np.append(0, np.cumsum(1 + (codes > 0xFFFF).astype(np.int64)))
        self.bytes = np.append(0, np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)))

    def characters(self, start: np.ndarray, length: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last + 1, aligned) of ranges in units (or in what `of` counts): in characters, and whether both ends lie between
        characters of the text."""
        of = self.units if of is None else of
        start, length = np.asarray(start, dtype=np.int64), np.asarray(length, dtype=np.int64)
        first, last = (np.minimum(np.searchsorted(of, x), len(of) - 1) for x in (start, start + length))
        return first, last, (start >= 0) & (length >= 0) & (of[first] == start) & (of[last] == start + length)

    def in_bytes(self, start, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, aligned) in bytes of ranges in units."""
        first, last, ok = self.characters(start, length)
        return self.bytes[first], self.bytes[last] - self.bytes[first], ok

    def in_units(self, start, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, aligned) in units of ranges in bytes."""
        first, last, ok = self.characters(start, length, self.bytes)
        return self.units[first], self.units[last] - self.units[first], ok


class Scanned:
    """A text as the name scan sees it (ignored phrases blanked), with the way back to the text it comes from."""

    def __init__(self, source: str, simplify: dict, known, ignored=()):
        self.text, self.blocked = normal.blanked(source, simplify, known, ignored)
        self.source, self.own = normal.Aligned(source), Boundaries(self.text)
        self.barred = np.append(0, np.cumsum(self.blocked))

    def back(self, start, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, kept) in units of the source of ranges in units of the scanned text; those that are empty, misaligned
        or hold a blocked character aren't kept."""
        first, last, ok = self.own.characters(start, length)
        ok &= (last > first) & (self.barred[last] == self.barred[first])
        ends = np.append(self.source.start + self.source.size, 0)
        begin = np.append(self.source.start, 0)[first]
        return begin, ends[last - 1] - begin, ok


def _each(texts: DataFrame, ranges: DataFrame, schema: str, names: list[str], row) -> DataFrame:
    """Ranges (doc_id, start, length) with their text, once a document; row(text, start, length) gives one array for each name."""
    pairs = ranges.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))).alias("all"))
    joined = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(pairs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")

    def walked(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                every, sizes = batch.column("all"), np.asarray(pc.list_value_length(batch.column("all")))
                flat = every.flatten()
                start, length = (np.asarray(flat.field(i)) for i in (0, 1))
                ends = np.append(0, np.cumsum(sizes))
                parts = [row(text, start[b:e], length[b:e]) for text, b, e in zip(batch.column("text").to_pylist(), ends[:-1], ends[1:], strict=True)]
                columns = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(len(names))]
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), *columns], names=["doc_id", "start", "length", *names])

    return joined.mapInArrow(walked, f"doc_id long, start long, length long, {schema}")


def located(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, start, length, char_start, char_length, byte_start, byte_length, aligned) of ranges in UTF-16 units.

    texts: (doc_id, text); ranges: (doc_id, start, length) without nulls. Ranges of documents that texts lacks are left out;
    null texts are empty. Of a range that isn't aligned, or ends beyond the text, the other numbers are those of the
    characters around it. A document's ranges are looked up together, so its text travels once.
    """

    def row(text, start, length):
        own = Boundaries(text)
        first, last, ok = own.characters(start, length)
        return first, last - first, own.bytes[first], own.bytes[last] - own.bytes[first], ok

    return _each(texts, ranges, "char_start long, char_length long, byte_start long, byte_length long, aligned boolean", ["char_start", "char_length", "byte_start", "byte_length", "aligned"], row)


def mapped_back(texts: DataFrame, ranges: DataFrame, simplify: tuple[str, str] = ("", ""), readings=(), ignored=()) -> DataFrame:
    """(doc_id, start, length, source_start, source_length, kept) of ranges in the scanned text, whose ignored phrases are blanked."""
    known = normal.tables(simplify, readings, ignored)
    return _each(texts, ranges, "source_start long, source_length long, kept boolean", ["source_start", "source_length", "kept"], lambda text, start, length: Scanned(text, *known).back(start, length))
