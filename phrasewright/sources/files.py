"""Text and dictionary files: reading with character-set detection, dictionary folders, and writing back in order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dictionary files by name; the first two must exist.
FILES = {
    "readings": "Resources/ChinesePhienAmWords.txt",
    "phrases": "VietPhrase/VietPhrase.txt",
    "names": "Names.txt",
    "names2": "Names2/123.txt",
    "rules": "LuatNhan.txt",
    "pronouns": "Resources/Pronouns.txt",
    "nouns": "Resources/DanhTu.txt",
    "surnames": "Resources/HoNguoi.txt",
    "suffixes": "Resources/HauTu.txt",
    "ignored": "IgnoredChinesePhrases.txt",
    "lookup": "Resources/LacViet.txt",
}
REQUIRED = ("readings", "phrases")


def read_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """(dict, value): each file of a folder as one row; optional files that are missing are empty."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder)
    path = F.col("_metadata.file_path")
    name = F.coalesce(*(F.when(path.endswith("/" + p), k) for k, p in FILES.items()))
    known = found.select(name.alias("dict"), "value").where("dict is not null")
    present = {r.dict for r in known.select("dict").collect()}
    if missing := [FILES[k] for k in REQUIRED if k not in present]:
        raise FileNotFoundError(f"{folder}: {', '.join(missing)}")
    empty = spark.createDataFrame([(k, "") for k in FILES if k not in present] or [("", "")], "dict string, value string").where("dict <> ''")
    return known.unionByName(empty)


def decoded(content):
    """A column of bytes as text: UTF-16 by its byte order mark, else UTF-8, else GB18030."""
    return F.pandas_udf(_decode, "string")(content)


def _decode(content: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return b.decode("utf-16", "replace")
        try:
            return b.decode("utf-8-sig")
        except UnicodeDecodeError:
            return b.decode("gb18030", "replace")

    return content.map(one)


def read_chapters(spark: SparkSession, path: str, most_bytes: int = 4 << 20) -> DataFrame:
    """(name, text, order): text files up to a size, by natural name order; names that differ only in case are one chapter,
    the one modified last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(path).where(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    last = files.groupBy(F.lower(name).alias("key")).agg(F.max_by(F.struct(name.alias("name"), "content"), F.struct("modificationTime", "path")).alias("x"))
    return last.select("x.name", decoded("x.content").alias("text"), natural_key("key").alias("order"))


def natural_key(name):
    """Text that sorts names by the numbers in them."""
    parts = F.regexp_extract_all(name if not isinstance(name, str) else F.col(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def save_dictionary(pairs: DataFrame, path: str, by_length: bool = True) -> None:
    """key=value lines, longest key first and then by key, or in the order of line_no."""
    order = (F.desc(F.length("key")), F.asc("key")) if by_length else (F.asc("line_no"),)
    pairs.orderBy(*order).select(F.concat("key", F.lit("="), "value").alias("value")).write.mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(entry, action, user, at, line_no) of tab-separated logs with a header."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="entry string, action string, user string, at string")
    return rows.select("entry", "action", "user", F.try_to_timestamp("at").alias("at"), F.monotonically_increasing_id().alias("line_no"))


def chapter_of_page(html, start: str, end: str, removed: list[str] | None = None):
    """The text between two markers of a page, tags stripped, paragraphs and breaks as lines."""
    begin = F.instr(html, F.lit(start))
    rest = F.substr(html, begin + len(start))
    stop = F.instr(rest, F.lit(end))
    body = F.when(begin == 0, F.lit("")).when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)
    for tag in removed or []:
        body = F.regexp_replace(body, rf"(?is)<{re.escape(tag)}\b.*?</{re.escape(tag)}>", "")
    body = F.regexp_replace(body, r"(?i)<(?:/p|br)[^>]*>", "\n")
    return F.trim(F.regexp_replace(body, r"<[^>]*>", ""))
