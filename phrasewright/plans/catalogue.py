"""The queries of the library's own operators over the driver's tables, with the SQL that gives the same rows.

Documents hold no Chinese, so where a script is needed their letters are projected on
fourteen characters, the same way on both sides.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasewright.functions import answers, normal, numbers, ranges
from phrasewright.functions import text as X
from phrasewright.operators import dictionaries as D
from phrasewright.operators import editing as E
from phrasewright.operators import meanings as W
from phrasewright.operators import mining as M
from phrasewright.operators import names as N
from phrasewright.operators import paragraphs as P
from phrasewright.operators import rules as R
from phrasewright.operators import scan
from phrasewright.operators import segment as G
from phrasewright.operators import spans as S
from phrasewright.sources import files
from phrasewright.sources.shared import folder, settled
from phrasewright.streaming import books

LETTERS, SCRIPT = "etaoinshrdlucm", "他很好红中人甲乙丙丁格尔一二"
READINGS = {"他": "tha", "很": "ngận", "好": "hảo", "红": "hồng", "中": "trung", "人": "nhân", "甲": "giáp", "乙": "ất", "丙": "bính", "丁": "đinh"}
#: Our own entries over the script's characters: (key, value).
PHRASES = {
    "很人": "tân nhân/người mới", "好中甲": "giữa ngọ", "乙红": "sắc đỏ", "红丙人": "thợ son", "他": "y", "中他": "kẻ ấy", "人中他": "kẻ ở giữa", "丙中": "nam trung", "很好人": "người lành/kẻ hiền", "甲人红": "áo đỏ",
    "他红甲": "nét son", "人人": "mọi người", "丁丁": "leng keng", "很甲": "thêm giáp", "好乙很": "gỗ tốt", "乙中": "giữa ất",
}
NAMES, NOUNS = {"丙中": "Nam Trung", "中他": "Trung Tha"}, {"他": "hắn", "丙中": "Nam Trung"}
SURNAMES, SUFFIXES, GRAMMAR = {"甲": "Giáp", "红": "Hồng"}, {"乙好": "tiên sinh", "很丁": "cô nương"}, {"很{n}好": "ở chỗ {n}", "{n}红甲": "{n} mặc đỏ", "乙{s}丁": "thứ {s}"}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _script(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), LETTERS, SCRIPT).alias("text"))


def _pairs(spark, entries: dict[str, str]) -> DataFrame:
    return _local(spark, [("d", i, k, v) for i, (k, v) in enumerate(entries.items())])


def _local(spark, rows: list[tuple]) -> DataFrame:
    """(dict, line_no, key, value) of our own entries. From an Arrow table Spark knows how few they are, and sends them to the other
    side of a join; rows from Python count as endless, so that both sides were shuffled."""
    fields = (("dict", pa.string()), ("line_no", pa.int32()), ("key", pa.string()), ("value", pa.string()))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields]))


_SQL_SCRIPT = f"(SELECT doc_id, translate(lower(text), '{LETTERS}', '{SCRIPT}') AS text FROM documents)"
_SQL_LINES = "(SELECT p_partkey AS line_no, CASE WHEN p_size % 7 = 0 THEN p_brand || '=' || p_type || '=x' WHEN p_size % 5 = 0 THEN '# ' || p_name ELSE p_name || '=' || p_type || '/' || p_brand END AS raw FROM part)"


def _lines(spark, sf_dir) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 7 == 0, F.concat("p_brand", F.lit("="), "p_type", F.lit("=x"))).when(F.col("p_size") % 5 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat("p_name", F.lit("="), "p_type", F.lit("/"), "p_brand"))
    return p.select(F.lit("part").alias("dict"), F.col("p_partkey").alias("line_no"), raw.alias("raw"))


def _sql_values(entries: dict[str, str], columns: str = "key, value") -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in entries.items()) + f") AS v({columns}))"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(f"SELECT key, value FROM (SELECT split_part(raw, '=', 1) AS key, split_part(raw, '=', 2) AS value, row_number() OVER (PARTITION BY split_part(raw, '=', 1) ORDER BY line_no) AS r FROM {_SQL_LINES} WHERE len(string_split(raw, '=')) = 2) WHERE r = 1")
def dict_parse_first_wins(spark, sf_dir):
    """Lines with one '=', the first line of a key."""
    return D.first_wins(D.parse_pairs(_lines(spark, sf_dir))).select("key", "value")


@_query(f"SELECT key, split_part(value, '/', 1) AS value FROM (SELECT split_part(raw, '=', 1) AS key, split_part(raw, '=', 2) AS value, row_number() OVER (PARTITION BY split_part(raw, '=', 1) ORDER BY line_no) AS r FROM {_SQL_LINES} WHERE len(string_split(raw, '=')) = 2) WHERE r = 1 AND length(key) <= 15")
def dict_one_meaning(spark, sf_dir):
    """First meanings of keys short enough to scan for."""
    return D.one_meaning(D.first_wins(D.scannable(D.parse_pairs(_lines(spark, sf_dir))))).select("key", "value")


@_query("""SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY layer, line_no) AS r FROM (
    SELECT c_mktsegment AS key, c_name AS value, c_custkey AS line_no, 1 AS layer FROM customer UNION ALL SELECT n_name, 'n' || n_regionkey, n_nationkey, 0 FROM nation UNION ALL SELECT r_name, 'r', r_regionkey, 2 FROM region)) WHERE r = 1""")
def dict_names_merge(spark, sf_dir):
    """Names of a later list override those of an earlier one, and both come before phrases."""
    first = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("n"), "n_regionkey").alias("value"), F.col("n_nationkey").alias("line_no"))
    second = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("line_no"))
    third = _t(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.lit("r").alias("value"), F.col("r_regionkey").alias("line_no"))
    return D.overlaid(first, second, third)


@_query("SELECT substr(p_name, 1, 1) AS first, CAST(max(length(p_name)) AS INTEGER) AS longest FROM part WHERE p_name <> '' GROUP BY 1")
def key_length_index(spark, sf_dir):
    """The longest key by first character."""
    return D.key_lengths(_t(spark, sf_dir, "part").select(F.col("p_name").alias("key")))


@_query("""WITH e AS (SELECT c_mktsegment || ' ' || (c_custkey % 7) AS key, c_custkey AS line_no, CASE WHEN c_nationkey % 2 = 0 THEN 'new' END AS new FROM customer UNION ALL SELECT p_name, 1000000 + p_partkey, CASE WHEN p_size % 2 = 0 THEN 'new' END FROM part WHERE p_size > 40),
    d AS (SELECT key, min(line_no) AS line_no, arg_min({'v': new}, line_no).v AS new FROM e GROUP BY key),
    l AS (SELECT p_partkey AS line_no, p_name AS key, p_name || '=' || p_type AS raw FROM part), f AS (SELECT key, min(line_no) AS line_no FROM l GROUP BY key),
    a AS (SELECT l.line_no, CASE WHEN d.key IS NOT NULL AND f.line_no IS NOT NULL THEN l.key || '=' || d.new ELSE l.raw END AS raw FROM l LEFT JOIN f ON l.key = f.key AND l.line_no = f.line_no LEFT JOIN d ON l.key = d.key WHERE d.key IS NULL OR d.new IS NOT NULL
    UNION ALL SELECT 1099511627776 + d.line_no, d.key || '=' || d.new FROM d WHERE d.new IS NOT NULL AND d.key NOT IN (SELECT key FROM l))
    SELECT CAST(line_no AS BIGINT) AS line_no, raw FROM a""")
def dict_upsert(spark, sf_dir):
    """Dictionary lines after edits, removals and new keys, in order."""
    p = _t(spark, sf_dir, "part")
    lines = p.select(F.col("p_partkey").alias("line_no"), F.concat("p_name", F.lit("="), "p_type").alias("raw"))
    fresh = _t(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 7).alias("key"), F.col("c_custkey").alias("line_no"), F.when(F.col("c_nationkey") % 2 == 0, "new").alias("new"))
    told = fresh.unionByName(p.where("p_size > 40").select(F.col("p_name").alias("key"), (F.col("p_partkey") + 1_000_000).alias("line_no"), F.when(F.col("p_size") % 2 == 0, "new").alias("new")))
    edits = told.groupBy("key").agg(F.min("line_no").alias("line_no"), F.min_by(F.struct("new"), "line_no").alias("x")).select("key", "line_no", F.col("x.new").alias("value"))
    return D.upserted(lines, edits).select("line_no", "raw")


_SQL_NARROW = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")


@_query(
    f"""SELECT doc_id, md5(translate(replace(replace(replace(replace(text, '  ', ' '), ' ' || chr(13) || chr(10), chr(10)), ' ' || chr(10), chr(10)), ' ,', ','), '{_SQL_NARROW[0]}', '{_SQL_NARROW[1]}')) AS digest
    FROM (SELECT doc_id, replace(replace(replace(replace(text, 'ü', 'ＡＢ'), 'ñ', '  '), 'é', ', '), 'è', '...') AS text FROM documents)"""
)
def narrow_and_punctuation(spark, sf_dir):
    """Punctuation, single-pass space collapses and narrow forms over whole documents."""
    text = _t(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit("ü"), F.lit("ＡＢ")), F.lit("ñ"), F.lit("  ")).alias("text"))
    marked = F.replace(F.replace("text", F.lit("é"), F.lit("，")), F.lit("è"), F.lit("…"))
    return text.select("doc_id", F.md5(X.narrow(X.collapse_spaces(X.punctuation(marked)))).alias("digest"))


@_query("SELECT doc_id, md5(replace(replace(replace(text, 'that', ''), 'tion', ''), 'en', '')) AS digest FROM documents")
def ignored_removal(spark, sf_dir):
    """Ignored phrases removed, longest first."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(X.without("text", ["en", "tion", "that"])).alias("digest"))


@_query(f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: coalesce(map_from_entries([{', '.join(f"('{k}', '{v}')" for k, v in READINGS.items())}])[c], c)), ' ')) AS digest FROM {_SQL_SCRIPT}")
def transliterate(spark, sf_dir):
    """Readings of all characters, a space between every two."""
    return _script(spark, sf_dir).select("doc_id", F.md5(X.transliterated("text", READINGS)).alias("digest"))


@_query("SELECT o_orderkey, CAST(o_custkey % 9999 AS BIGINT) AS value FROM orders")
def numeral_roundtrip(spark, sf_dir):
    """Whole order and customer numbers written as numerals and read back; the SQL has the latter's remainder."""
    read = lambda n: X.numeral_value(X.whole_numerals_of(n))
    return _t(spark, sf_dir, "orders").select(read("o_orderkey").alias("o_orderkey"), (read("o_custkey") % 9999).alias("value"))


@_query("""WITH v AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + o_custkey * 1000003 AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 10000 THEN format('{:,}', n) ELSE
    concat_ws(' ', CASE WHEN n >= 100000000 THEN format('{:,}', n // 100000000) || ' ức' END, CASE WHEN n % 100000000 // 10000 > 0 THEN format('{:,}', n % 100000000 // 10000) || ' vạn' END, CASE WHEN n % 10000 > 0 THEN format('{:,}', n % 10000) END) END AS words FROM v""")
def magnitude_words(spark, sf_dir):
    """Whole numbers in Vietnamese magnitudes."""
    n = F.col("o_orderkey") * 7919 + F.col("o_custkey") * 1000003
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.magnitude_text(n).alias("words"))


@_query("SELECT doc_id, span, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) AS span FROM documents) GROUP BY ALL")
def number_spans(spark, sf_dir):
    """Longest numbers in whole documents; those that only blanks part are one span, which the query cuts again."""
    spans = _t(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.number_spans("text")).alias("x"))
    found = spans.select("doc_id", F.explode(F.split("x.text", "[ \t]+")).alias("span"))
    # Digits and a second fraction without a blank between stand in one span too.
    return found.select("doc_id", F.explode(F.regexp_extract_all("span", F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0))).alias("span")).groupBy("doc_id", "span").agg(F.count("*").alias("n"))


_ALTERNATIVES = "|".join(sorted(PHRASES, key=lambda k: (-len(k), k)))


@_query(f"SELECT doc_id, span AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ALTERNATIVES}')) AS span FROM {_SQL_SCRIPT}) GROUP BY ALL")
def longest_match(spark, sf_dir):
    """The greedy longest match of a phrase dictionary in whole documents, counted by key."""
    pairs = _pairs(spark, {k: k for k in PHRASES})
    return S.longest(_script(spark, sf_dir), pairs).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def _dictionaries(spark) -> DataFrame:
    kinds = {"vietphrase": PHRASES, "names": NAMES, "pronouns": NOUNS, "surnames": SURNAMES, "suffixes": SUFFIXES, "readings": READINGS, "rules": GRAMMAR}
    return _local(spark, [(d, i, k, v) for d, entries in kinds.items() for i, (k, v) in enumerate(entries.items())])


@_query()
def translate_documents(spark, sf_dir):
    """Whole documents normalised and translated: phrases by first meaning, names first, rules, numbers, readings."""
    found = scan.translated(_script(spark, sf_dir), scan.lexicon(_dictionaries(spark), one_meaning=True), normalise=True, ranges=False)
    return found.select("doc_id", "translated", "n_spans")


@_query()
def translate_ranges(spark, sf_dir):
    """Where each piece of a translation comes from and where it stands, for whole conversation turns, with the slices of both."""
    turns = _turns(spark, sf_dir).distinct()
    found = scan.translated(turns, scan.lexicon(_dictionaries(spark), one_meaning=True), normalise=True)
    pieces = found.select("doc_id", F.posexplode(F.arrays_zip("source_ranges", "target_ranges")).alias("nth", "x"))
    return pieces.select("doc_id", "nth", F.col("x.source_ranges.start").alias("start"), F.col("x.source_ranges.length").alias("length"), F.col("x.target_ranges.start").alias("said_at"), F.col("x.target_ranges.length").alias("said_length"))


@_query()
def rule_best_match(spark, sf_dir):
    """The rule that applies first in each conversation turn, and what it says."""
    lex = scan.lexicon(_dictionaries(spark))
    found = _turns(spark, sf_dir).distinct().select("doc_id", R.best_match("text", lex.name, lex.rules).alias("m"))
    return found.where("m is not null").select("doc_id", "m.index", "m.length", "m.key", "m.rendered")


def _sql_numeral(n: str) -> str:
    digit = lambda k: f"({n} // {k} % 10)"
    return " || ".join(f"CASE WHEN {digit(k)} > 0 THEN substr('一二三四五六七八九', CAST({digit(k)} AS INTEGER), 1) || '{u}' ELSE '' END" for k, u in ((1000, "千"), (100, "百"), (10, "十"), (1, "")))


@_query("""SELECT o_orderkey, CASE WHEN day(o_orderdate) < 10 THEN 'mùng ' ELSE 'ngày ' END || day(o_orderdate) || ' tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) AS said FROM orders""")
def rule_render(spark, sf_dir):
    """Order dates as numerals, read by a date rule."""
    rules = spark.createDataFrame([("{s}年{s}月{s}号", "ngày {3} tháng {2} năm {1}")], "key string, value string")
    matcher = R.Rules([r.asDict() for r in R.prepared(rules).collect()])
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), X.numerals_of(F.month("o_orderdate")), F.lit("月"), F.dayofmonth("o_orderdate").cast("string"), F.lit("号"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", R.best_match(text, matcher)["rendered"].alias("said"))


@_query("""WITH v AS (SELECT p_partkey, CAST(p_size // 10 AS BIGINT) AS a, CAST(p_size % 10 AS BIGINT) AS b FROM part)
    SELECT p_partkey, CASE WHEN a > 0 AND a < b THEN a || '-' || b || ' vạn' WHEN a = 0 AND b > 0 THEN b || ' vạn' END AS several,
    CASE WHEN a > 0 AND b > 0 THEN (20 + a) || '-' || (20 + b) END AS tens FROM v WHERE NOT (a > 0 AND a >= b)""")
def number_ranges(spark, sf_dir):
    """Part sizes as ranges of numerals, read back."""
    digit = lambda c: F.element_at(F.split(F.lit("零一二三四五六七八九"), ""), (F.col(c) + 1).cast("int"))
    p = _t(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_size") / 10).alias("a"), (F.col("p_size") % 10).alias("b")).where("not (a > 0 and a >= b)")
    pair = F.concat(F.when(F.col("a") > 0, digit("a")).otherwise(""), digit("b"))
    several = F.when(F.col("b") > 0, numbers.number_phrase(F.concat(pair, F.lit("万"))))
    return p.select("p_partkey", several.alias("several"), F.when((F.col("a") > 0) & (F.col("b") > 0), numbers.number_range(F.concat(F.lit("二十"), pair))).alias("tens"))


@_query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&')) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '&([#a-zA-Z0-9]*)', '[\\1]', 'g'), '\\[(lt|gt|quot|nbsp|amp)\\];', '&\\1;', 'g') AS html FROM pages)")
def entity_decode(spark, sf_dir):
    """Character references of whole pages decoded; others than five common ones are put in brackets first."""
    marked = F.regexp_replace(F.coalesce("html", F.lit("")), "&([#a-zA-Z0-9]*)", "[$1]")
    marked = F.regexp_replace(marked, r"\[(lt|gt|quot|nbsp|amp)\];", "&$1;")
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(normal.decoded_entities(marked)).alias("digest"))


@_query("""SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY layer, line_no) AS r FROM (
    SELECT n_name AS key, 'name' AS value, n_nationkey AS line_no, 0 AS layer FROM nation UNION ALL SELECT p_name, 'patch', p_partkey, 1 FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_type, p_partkey, 2 FROM part)) WHERE r = 1""")
def dict_patch_overlay(spark, sf_dir):
    """Names, then patches, then phrases: the first that has the key."""
    p = _t(spark, sf_dir, "part").select(F.col("p_name").alias("key"), "p_type", "p_size", F.col("p_partkey").alias("line_no"))
    names = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit("name").alias("value"), F.col("n_nationkey").alias("line_no"))
    patch = p.where("p_size > 25").select("key", F.lit("patch").alias("value"), "line_no")
    return D.overlaid(names, patch, p.select("key", F.col("p_type").alias("value"), "line_no"))


@_query("""SELECT p_brand AS dict, CAST(sum(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS entries, CAST(sum(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS raw,
    md5(string_agg(CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_name || '=' || p_type END, chr(13) || chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand""")
def dict_round_trip(spark, sf_dir):
    """Dictionary files cut to records, counted, and written again as they were."""
    line = F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("="), "p_type"))
    each = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dict")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("raw")))).alias("all"))
    given = each.select("dict", F.array_join("all.raw", "\r\n").alias("value"))
    found = E.records(given)
    return E.statistics(found).join(E.serialised(found, E.documents(given)), "dict").select("dict", "entries", "raw", F.md5("value").alias("digest"))


@_query("SELECT doc_id, md5(CASE WHEN t = '' THEN '' ELSE t || chr(10) END) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r?\\n', chr(10), 'g'), '[ \\t\\r\\f\\v]+\\n', chr(10), 'g') || chr(10), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS t FROM (SELECT doc_id, regexp_replace(text, '^[ \\t\\n]+', '') AS text FROM documents))")
def laid_out_documents(spark, sf_dir):
    """Whole documents with blocks of lines parted by one empty line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n]+", "")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(E.laid_out(text)).alias("digest"))


@_query()
def name_filter_hybrid(spark, sf_dir):
    """Name candidates of conversation turns with their facts, scores and suggestions."""
    make = lambda entries: _pairs(spark, entries).select("key", "value")
    tables = {"surnames": make(SURNAMES), "nouns": make({"中": "{0} trung"}), "suffixes": make(SUFFIXES), "names": make(NAMES), "raw": make(PHRASES), "phrases": D.one_meaning(make(PHRASES)), "readings": make(READINGS)}
    return M.hybrid(_turns(spark, sf_dir).distinct(), tables, "[" + "".join(READINGS) + "]", longest=4, most=20)


@_query("""WITH t AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)), k AS (SELECT unnest(['the', 'ent', 'tion', 'an']) AS key)
    SELECT DISTINCT doc_id, word FROM t, k WHERE length(word) > 1 AND (starts_with(key, word) OR contains(word, key))""")
def part_of_names(spark, sf_dir):
    """Words of whole documents that begin a name or hold one, as if none had a surname."""
    names = _pairs(spark, dict.fromkeys(("the", "ent", "tion", "an"), "x"))
    return M.part_of_names(_tokens(spark, sf_dir), names, names.limit(0))


_SQL_TINY = "(SELECT conv_id * 1000 + turn AS doc_id, translate(lower(text), '%s', '%s') AS text FROM conversations)" % (LETTERS, SCRIPT)
_SQL_SPANS = f"(SELECT doc_id, CAST(s - 1 AS INTEGER) AS start, length(key) AS length, key FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS s FROM {_SQL_TINY}), {_sql_values(PHRASES)} WHERE substr(text, s, length(key)) = key)"


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.translate(F.lower("text"), LETTERS, SCRIPT).alias("text"))


@_query(f"WITH s AS (SELECT DISTINCT * FROM {_SQL_SPANS}) SELECT DISTINCT a.doc_id, a.start, CAST(a.length AS INTEGER) AS length, a.key FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.start > a.start AND b.start < a.start + a.length AND b.length > a.length")
def overlap_reject(spark, sf_dir):
    """Spans in which a longer key begins."""
    return S.covered_by_longer(S.candidates(_turns(spark, sf_dir).distinct(), _pairs(spark, PHRASES))).select("doc_id", "start", "length", "key")


@_query(f"WITH s AS (SELECT DISTINCT * FROM {_SQL_SPANS}) SELECT DISTINCT a.doc_id, a.start, CAST(a.length AS INTEGER) AS length, a.key FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.start > a.start AND b.start < a.start + a.length WHERE b.key IN ('中人', '乙他', '中他', '乙中') AND a.key NOT IN ('中人', '乙他', '中他', '乙中')")
def name_cover(spark, sf_dir):
    """Spans that hide the beginning of a name."""
    names = _pairs(spark, {"中人": "", "乙他": "", "中他": "", "乙中": ""})
    return S.hiding_names(S.candidates(_turns(spark, sf_dir).distinct(), _pairs(spark, PHRASES)), names).select("doc_id", "start", "length", "key")


@_query("SELECT conv_id, turn, md5(upper(substr(t, 1, 1)) || substr(t, 2)) AS digest FROM (SELECT conv_id, turn, regexp_replace(replace(text, 'ß', 's'), '^\\s+', '') AS t FROM conversations)")
def prettified(spark, sf_dir):
    """Conversation turns without leading blanks, first letter in upper case."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.pretty(F.replace("text", F.lit("ß"), F.lit("s")))).alias("digest"))


@_query("""WITH q AS (SELECT p_partkey AS id, substr(trim(p_name), 1, 20) AS t FROM part), d AS (SELECT key, min_by(value, id) AS value FROM (SELECT split_part(p_name, ' ', 1) AS key, p_brand AS value, p_partkey AS id FROM part UNION ALL SELECT substr(p_name, 1, 1), p_type, p_partkey FROM part) GROUP BY key),
    pr AS (SELECT DISTINCT id, substr(t, 1, n) AS source FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS n FROM q) UNION SELECT DISTINCT id, unnest(string_split(t, '')) FROM q)
    SELECT id, source, value AS definition FROM pr JOIN d ON source = key""")
def meaning_lookup(spark, sf_dir):
    """Definitions of the beginnings and characters of part names."""
    p = _t(spark, sf_dir, "part")
    entries = p.select(F.split("p_name", " ")[0].alias("key"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("line_no")).union(p.select(F.substring("p_name", 1, 1), "p_type", "p_partkey"))
    return D.look_up(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), D.first_wins(entries)).select("id", "source", "definition")


@_query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE regexp_matches(ch, '[^\\x00-\\x7F]') AND ch NOT IN ('é', 'ü', 'ñ') GROUP BY ch")
def missing_readings(spark, sf_dir):
    """Letters beyond ASCII without a reading."""
    known = _pairs(spark, {"é": "e", "ü": "u", "ñ": "n"})
    return D.missing_readings(_t(spark, sf_dir, "documents"), known, r"[^\x00-\x7F]")


@_query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) BETWEEN 2 AND 5 AND NOT contains(word, 'th') AND NOT contains(word, 'en') GROUP BY ALL HAVING count(*) >= 3")
def token_frequencies(spark, sf_dir):
    """Frequent short tokens without stop strings."""
    return N.token_counts(_tokens(spark, sf_dir), ["th", "en"], 3)


def _tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@_query("SELECT doc_id, word FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 2) QUALIFY row_number() OVER (PARTITION BY doc_id, substr(word, 1, 2) ORDER BY length(word), word) = 1")
def shortest_per_prefix(spark, sf_dir):
    """The shortest token of each two-letter beginning."""
    return N.shortest_per_prefix(_tokens(spark, sf_dir).where("length(word) >= 2"))


@_query("SELECT doc_id, gram, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS doc_id, substr(text, s, n) AS gram FROM (SELECT conv_id, turn, text, n, unnest(range(1, length(text) - n + 2)) AS s FROM conversations, (VALUES (2), (3)) v(n))) WHERE regexp_full_match(gram, '[a-z]+') GROUP BY ALL")
def ngram_seeds(spark, sf_dir):
    """Letter bigrams and trigrams of conversation turns."""
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return N.ngrams(turns, 2, 3, "[a-z]").groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


@_query("SELECT DISTINCT doc_id, title FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<p>([^<\\n]*)<', 1)) AS title FROM pages) WHERE title <> ''")
def bracketed_titles(spark, sf_dir):
    """What stands between two brackets of a page on one line, once each."""
    return N.titles(_t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "<p>", "<")


_SQL_FOUND = "(SELECT o_custkey AS doc_id, o_orderpriority AS word, count(*) AS n, bool_or(o_orderstatus = 'F') AS trigger, bool_or(o_totalprice > 200000) AS surname, bool_or(o_orderkey % 3 = 0) AS token, bool_or(o_orderkey % 5 = 0) AS suffix, bool_or(o_custkey % 7 = 0) AS remainder, bool_or(o_orderkey % 11 = 0) AS common, bool_or(o_orderstatus = 'P') AS known, CAST(min(o_orderkey) AS BIGINT) AS first FROM orders GROUP BY ALL)"
_SQL_EVIDENCE = (("token", 0.12), ("trigger", 0.3), ("surname", 0.3), ("suffix", 0.2), ("remainder", 0.25))
_SQL_SCORE = "0.18::FLOAT + (0.07::FLOAT * least(n, 4)::FLOAT)"
for _flag, _weight in _SQL_EVIDENCE:
    _SQL_SCORE = f"({_SQL_SCORE}) + CASE WHEN {_flag} THEN {_weight}::FLOAT ELSE 0::FLOAT END"
_SQL_SCORE = f"greatest(0::FLOAT, least(0.99::FLOAT, ({_SQL_SCORE}) + CASE WHEN common THEN -0.12::FLOAT WHEN token THEN 0.1::FLOAT ELSE 0::FLOAT END))"


def _found(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("word")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("trigger"), F.bool_or(F.col("o_totalprice") > 200000).alias("surname"), F.bool_or(F.col("o_orderstatus") == "P").alias("known"), F.min("o_orderkey").alias("first"),
        *(F.bool_or(F.col(c) % k == 0).alias(name) for name, c, k in (("token", "o_orderkey", 3), ("suffix", "o_orderkey", 5), ("remainder", "o_custkey", 7), ("common", "o_orderkey", 11))),
    )
    return o.withColumn("score", N.hybrid_score(*map(F.col, ("n", "token", "trigger", "surname", "suffix", "remainder", "common"))))


@_query(f"SELECT doc_id, word, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY known DESC, score DESC, n DESC, first, word) AS rank FROM (SELECT *, {_SQL_SCORE} AS score FROM {_SQL_FOUND})) WHERE rank <= 3")
def candidate_ranking(spark, sf_dir):
    """The three best candidates of each document by the hybrid score."""
    return N.ranked(_found(spark, sf_dir), 3).select("doc_id", "word", "score", "rank")


@_query("""WITH w AS (SELECT l_suppkey AS doc_id, substr(w, 1, k) AS word, count(*) AS n FROM (SELECT l_suppkey, l_shipdate, strftime(l_shipdate, '%Y%m') AS w FROM lineitem), (VALUES (4), (5), (6)) v(k) GROUP BY ALL), s AS (SELECT *, (n % 10)::FLOAT / 10::FLOAT AS score FROM w),
    p AS (SELECT DISTINCT a.doc_id, a.word FROM s a JOIN s b ON a.doc_id = b.doc_id AND length(b.word) < length(a.word) AND (starts_with(a.word, b.word) OR ends_with(a.word, b.word)) AND b.n >= a.n AND b.score >= a.score + 0.15::FLOAT)
    SELECT doc_id, word, n FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND p.word = s.word)""")
def nested_pruning(spark, sf_dir):
    """Candidates that no part of theirs beats."""
    w = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.date_format("l_shipdate", "yyyyMM").alias("w"), F.explode(F.array(*map(F.lit, (4, 5, 6)))).alias("k"))
    s = w.groupBy("doc_id", F.substr("w", F.lit(1), F.col("k")).alias("word")).agg(F.count("*").alias("n"))
    s = s.withColumn("score", ((F.col("n") % 10).cast("float") / F.lit(10).cast("float")).cast("float"))
    return N.pruned(s).select("doc_id", "word", "n")


@_query("""WITH f AS (SELECT doc_id, lang AS word, CAST(0.5 AS DOUBLE) AS score FROM documents), e AS (SELECT doc_id, 'en' AS word, (quality + 1) / 2.5 AS confidence FROM labels UNION ALL SELECT doc_id, 'xx', (toxic + 2) / 4.0 FROM labels),
    s AS (SELECT doc_id, word, CAST(confidence AS DOUBLE) AS confidence FROM e WHERE confidence >= 0.65)
    SELECT doc_id, word, round(CASE WHEN score IS NOT NULL AND confidence IS NOT NULL THEN 1 - (1 - score) * (1 - confidence) ELSE coalesce(score, confidence) END, 6) AS score FROM f FULL JOIN s USING (doc_id, word)""")
def entity_merge(spark, sf_dir):
    """Mined candidates joined with entities from elsewhere."""
    found = _t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("word"), F.lit(0.5).alias("score"))
    labels = _t(spark, sf_dir, "labels")
    told = labels.select("doc_id", F.lit("en").alias("word"), ((F.col("quality") + 1) / 2.5).alias("confidence"), F.lit(0).alias("pos")).union(labels.select("doc_id", F.lit("xx"), (F.col("toxic") + 2) / 4.0, F.lit(1)))
    none = spark.createDataFrame([], "word string")
    return N.merged_entities(found, told, none).select("doc_id", "word", F.round("score", 6).alias("score"))


@_query("""WITH s AS (SELECT doc_id, text, len(string_split(text, 'the')) AS k, string_split(text, 'the') AS parts FROM documents WHERE contains(text, 'the')),
    p AS (SELECT doc_id, text, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + 3 * (i - 1) + 1 AS p FROM (SELECT *, unnest(range(1, least(k, 4))) AS i FROM s))
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS nth, substr(text, greatest(1, p - 36), p - greatest(1, p - 36)) || '【the】' || substr(text, p + 3, 36) AS context FROM p""")
def contexts(spark, sf_dir):
    """What stands around the first three places of a word."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(N.contexts(F.col("text"), F.lit("the"))).alias("nth", "context"))


@_query("SELECT hit, found, gold, round(hit / found, 9) AS precision, round(hit / gold, 9) AS recall FROM (SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1 AND quality = 1) AS hit, (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1) AS found, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1) AS gold)")
def retrieval_quality(spark, sf_dir):
    """Precision and recall of one set of keys against another."""
    labels = _t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "key")
    return N.quality(labels.where("toxic = 1"), labels.where("quality = 1")).select("hit", "found", "gold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@_query("SELECT doc_id, n, paragraph, start FROM (SELECT doc_id, trim(raw) AS paragraph, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) AS INTEGER) AS n, CAST(before + length(raw) - length(ltrim(raw)) AS BIGINT) AS start FROM (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)) WHERE trim(raw) <> '')")
def paragraph_ranges(spark, sf_dir):
    """Paragraphs of whole documents with their places."""
    return P.paragraphs(_t(spark, sf_dir, "documents"))


@_query()
def paragraph_alignment(spark, sf_dir):
    """Paragraphs labelled, read back from a model's answer that lost every third, and completed from the source."""
    parts = P.paragraphs(_t(spark, sf_dir, "documents"))
    answer = P.labelled(parts.where("n % 3 <> 0").withColumn("paragraph", F.upper("paragraph")))
    return P.aligned(parts, P.parsed_labels(answer), P.parsed_labels(answer).where("1 = 0")).select("doc_id", "n", F.md5("text").alias("digest"))


@_query()
def line_chunks(spark, sf_dir):
    """Chunks of whole lines up to 1,000 characters."""
    return P.line_chunks(_t(spark, sf_dir, "documents"), 1000).select("doc_id", "chunk", F.length("text").alias("size"), F.md5("text").alias("digest"))


RULES = {"digits left": "[0-9]{4,}", "shouting": "[A-Z]{6,}", "double space": "  ", "address": "@[a-z0-9]+"}


@_query(f"SELECT doc_id, CAST(line AS INTEGER) AS line, message, substr(raw, 1, 120) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), {_sql_values(RULES, 'message, pattern')} WHERE regexp_matches(raw, pattern)")
def rule_violations(spark, sf_dir):
    """Lines that break a rule."""
    rules = spark.createDataFrame(list(RULES.items()), "message string, pattern string")
    return P.violations(_t(spark, sf_dir, "documents"), rules)


@_query("SELECT entry, arg_max(action, k) AS action, max(ts) AS last_at FROM (SELECT user_id AS entry, event_type AS action, ts, {'a': ts, 'b': event_id} AS k FROM events) GROUP BY entry")
def history_compaction(spark, sf_dir):
    """The last action on each entry."""
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), F.col("event_type").alias("action"), F.lit("u").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("line_no"))
    return D.compacted_history(log).select("entry", "action", F.col("at").alias("last_at"))


@_query("SELECT user_id AS id, min(s) AS start, max(e) AS \"end\" FROM (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, event_id // 50 AS s, event_id // 50 + 20 AS e FROM events))) GROUP BY user_id, island")
def interval_coalesce(spark, sf_dir):
    """Overlapping ranges of each user as one."""
    at = F.expr("event_id div 50")
    return P.coalesced(_t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), at.alias("start"), (at + 20).alias("end")))


@_query("SELECT book, key, action FROM (SELECT user_id AS book, event_id % 10 AS key, arg_max(CASE WHEN event_id % 3 = 0 THEN 'accept' WHEN event_id % 3 = 1 THEN 'reject' ELSE 'undo' END, event_id) AS action FROM events GROUP BY ALL) WHERE action <> 'undo'")
def memory_fold(spark, sf_dir):
    """Accepted and rejected names after all decisions."""
    action = F.when(F.col("event_id") % 3 == 0, "accept").when(F.col("event_id") % 3 == 1, "reject").otherwise("undo")
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("book"), (F.col("event_id") % 10).alias("key"), F.lit("v").alias("value"), action.alias("action"), F.col("event_id").alias("at"))
    return N.memory(events).select("book", "key", "action")


@_query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(CASE WHEN b = 0 THEN '' WHEN instr(r, '</article>') > 0 THEN substr(r, 1, instr(r, '</article>') - 1) ELSE r END, '<(?:/p|br)[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'))) AS digest FROM (SELECT page_id, instr(html, '<article>') AS b, substr(html, instr(html, '<article>') + 9) AS r FROM pages)")
def page_chapters(spark, sf_dir):
    """The chapter between two markers of a page."""
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(files.chapter_of_page(F.col("html"), "<article>", "</article>")).alias("digest"))


@_query("""WITH v AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000000000000 + CAST(o_custkey AS BIGINT) * 99991 AS n FROM orders), h AS (SELECT o_orderkey, n // 100000000 AS high, n % 100000000 AS rest FROM v),
    g AS (SELECT *, concat_ws(' ', CASE WHEN high // 100000000 > 0 THEN format('{:,}', high // 100000000) || ' ức' END, CASE WHEN high % 100000000 // 10000 > 0 THEN format('{:,}', high % 100000000 // 10000) || ' vạn' END, CASE WHEN high % 10000 > 0 THEN format('{:,}', high % 10000) END) AS said FROM h)
    SELECT o_orderkey, concat_ws(' ', CASE WHEN high > 0 THEN said || ' ức' END, CASE WHEN rest // 10000 > 0 THEN format('{:,}', rest // 10000) || ' vạn' END, CASE WHEN rest % 10000 > 0 THEN format('{:,}', rest % 10000) END) AS words FROM g""")
def magnitude_words_far(spark, sf_dir):
    """Numbers beyond 10^12, whose ức are counted in ức and vạn themselves."""
    n = F.col("o_orderkey").cast("long") * F.lit(10**12) + F.col("o_custkey").cast("long") * 99991
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.magnitude_text(n).alias("words"))


_REFERENCES = (("&", "＆"), ("é", "&#233;"), ("ç", "&ccedil;"), ("à", "&#xE0;"), ("ß", "&szlig;"), ("ü", "&uuml;"), ("ñ", "&ntilde;"), ("that", "&apos;"), ("of", "&#x1F600;"), ("die", "&nope;"))


@_query("SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '＆'), 'ü', '&uuml;'), 'ñ', '&ntilde;'), 'that', chr(39)), 'of', '😀'), 'die', '&nope;')) AS digest FROM documents")
def entity_decode_legacy(spark, sf_dir):
    """Whole documents with references for some letters decoded as the normaliser does: by number, and by the names it knows."""
    text = F.coalesce("text", F.lit(""))
    for plain, reference in _REFERENCES:
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(normal.decoded_entities(text, legacy=True)).alias("digest"))


def _astral(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("😀")).alias("text"))


def _piece_ranges(texts: DataFrame) -> DataFrame:
    """(doc_id, start, length) in UTF-16 units of what stands between blanks."""
    pieces = texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("nth", "piece")).withColumn("length", X.utf16_length(F.col("piece")).cast("long"))
    before = F.sum(F.col("length") + 1).over(Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pieces.select("doc_id", (before - F.col("length") - 1).alias("start"), "length")


@_query("""WITH p AS (SELECT doc_id, unnest(string_split(t, ' ')) AS piece, generate_subscripts(string_split(t, ' '), 1) AS nth FROM (SELECT doc_id, replace(coalesce(text, ''), 'e', '😀') AS t FROM documents)),
    s AS (SELECT doc_id, nth, piece, length(piece) + length(piece) - length(replace(piece, '😀', '')) AS u, strlen(piece) AS b FROM p),
    r AS (SELECT *, sum(u + 1) OVER w - u - 1 AS start, sum(b + 1) OVER w - b - 1 AS byte_start, sum(length(piece) + 1) OVER w - length(piece) - 1 AS char_start FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS starts, sum(char_start)::BIGINT AS char_starts, sum(byte_start)::BIGINT AS byte_starts, sum(b)::BIGINT AS bytes, count(*) FILTER (WHERE starts_with(piece, '😀')) AS inside FROM r GROUP BY doc_id""")
def range_round_trip(spark, sf_dir):
    """What stands between blanks of whole documents, located in UTF-16 units, characters and bytes; inside: how many ranges are
    refused when they begin a unit later, in the middle of a character."""
    texts = _astral(spark, sf_dir)
    found = _piece_ranges(texts)
    later = found.where("length > 0").select("doc_id", (F.col("start") + 1).alias("start"), (F.col("length") - 1).alias("length"))
    located = ranges.located(texts, found).groupBy("doc_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"{c}s") for c in ("start", "char_start", "byte_start")), F.sum("byte_length").alias("bytes"))
    refused = ranges.located(texts, later).groupBy("doc_id").agg(F.sum(F.when(F.col("aligned"), 0).otherwise(1)).alias("inside"))
    return located.join(refused, "doc_id", "left").withColumn("inside", F.coalesce("inside", F.lit(0).cast("long")))


@_query()
def name_scan_ranges(spark, sf_dir):
    """Per document: how many ranges between blanks the name scan may map back to the source, and where these lie, after ignored
    phrases were blanked."""
    texts = _astral(spark, sf_dir)
    mapped = ranges.mapped_back(texts, _piece_ranges(texts), ignored=["th😀", "ing", "tion"])
    return mapped.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("kept"), F.sum(F.when(F.col("kept"), F.col("source_start") + F.col("source_length"))).alias("ends"))


def _frequent_words(spark, sf_dir) -> DataFrame:
    """(word, n): what stands often in conversation turns, and the phrases."""
    grams = N.ngrams(_turns(spark, sf_dir), 1, 3, f"[{SCRIPT}]").groupBy(F.col("gram").alias("word")).agg(F.count("*").alias("n")).where("n >= 5")
    return grams.unionByName(spark.createDataFrame([(k, 5) for k in PHRASES], "word string, n long")).groupBy("word").agg(F.max("n").alias("n")).transform(settled)


@_query()
def segmented_words(spark, sf_dir):
    """Words of whole documents by the best path and the hidden Markov model, counted."""
    tokens = G.segmented(_script(spark, sf_dir), _frequent_words(spark, sf_dir), inside=SCRIPT)
    return tokens.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@_query()
def name_filter_local(spark, sf_dir):
    """Name candidates of conversation turns by their segments alone."""
    make = lambda entries: _pairs(spark, entries).select("key", "value")
    tables = {"surnames": make(SURNAMES), "nouns": make({"中": "{0} trung"}), "names": make(NAMES), "raw": make(PHRASES), "phrases": D.one_meaning(make(PHRASES)), "readings": make(READINGS)}
    turns = _turns(spark, sf_dir).where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return M.local(turns, G.segmented(turns, _frequent_words(spark, sf_dir), inside=SCRIPT), tables, most=20)


@_query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders)
    SELECT o_custkey, count(*) FILTER (WHERE read AND o_orderkey % 9 > 0) AS n_items, sum(CASE WHEN o_orderkey % 4 = 0 THEN 0.75 ELSE 0.5 END) FILTER (WHERE read AND o_orderkey % 9 > 0)::DOUBLE AS confidence,
    CAST(count(*) FILTER (WHERE read AND o_orderkey % 9 = 0) + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_refused, o_custkey % 3 = 0 AS cut
    FROM (SELECT *, o_custkey % 3 > 0 OR back > 1 AS read FROM o) GROUP BY o_custkey""")
def model_answers(spark, sf_dir):
    """Entities read back from answers in fences and inside other JSON, every third of them cut off; some items have no text, some
    no confidence."""
    key = F.col("o_orderkey")
    item = F.struct(F.when(key % 9 > 0, F.concat(F.lit("order "), key.cast("string"))).alias("text"), F.col("o_orderpriority").alias("entityType"), F.when(key % 4 > 0, 0.5).alias("confidence"))
    each = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]).alias("entities"))
    said = F.to_json(F.struct("entities"))
    cut, fence = F.col("o_custkey") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), said)
    answer = F.when(cut, F.substr(fence, F.lit(1), F.length(fence) - 10)).when(F.col("o_custkey") % 3 == 1, F.concat(fence, F.lit("\n```\nDone."))).otherwise(F.to_json(F.struct(said.alias("content"))))
    read = each.select("o_custkey", cut.alias("cut"), answers.entities(answer).alias("x")).select("o_custkey", "cut", "x.items", "x.refused")
    told = F.when(F.size("items") > 0, F.aggregate("items", F.lit(0.0), lambda a, i: a + i["confidence"]))
    return read.select("o_custkey", F.size("items").cast("long").alias("n_items"), told.alias("confidence"), F.size("refused").alias("n_refused"), "cut")


@_query("""WITH x AS (SELECT conv_id * 1000 + turn AS doc_id, max(lower(text)) AS text FROM conversations GROUP BY 1), e AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{3,}')) AS word FROM x) GROUP BY ALL),
    k AS (SELECT doc_id, word FROM e WHERE word NOT IN ('the', 'and', 'that') AND NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = e.doc_id AND length(b.word) = length(e.word) + 1 AND starts_with(b.word, e.word))),
    c AS (SELECT k.doc_id, k.word, sum(e.times)::BIGINT AS listed FROM k JOIN e ON e.doc_id = k.doc_id AND contains(e.word, k.word) GROUP BY ALL),
    n AS (SELECT k.doc_id, k.word, CAST((length(text) - length(replace(text, word, ''))) // length(word) AS BIGINT) AS n FROM k JOIN x USING (doc_id))
    SELECT doc_id, word, array_to_string(list_transform(string_split(word, ''), lambda c: upper(c) || 'i'), ' ') AS spelled, n, listed, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY listed DESC, length(word), word) AS INTEGER) AS rank
    FROM n JOIN c USING (doc_id, word) WHERE n >= 2 OR word[1:1] IN ('v', 'w') OR word[1:2] = 'an' OR word[-3:] = 'ing' OR word[-2:] = 'ly'""")
def external_list(spark, sf_dir):
    """A list of words from elsewhere after the checks of each conversation turn, the most listed first."""
    make = lambda entries: _pairs(spark, entries).select("key", "value")
    tables = {"names": make(dict.fromkeys(("the", "and", "that"), "x")), "surnames": make(dict.fromkeys(("v", "w", "an"), "x")), "nouns": make(dict.fromkeys(("ing", "ly"), "x")), "readings": make({c: f"{c}i" for c in "abcdefghijklmnopqrstuvwxyz"})}
    turns = _t(spark, sf_dir, "conversations").groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")).agg(F.max(F.lower("text")).alias("text"))
    listed = turns.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return M.refiltered(listed, turns, tables)


_WORDS_OF, _FEW = SCRIPT[:12], LETTERS[:12]
_SQL_LISTED = " UNION ALL ".join(f"SELECT {i} AS nth, '{mark}' AS mark, key, value FROM {_sql_values(entries)}" for i, (mark, entries) in enumerate((W.MARKS[name].replace("\n", "' || chr(10) || '"), entries) for name, entries in (("names2", SUFFIXES), ("names", NAMES), ("phrases", PHRASES), ("lookup", READINGS))))


@_query(f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(lower(text), '{_FEW}', '{_WORDS_OF}'), '[{_WORDS_OF}]+')) AS word FROM documents) GROUP BY 1), l AS ({_SQL_LISTED}),
    b AS (SELECT word, k, substr(word, 1, k) AS key FROM w, (SELECT unnest(range(1, 21)) AS k) WHERE k <= length(word)),
    s AS (SELECT word, string_agg(key || mark || CASE WHEN nth < 3 THEN replace(value, '/', '; ') ELSE value END || chr(10) || '-----------------' || chr(10), '' ORDER BY nth = 3, k DESC, nth) AS said, max(k) FILTER (nth < 3) AS longest FROM b JOIN l USING (key) GROUP BY word)
    SELECT word, n, md5(coalesce(said, substr(word, 1, 1) || chr(10) || '-----------------' || chr(10) || 'Not Found')) AS digest, CAST(coalesce(longest, 1) AS INTEGER) AS phrase_length FROM w LEFT JOIN s USING (word)""")
def full_meanings(spark, sf_dir):
    """What all lists say about each word of the documents, and how often it occurs."""
    words = _t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.translate(F.lower("text"), _FEW, _WORDS_OF), F.lit(f"[{_WORDS_OF}]+"), F.lit(0))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    lists = {name: _pairs(spark, entries) for name, entries in (("names2", SUFFIXES), ("names", NAMES), ("phrases", PHRASES), ("lookup", READINGS))}
    return W.full_meanings(words, lists).select(F.col("text").alias("word"), "n", F.md5("meanings").alias("digest"), "phrase_length")


@_query("""SELECT book, key, x.action AS action, x.at AS at FROM (SELECT CAST(user_id AS VARCHAR) AS book, CAST(event_id % 10 AS VARCHAR) AS key, max({'at': ts, 'action': CASE WHEN event_id % 3 = 0 THEN 'accept' WHEN event_id % 3 = 1 THEN 'reject' ELSE 'undo' END}) AS x FROM events GROUP BY ALL) WHERE x.action <> 'undo'""")
def book_memory_stream(spark, sf_dir):
    """Accepted and rejected names after a stream of all decisions."""
    given = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id").schema
    action = F.when(F.col("event_id") % 3 == 0, "accept").when(F.col("event_id") % 3 == 1, "reject").otherwise("undo")
    events = spark.readStream.schema(given).parquet(f"{sf_dir}/event[s].parquet").select(F.col("user_id").alias("book"), (F.col("event_id") % 10).alias("key"), F.lit("v").alias("value"), action.alias("action"), F.col("ts").alias("at"))
    place, changes = f"{folder(spark)}/books-{uuid.uuid4().hex}", books.remembered(events)
    books.kept(changes, f"{place}/changes", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return books.current(spark.read.schema(changes.schema).parquet(f"{place}/changes")).select("book", "key", "action", F.col("at").cast("timestamp_ntz").alias("at"))


@_query("""WITH f AS (SELECT p_brand AS dict, 'k' || p_partkey AS key, p_type AS value, p_size, p_name FROM part), d AS (SELECT dict, key, p_name AS value FROM f WHERE p_size < 40),
    r AS (SELECT dict, key, value FROM f WHERE p_size % 5 <> 0 UNION ALL SELECT dict, key, p_name FROM f WHERE p_size % 5 = 0 AND p_size < 40)
    SELECT dict, key, value FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dict = r.dict AND f.key = r.key AND p_size % 7 = 0 AND (CASE WHEN p_size % 2 = 0 THEN f.value ELSE 'x' END) = r.value)""")
def restored_entries(spark, sf_dir):
    """Entries with the defaults of some keys again, and some exact records removed."""
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("dict"), F.concat(F.lit("k"), "p_partkey").alias("key"), F.col("p_type").alias("value"), "p_size", "p_name")
    defaults = p.where("p_size < 40").select("dict", "key", F.col("p_name").alias("value"))
    gone = p.where("p_size % 7 = 0").select("dict", "key", F.when(F.col("p_size") % 2 == 0, F.col("value")).otherwise("x").alias("value"))
    return E.without_record(E.restored(p.select("dict", "key", "value"), defaults, p.where("p_size % 5 = 0")), gone).select("dict", "key", "value")


@_query("""WITH e AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'person' ELSE 'place' END AS kind, trim(' ' || o_clerk || ' ') AS key, trim(CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus || o_orderkey END) AS value, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS late FROM (SELECT *, o_orderpriority || ' ' || (o_custkey % 50) AS o_clerk FROM orders))
    SELECT kind, key, arg_max(value, late * 1000000000000 + line_no) AS value FROM e WHERE key <> '' AND value <> '' GROUP BY kind, key""")
def glossary_merge(spark, sf_dir):
    """Glossary entries of a workspace under those of a story."""
    o = _t(spark, sf_dir, "orders")
    entries = o.select(F.when(F.col("o_orderkey") % 2 == 0, "person").otherwise("place").alias("kind"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" "), F.col("o_custkey") % 50, F.lit(" ")).alias("key"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.concat("o_orderstatus", "o_orderkey")).alias("value"), F.col("o_orderkey").alias("line_no"))
    return E.glossary(entries.where("line_no % 3 <> 0"), entries.where("line_no % 3 = 0"))


_SQL_LABELLED = "(SELECT doc_id, replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10) || chr(10) || '[[ 7 ]] '), ', ', ',  ' || chr(13) || chr(10) || ' ') AS t FROM documents)"


@_query(f"""SELECT doc_id, md5(regexp_replace(t, '\\[\\[\\s*[0-9]+\\s*\\]\\]\\s?', '', 'g')) AS stripped,
    md5(array_to_string(list_transform(list_filter(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: chr(9) || x), chr(10))) AS indented FROM {_SQL_LABELLED}""")
def labels_and_indents(spark, sf_dir):
    """Whole documents with labels stripped, and with their lines set in."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n\n[[ 7 ]] ")), F.lit(", "), F.lit(",  \r\n "))
    labelled = _t(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return labelled.select("doc_id", F.md5(E.stripped_labels(F.col("t"))).alias("stripped"), F.md5(E.indented(F.col("t"))).alias("indented"))


_NUMERALS = "零一二三四五六七八九"


@_query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'positional' WHEN o_custkey % 4 = 1 THEN 'units' WHEN o_custkey % 4 = 2 THEN 'decimal' ELSE 'digits' END AS kind,
    CASE WHEN o_custkey % 4 = 0 AND length(CAST(o_orderkey AS VARCHAR)) >= 3 THEN CAST(o_orderkey AS VARCHAR) END AS run, CAST(nullif(o_orderkey % 10, 0) AS VARCHAR) AS last_digit, n || '百多' AS swapped
    FROM (SELECT o_orderkey, o_custkey, translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{_NUMERALS}') AS n FROM orders)""")
def numeral_classes(spark, sf_dir):
    """Classes of numbers, runs of numeral digits, positive digits, and modifiers behind their units."""
    digits = F.col("o_orderkey").cast("string")
    o = _t(spark, sf_dir, "orders").withColumn("n", F.translate(digits, "0123456789", _NUMERALS))
    text = F.when(F.col("o_custkey") % 4 == 0, F.col("n")).when(F.col("o_custkey") % 4 == 1, F.concat("n", F.lit("百"))).when(F.col("o_custkey") % 4 == 2, F.concat(digits, F.lit(".5"))).otherwise(digits)
    return o.select("o_orderkey", numbers.number_class(text).alias("kind"), numbers.consecutive_digits(text).alias("run"), numbers.positive_digit(F.substring("n", -1, 1)).cast("string").alias("last_digit"), X.modifiers_last(F.concat("n", F.lit("多百"))).alias("swapped"))


@_query("""WITH p AS (SELECT l_orderkey AS doc_id, count(*) AS source, count(*) FILTER (l_linenumber % 3 = 1) AS translated FROM lineitem GROUP BY 1) SELECT doc_id, source, translated FROM p WHERE translated + 2 <= source""")
def missing_paragraphs(spark, sf_dir):
    """Orders that lack two lines or more of their translation."""
    parts = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return E.missing_paragraphs(parts, parts.where("l_linenumber % 3 = 1"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
