"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a 5-gram model over the characters of any script, by code point, so its tables
grow with the corpus. A word equal to the one before it is the one symbol REPEAT: it is rare
in trusted text, so what repeats itself is improbable, and perplexity is by symbol of the others. The shortest level leaves its mass to
the uniform distribution over the symbols seen and one more.

Counts of all orders are tables keyed by n-gram, and so are discounts, shares and back-off
masses. An n-gram is two numbers, 21 bits a symbol, from which the shorter ones are cut. The
logarithm of a probability is a sum over the n-grams of a text: each n-gram that the model
has adds its gain, each context that it has adds its mass. The HOT most frequent n-grams are
sent to the tasks. Of the others a filter tells which a text may hold; these
are joined to the table of gains, pre-aggregated by text, and the products summed by text.

A text is rejected when its perplexity exceeds a quantile of held-out trusted documents of
its language.
"""

from __future__ import annotations

import unicodedata
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, code_points, mix64, released, settle, sized_broadcast, text_key, text_slices

ORDER, BITS = 5, 21
#: Trusted rows with crc32(doc_id as text) mod 5 = 0 set the thresholds; the others train the model.
FOLDS = 5
#: A document is rejected above this quantile of its language's held-out trusted perplexities.
QUANTILE = 0.99
#: Languages with fewer held-out trusted rows use the threshold of all languages together.
LEAST = 50
_BATCH = 500_000
#: N-grams that are sent to the tasks: 6 MB at 24 bytes each.
HOT = (6 << 20) // 24
#: Bits of the filter of the others: SPARSE for each of them, a power of two from the first bound to the second (64 MB).
SPARSE, FILTER = 16, (1 << 16, 1 << 29)
#: No symbol, what stands before a text, a word equal to the one before it; characters follow.
NONE, BEFORE, REPEAT, FIRST = range(4)
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8862D), np.uint64(0xC2B2AE3D27D4EB4F)
_KINDS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: whether it is part of a word."""
    if not _KINDS:
        out = np.zeros(0x110000, dtype=bool)
        for c in range(0x20000):
            ch = chr(c)
            out[c] = ch.isalnum() or ch == "_" or unicodedata.category(ch)[0] == "M"
        # Scripts written without spaces have no words to tell: Thai to Myanmar, Khmer, Han and kana.
        for a, b in ((0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA4D0), (0xF900, 0xFB00)):
            out[a:b] = False
        _KINDS.append(out)
    return _KINDS[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts in order, and the text of each. White space before REPEAT goes with it."""
    points, starts = code_points(texts)
    symbol, of = points.astype(np.int64) + FIRST, np.repeat(np.arange(len(texts)), np.diff(starts))
    letter = _letters()[points]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1] | (of[1:] != of[:-1])
    held, at = np.flatnonzero(letter), np.flatnonzero(opens[letter])
    if not len(at):
        return symbol, of
    size = np.diff(np.append(at, len(held)))
    nth = np.arange(len(held)) - np.repeat(at, size)
    word = np.add.reduceat(mix64(points[held].astype(np.uint64) + nth.astype(np.uint64) * _A), at)
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (of[held[at[1:]]] == of[held[at[:-1]]]) & (size[1:] == size[:-1])
    again = np.repeat(same, size)
    symbol[held[again & (nth == 0)]] = REPEAT
    keep = np.ones(len(points), dtype=bool)
    keep[held[again & (nth > 0)]] = False
    begin, end = held[at[1:]][same[1:]], held[at[1:] - 1][same[1:]]
    inked = np.cumsum(~_blank(points))
    begin, end = (x[inked[begin] - inked[end] == 1] for x in (begin, end))
    inside = np.zeros(len(points) + 1, dtype=np.int64)
    np.add.at(inside, end + 1, 1)
    np.add.at(inside, begin, -1)
    keep &= np.cumsum(inside)[:-1] == 0
    return symbol[keep], of[keep]


def _blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x200A))


def windows(symbol: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of the 5-gram that ends at each symbol: three symbols low, the two before them high."""
    back = [symbol]
    for k in range(1, ORDER):
        out = np.full_like(symbol, BEFORE)
        out[k:] = np.where(of[k:] == of[:-k], symbol[:-k], BEFORE) if len(symbol) > k else out[k:]
        back.append(out)
    return (back[4] << BITS) | back[3], (back[2] << 2 * BITS) | (back[1] << BITS) | back[0]


def keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for an n-gram."""
    return mix64(mix64(high.astype(np.uint64) + _B) * _A + low.astype(np.uint64)).view(np.int64)


_M1, _M2 = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: What keeps of (high, low) the last n symbols.
_LAST = {5: (_M2, -1), 4: (_M1, -1), 3: (0, -1), 2: (0, _M2), 1: (0, _M1)}


def _pairs(high: np.ndarray, low: np.ndarray):
    """Keys of the n-grams that end a window, longest first, and of the contexts of all but the shortest."""
    own = [keys(high & h, low & x) for _, (h, x) in sorted(_LAST.items(), reverse=True)]
    before, high = (low >> BITS) | ((high & _M1) << 2 * BITS), high >> BITS
    return own, [keys(high & _LAST[n][0], before & _LAST[n][1]) for n in range(ORDER - 1, 0, -1)]


def count_grams(texts: DataFrame) -> DataFrame:
    """(high, low, n) of each 5-gram of texts (text)."""

    def counted(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column("text"), _BATCH):
                high, low = windows(*symbols(texts))
                _, first, n = np.unique(keys(high, low), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(high[first]), pa.array(low[first]), pa.array(n, pa.int64())], names=["high", "low", "n"])

    return texts.select("text").mapInArrow(released(counted), "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame):
    """One row (d1, d2, d3) from counts of counts; 0.5, 1 and 1.5 where these are too few."""
    at = {k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double") for k in (1, 2, 3, 4)}
    rows = counts.agg(*(v.alias(f"n{k}") for k, v in at.items()))
    y = "n1 / (n1 + 2 * n2)"
    ok = "n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0"
    raw = rows.selectExpr(f"if({ok}, 1 - 2 * {y} * n2 / n1, 0.5) d1", f"if({ok}, 2 - 3 * {y} * n3 / n2, 1D) d2", f"if({ok}, 3 - 4 * {y} * n4 / n3, 1.5) d3")
    return raw.selectExpr("greatest(0.01D, least(d1, 0.99D)) d1", "greatest(0.02D, least(d2, 1.98D)) d2", "greatest(0.03D, least(d3, 2.97D)) d3")


def _cut_to(order: int):
    """Columns high and low of an n-gram's last `order` symbols."""
    high, low = _LAST[order]
    return F.col("high").bitwiseAND(F.lit(high).cast("long")).alias("high"), F.col("low").bitwiseAND(F.lit(low).cast("long")).alias("low")


def _context():
    """Columns high and low of an n-gram without its last symbol."""
    kept = F.shiftleft(F.col("high").bitwiseAND(F.lit(_M1).cast("long")), 2 * BITS)
    return F.shiftright("high", BITS).alias("c_high"), F.shiftright("low", BITS).bitwiseOR(kept).alias("c_low")


def _shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counts with own, the discounted share of each n-gram, and back; and (high, low, back): the mass that each context leaves."""
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    each = counts.crossJoin(F.broadcast(discounts(counts))).withColumn("cut", F.least(cut, F.col("n"))).select("*", *_context())
    totals = each.groupBy("c_high", "c_low").agg(F.sum("n").alias("all"), (F.sum("cut") / F.sum("n")).alias("back"))
    joined = each.join(totals, ["c_high", "c_low"]).withColumn("own", (F.col("n") - F.col("cut")) / F.col("all"))
    return joined.select("high", "low", "n", "heat", "own", "back"), totals.select(F.col("c_high").alias("high"), F.col("c_low").alias("low"), "back")


def _with_keys(batches):
    for batch in batches:
        own = keys(np.asarray(batch.column("high")), np.asarray(batch.column("low")))
        yield pa.RecordBatch.from_arrays([pa.array(own), *(batch.column(c) for c in ("gain", "carry", "heat"))], names=["key", "gain", "carry", "heat"])


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """(key, gain, carry, heat) of all n-grams and contexts, settled, and the log2 probability of a symbol never seen."""
    levels = {ORDER: settle(count_grams(texts).withColumn("heat", F.col("n")), "grams")}
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[order + 1].groupBy(*_cut_to(order)).agg(F.count("*").alias("n"), F.sum("heat").alias("heat"))
        levels[order] = settle(shorter, "grams")
    base = 1.0 / (levels[1].count() + 1)
    below, parts, floor = None, [], None
    for order in range(1, ORDER + 1):
        shares, left = _shares(levels[order])
        if order == 1:
            found = left.first()
            floor = float(np.log2(base * found.back)) if found else float(np.log2(base))
            shares = shares.withColumn("below", F.lit(base))
        else:
            shorter = below.select(F.col("high").alias("s_high"), F.col("low").alias("s_low"), F.col("p").alias("below"))
            high, low = _cut_to(order - 1)
            shares = shares.withColumns({"s_high": high, "s_low": low}).join(shorter, ["s_high", "s_low"]).drop("s_high", "s_low")
            parts.append(left.select("high", "low", F.lit(0.0).alias("gain"), F.log2("back").alias("carry"), F.lit(0).cast("long").alias("heat")))
        below = settle(shares.withColumn("p", F.col("own") + F.col("back") * F.col("below")), "shares")
        parts.append(below.select("high", "low", (F.log2(F.col("p") / F.col("below")) - F.log2("back")).alias("gain"), F.lit(0.0).alias("carry"), "heat"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy("high", "low").agg(*(F.sum(c).alias(c) for c in ("gain", "carry", "heat")))
    return settle(sums.mapInArrow(released(_with_keys), "key long, gain double, carry double, heat long"), "gains"), floor


def _bits(key: np.ndarray, size: int) -> np.ndarray:
    """Two places of each key in a filter of a size that is a power of two."""
    x = key.view(np.uint64)
    return np.stack([mix64(x ^ _C), mix64(x + _C)]) & np.uint64(size - 1)


def _filter(cold: DataFrame) -> np.ndarray:
    """A bit for each place of the keys of cold. With SPARSE bits a key it passes 1.4 % of what cold doesn't hold, more where the
    largest filter is too small for that, from 33 million keys on."""
    size = min(FILTER[1], max(FILTER[0], 1 << (SPARSE * cold.count()).bit_length()))

    def placed(batches):
        for batch in batches:
            at = np.unique(_bits(np.asarray(batch.column("key")), size).reshape(-1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(at & 31)], names=["word", "bit"])

    one = F.expr("shiftleft(1L, cast(bit as int))")
    got = cold.select("key").mapInArrow(released(placed), "word long, bit long").groupBy("word").agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(size >> 5, dtype=np.uint32)
    out[np.asarray(got["word"])] = np.asarray(got["bits"]).astype(np.uint32)
    return out


def sent_to_tasks(gains: DataFrame):
    """A broadcast of the most frequent n-grams (at most HOT, whole classes of frequency) and of the filter of the others; and
    these. Frequencies are counted by classes, so nothing is sorted on the driver."""
    rank = F.floor(F.log(F.col("heat") + 1.0) * 16)
    sizes = sorted(((r["rank"], r["n"]) for r in gains.groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, float("inf")
    for found, n in sizes:
        total += n
        if total > HOT:
            break
        least = found
    hot = gains.where(rank >= F.lit(least)).select("key", "gain", "carry").toArrow().sort_by("key")
    cold = gains.where(rank < F.lit(least))
    return gains.sparkSession.sparkContext.broadcast(([np.asarray(hot[c]) for c in ("key", "gain", "carry")], _filter(cold))), cold


def score(docs: DataFrame, model: tuple[DataFrame, float], ready=None) -> DataFrame:
    """docs with __perplexity double by symbol other than REPEAT (null for null and empty texts). ready: what sent_to_tasks()
    gave for the model, to be shared."""
    gains, floor = model
    docs = docs.drop("__perplexity")
    sent, cold = ready or sent_to_tasks(gains)

    def sought(batches):
        (known, gain, carry), held = sent.value

        some = bool(held.any())

        def found(every, value):
            """The value of each key sent, and which of the others the filter lets through (None if it is empty)."""
            # Each once and in order: shorter n-grams repeat, and a search goes through the table as they do.
            key, each = np.unique(every, return_inverse=True)
            hit, out = np.zeros(len(key), dtype=bool), np.zeros(len(key))
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                out = np.where(hit, value[at], 0.0)
            if not some:
                return out[each], None
            maybe = ~hit
            rest = np.flatnonzero(maybe)
            for place in _bits(key[rest], 32 * len(held)):
                maybe[rest] &= (held[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
            return out[each], maybe[each]

        for batch in batches:
            row = np.asarray(batch.column("row"))
            for a, texts in text_slices(batch.column("text"), _BATCH):
                b = a + len(texts)
                symbol, of = symbols(texts)
                high, low = windows(symbol, of)
                _, first, each = np.unique(keys(high, low), return_index=True, return_inverse=True)
                own, contexts = _pairs(high[first], low[first])
                value, asked = np.full(len(first), floor), []
                for role, grams in ((0, own), (1, contexts)):
                    for key in grams:
                        got, maybe = found(key, (gain, carry)[role])
                        value += got
                        if maybe is not None and maybe.any():
                            at = np.flatnonzero(maybe[each])
                            asked.append((of[at], key[each[at]], np.full(len(at), role)))
                bits, count = np.bincount(of, value[each], b - a), np.bincount(of[symbol != REPEAT], minlength=b - a)
                text, key, role = (np.concatenate(x) for x in zip(*asked, strict=True)) if asked else (np.zeros(0, np.int64),) * 3
                by = np.lexsort((key, text))
                text, key, role = text[by], key[by], role[by]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.zeros(0, np.int64)
                m = np.add.reduceat(role, new) if len(new) else new
                n = np.diff(np.append(new, len(key))) - m
                # A text's own row goes by a key of its own, so that copies are dealt out evenly.
                alone = mix64(row[a:b].view(np.uint64) ^ (np.arange(a, b).astype(np.uint64) * _C)).view(np.int64)
                none = np.zeros(len(new))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([row[a:b], row[a:b][text[new]]])), pa.array(np.concatenate([alone, key[new]])), *(pa.array(np.concatenate([np.zeros(b - a), x]).astype(np.int32)) for x in (n, m)), pa.array(np.concatenate([bits, none])), pa.array(np.concatenate([count, none]).astype(np.int64))],
                    names=["row", "key", "n", "m", "bits", "count"],
                )

    docs, back = aside(docs, "__row")
    looked = docs.select(text_key().alias("row"), "text").where("text is not null").mapInArrow(released(sought), "row long, key long, n int, m int, bits double, count long")
    joined = looked.join(cold.select("key", "gain", "carry"), "key", "left")
    # Rounded, as sums depend on their order in the last places: a text at the limit is judged alike each time.
    sums = joined.groupBy("row").agg(F.sum(F.col("bits") + F.coalesce(F.col("n") * F.col("gain") + F.col("m") * F.col("carry"), F.lit(0.0))).alias("bits"), F.sum("count").alias("count"))
    found = settle(sums.where("count > 0").select(F.col("row").alias("__row"), F.pow(F.lit(2.0), F.round(-F.col("bits") / F.col("count"), 10)).alias("__perplexity")), "perplexities")
    return docs.withColumn("__row", text_key()).join(sized_broadcast(found), "__row", "left").select(*back, "__perplexity")


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs labelled quality 1, with calibrates: whether they set thresholds."""
    good = sized_broadcast(settle(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted"))
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(good, "doc_id", "left_semi").withColumn("calibrates", fold)


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit) of each language with enough rows; lang null with every = true: of all of them.

    Rows that are too few to hold the quantile (98 for 0.99) have it below their largest, so there the limit is the
    upper 95 % bound of the quantile of a normal distribution of log perplexities (a tolerance limit).
    """
    z, sure = NormalDist().inv_cdf(quantile), NormalDist().inv_cdf(0.95)
    rows, logs = F.count("__perplexity"), F.ln("__perplexity")
    a, b = 1 - sure**2 / (2 * (rows - 1)), z**2 - sure**2 / rows
    bound = F.exp(F.avg(logs) + F.stddev_samp(logs) * (z + F.sqrt(z**2 - a * b)) / a)
    q = F.percentile_approx("__perplexity", quantile, 10_000)
    limit = F.when(((rows + 1) * (1 - quantile) < 1) & (rows > 10), F.greatest(q, bound)).otherwise(q)
    by = scored.groupBy("lang").agg(limit.alias("limit"), rows.alias("rows")).where(F.col("rows") >= LEAST)
    return by.select("lang", "limit", F.lit(False).alias("every")).unionByName(scored.agg(limit.alias("limit")).select(F.lit(None).cast("string").alias("lang"), "limit", F.lit(True).alias("every")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs with __perplexity, __limit (of the language) and __keep.

    Null texts and such of white space alone have no perplexity and aren't kept. Without trusted rows nothing is known, and
    all other texts are kept. Repeated rows are judged alike; null is a language like any other. Labels choose the trusted
    text only. Texts of any length are read whole, a slice of texts at a time. An empty table stays empty. Columns of docs
    with one of the three names are replaced; others are left alone, whatever their names.
    """
    docs = docs.drop("__perplexity", "__limit", "__keep")
    known = trusted(docs, labels)
    model = train(known.where("not calibrates"))
    ready = sent_to_tasks(model[0])
    limits = settle(thresholds(score(known.where("calibrates"), model, ready), quantile), "limits")
    moved, back = aside(docs, "__lang", "__own", "__all")
    own = limits.where("not every").select(F.col("lang").alias("__lang"), F.col("limit").alias("__own"))
    scored = score(moved, model, ready).join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    scored = scored.crossJoin(F.broadcast(limits.where("every").select(F.col("limit").alias("__all"))))
    limit, said = F.coalesce("__own", "__all"), F.col("text").rlike(r"\S")
    shown = F.when(said, F.col("__perplexity"))
    keep = shown.isNotNull() & F.coalesce(shown <= limit, F.lit(True))
    return scored.select(*back, shown.alias("__perplexity"), limit.alias("__limit"), F.coalesce(keep, F.lit(False)).alias("__keep"))
