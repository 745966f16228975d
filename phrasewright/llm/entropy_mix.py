"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source's word target is met by document rates r = min(2, exp(lambda_s * size / mean size
of the source)): the rates nearest to 1 in entropy, of at most two copies, whose expected
words reach the target. lambda_s solves the convex dual; Newton steps, kept in a bracket,
find it for all sources at once over the table (source, size, number of documents), which
aggregates the corpus exactly because a rate depends on source and size alone.

Rates are rounded to copies: floor(r), and one more for the documents whose hash, less the
fraction of r, is smallest, until the source's words come as near to the target as one
document allows. The cut is found on histograms of that number, coarse to fine, so no source
is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, observed, settle

#: The weights of the sources in order, repeating; the total as a share of all sizes; the most copies.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
NEWTON, CLOSE, BINS = 30, 1e-9, 1024


def word_count(text: str = "text"):
    """Number of runs other than space, tab, line feed, vertical tab, form feed and carriage return; 0 for null."""
    flat = F.trim(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.col(text).isNull() | (flat == ""), 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): weights 3, 1, 2 by order of source (null last) share the total;
    no target exceeds MOST times the source's size, and what exceeds it goes to the others by weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (nth % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rows = rows.withColumns(
        {"total": F.sum("source_size").over(every) * TOTAL, "capped": F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), "free": F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))}
    )
    level = (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("free")
    over = F.when(level * F.col("weight") <= F.col("cap"), level)
    rows = rows.withColumn("level", F.max(over).over(every))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(strength, unit):
    return F.least(F.lit(float(MOST)), F.exp(F.least(strength * unit, F.lit(50.0))))


def dual(sized: DataFrame, goals: DataFrame, steps: int = NEWTON) -> DataFrame:
    """(source, source_size, target, mean, strength): the strength at which a source's expected words meet its target.
    A source at its cap gets the strength that copies everything; one without words gets 0."""
    table = settle(sized.groupBy("source", "size").agg(F.count("*").cast("double").alias("n")).where("size > 0"), "sizes")
    means = table.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = goals.join(means.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full = F.col("target") >= F.col("source_size") * float(MOST) * (1 - 1e-12)
    top = F.lit(1.0 + 2 * MOST) * F.coalesce(F.col("mean") / F.col("least"), F.lit(1.0))
    open_ = F.col("mean").isNotNull() & ~full & (F.col("target") > 0)
    state = settle(
        state.select("source", "source_size", "target", "mean", F.when(F.col("mean").isNull(), 0.0).when(full, top).when(F.col("target") <= 0, -1e4).otherwise(0.0).alias("strength"), F.lit(-1e4).alias("low"), top.alias("high"), open_.alias("open")), "dual"
    )
    for _ in range(steps):
        now = state.where("open").select(F.col("source").alias("s"), "mean", "strength")
        unit = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * _rate(F.col("strength"), unit)
        bend = F.when(F.exp(F.least(F.col("strength") * unit, F.lit(50.0))) < MOST, words * unit).otherwise(0.0)
        sums = table.join(now, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(words).alias("words"), F.sum(bend).alias("bend"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        low, high = F.when(F.col("words") < F.col("target"), F.col("strength")).otherwise(F.col("low")), F.when(F.col("words") >= F.col("target"), F.col("strength")).otherwise(F.col("high"))
        newton = F.col("strength") - (F.col("words") - F.col("target")) / F.nullif("bend", F.lit(0.0))
        step = step.withColumns({"low": F.when(F.col("open"), low).otherwise(F.col("low")), "high": F.when(F.col("open"), high).otherwise(F.col("high"))})
        half = F.greatest((F.col("low") + F.col("high")) / 2, F.least(F.lit(-1.0), F.col("high") * 2 - 1, F.col("strength") * 2))
        moved = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(half)
        still = F.col("open") & (F.abs(F.col("words") - F.col("target")) > CLOSE * F.col("target"))
        step = step.select("source", "source_size", "target", "mean", F.when(still, moved).otherwise(F.col("strength")).alias("strength"), "low", "high", still.alias("open"))
        state, seen = observed(step, "dual", open=F.count_if("open"))
        if not seen["open"]:
            break
    return state.select("source", "source_size", "target", "mean", "strength")


def mix(docs: DataFrame) -> DataFrame:
    """docs with __size, __source_size, __target, __rate and __copies (0, 1 or 2), one row per row.

    Null sources are one source, the last. Documents without words (null, empty or white space) get 0 copies. Repeated rows
    are rows of their own; rows with equal doc_id, source and text share a hash and so are taken or left together where the
    cut falls, which the cut's last step settles by the nearer total. The hash depends on doc_id and size alone, so reruns agree.
    Texts of any length count whole; an empty table stays empty. Columns of docs with one of the five names are replaced;
    others are left alone, whatever their names.
    """
    docs, back = aside(docs.drop("__size", "__source_size", "__target", "__rate", "__copies"), "__s", "__mean", "__strength", "__cut")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    sized = settle(small, "sized")
    state = dual(sized, targets(sized))
    plan = _cut(sized, state)
    keyed = docs.withColumn("__size", word_count())
    joined = keyed.join(plan, F.col("source").cast("string").eqNullSafe(F.col("__s")), "left")
    rate, v = _rated(F.col("doc_id").cast("long"), F.col("__size"))
    copies = F.floor(rate) + F.when((rate < MOST) & (v <= F.col("__cut")), 1).otherwise(0)
    copies = F.when(F.col("__size") > 0, copies).otherwise(0).cast("int")
    return joined.select(*back, "__size", "__source_size", "__target", rate.alias("__rate"), copies.alias("__copies"))


def _rated(doc_id, size):
    """A document's rate (0 without words), and the number that orders a source's documents for one more copy."""
    rate = F.when(size > 0, _rate(F.col("__strength"), size / F.col("__mean"))).otherwise(0.0)
    u = F.shiftrightunsigned(F.xxhash64(doc_id, size), 11) * F.lit(2.0**-53)
    return rate, u - (rate - F.floor(rate))


def _cut(sized: DataFrame, state: DataFrame) -> DataFrame:
    """State with __cut: documents whose number is at most this get one copy more than floor(rate)."""
    names = {"source": "__s", "source_size": "__source_size", "target": "__target", "mean": "__mean", "strength": "__strength"}
    plan = state.select(*(F.col(a).alias(b) for a, b in names.items()))
    rate, v = _rated(F.col("doc_id"), F.col("size"))
    rated = sized.where("size > 0").join(plan.drop("__source_size"), F.col("source").eqNullSafe(F.col("__s"))).select("source", "size", "__target", rate.alias("rate"), v.alias("v"))
    rated = settle(rated, "rated")
    sure = rated.groupBy("source").agg(F.sum(F.col("size") * F.floor("rate")).alias("sure"), F.max("__target").alias("target"))
    need = settle(sure.select(F.col("source").alias("s"), (F.col("target") - F.col("sure")).alias("need"), F.lit(-1.0).alias("low"), F.lit(2.0).alias("span")), "need")
    rest = rated.where(F.col("rate") < MOST).select("source", "size", "v")
    for _ in range(2):
        spread = rest.join(need, F.col("source").eqNullSafe(F.col("s")))
        slot = F.floor((F.col("v") - F.col("low")) / F.col("span") * BINS)
        inside = spread.withColumn("slot", F.greatest(F.lit(-1), F.least(slot, F.lit(BINS))).cast("int")).where(f"slot >= 0 and slot < {BINS}")
        bins = inside.groupBy("s", "slot", "need", "low", "span").agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = bins.withColumn("before", before).where("before <= need")
        last = at.groupBy("s", "need", "low", "span").agg(F.max_by(F.struct("slot", "before"), "slot").alias("x"))
        width = F.col("span") / BINS
        need = settle(last.select("s", (F.col("need") - F.col("x.before")).alias("need"), (F.col("low") + F.col("x.slot") * width).alias("low"), width.alias("span")), "need")
    near = rest.join(need, F.col("source").eqNullSafe(F.col("s"))).where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("span")))
    upto = F.sum("size").over(Window.partitionBy("s").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    runs = near.withColumn("upto", upto).select("s", "v", F.abs(F.col("upto") - F.col("need")).alias("off"), F.col("need"), F.col("low"))
    best = runs.groupBy("s").agg(F.min_by(F.struct("v", "off"), F.struct("off", "v")).alias("x"), F.max("need").alias("need"), F.max("low").alias("low"))
    under = F.col("low") - F.greatest(F.abs("low"), F.lit(1.0)) * 2.0**-50
    cut = best.select(F.col("s").alias("c"), F.when(F.col("x.off") <= F.abs("need"), F.col("x.v")).otherwise(under).alias("__cut"))
    return settle(plan.join(cut, F.col("__s").eqNullSafe(F.col("c")), "left").select("__s", "__source_size", "__target", "__mean", "__strength", F.coalesce("__cut", F.lit(-2.0)).alias("__cut")), "plan")


def copied(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    moved, back = aside(docs, "__size", "__source_size", "__target", "__rate", "__copies", "__copy")
    taken = mix(moved).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*back)
