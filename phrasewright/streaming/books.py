"""Streams of documents and of name decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

#: The time of a decision without one: before all others.
_NEVER = -(1 << 63)
_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "book string, key string, value string, action string, us long"


def read_documents(spark, path: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents as they come."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", per_trigger).parquet(path)


def decisions_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accepts, rejects and undos of each book in windows of event time; what comes later than `late` is left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", size), "book", "action").agg(F.count("*").alias("n"))


class _Last(StatefulProcessor):
    """Keeps the last decision on a name of a book, and tells when it changes."""

    def __init__(self, expires: bool):
        self.expires = expires

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "value string, action string, us long")

    def handleInputRows(self, key, rows, timerValues):
        told = tuple(self.last.get()) if self.last.exists() else None
        best = max([*([told] if told else []), max(((r.value, r.action, r.us) for r in rows), key=_order)], key=_order)
        if best == told:
            return
        self.last.update(best)
        if self.expires and best[1] == "undo" and best[2] != _NEVER:
            self.handle.registerTimer(best[2] // 1000 + 1)
        yield Row(book=key[0], key=key[1], value=best[0], action=best[1], us=best[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """An undone decision is forgotten when all that could come before it comes too late."""
        if self.last.exists():
            _, action, us = self.last.get()
            if action == "undo" and us // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _order(decision: tuple) -> tuple:
    value, action, us = decision
    return us, action, value is not None, value or ""


def _folded(batches):
    """The last decision on each name within a batch of rows."""
    for rows in batches:
        yield rows.sort_values(["us", "action", "value"], na_position="first", kind="stable").drop_duplicates(["book", "key"], keep="last")


def remembered(events: DataFrame, late: str | None = None) -> DataFrame:
    """A stream of decisions (book, key, value, action, at) -> the stream of changes to the book memory, with the same columns, book
    and key as text.

    A change is told when a decision comes that is later than all before it on the same name: by at, then action, then value. So
    repeated decisions and older ones tell nothing, and the last change of each name doesn't depend on how the stream is cut into
    batches. A null at is before all times, one without a zone is in the session's; a null action is '', null books and keys are names of their own.

    With `late`, what comes later than that is left out, and undone names are forgotten once that holds for all before them;
    without it nothing is left out and the state keeps a row for each name. Each task first folds its own rows, so a name that most
    decisions are on reaches its state as a few rows a batch. The state lives in RocksDB with its changes in the checkpoint: a lost
    executor or a new start goes on from the last batch.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE)
    text = lambda c: F.col(c).cast("string").alias(c)
    plain = events.select(text("book"), text("key"), text("value"), F.coalesce("action", F.lit("")).alias("action"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(_NEVER)).alias("us"))
    few = plain.mapInPandas(_folded, _EVENT)
    if late:
        few = few.withColumn("at", _time()).withWatermark("at", late)
    changes = few.groupBy("book", "key").transformWithState(_Last(bool(late)), _EVENT, "Append", "EventTime" if late else "None")
    return changes.select("book", "key", "value", "action", _time().alias("at"))


def _time():
    return F.when(F.col("us") != _NEVER, F.timestamp_micros("us"))


def kept(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes the changes to a folder of Parquet, each exactly once."""
    return changes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def current(changes: DataFrame) -> DataFrame:
    """(book, key, value, action, at): the last change of each name that isn't undone, of a table of changes or of decisions."""
    last = changes.groupBy("book", "key").agg(F.max_by(F.struct("value", "action", "at"), F.struct("at", "action", "value")).alias("x"))
    return last.select("book", "key", "x.*").where("action <> 'undo'")
