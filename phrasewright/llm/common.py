"""Helpers the training-data operators share: shared storage, tables, code points."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster
    an error, since each machine would write to a disk of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="phrasewright-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, tag: str, **sums) -> tuple[DataFrame, dict]:
    """settle(), and aggregates of the rows by name, taken while they are written: asking for them costs no job of its own."""
    seen = Observation()
    out = settle(df.observe(seen, *(c.alias(name) for name, c in sums.items())), tag)
    return out, seen.get


#: Rows of one or two numbers that a broadcast may have, some 64 MB.
BROADCAST_ROWS = 2_000_000


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table, marked for broadcast if it has few enough rows; otherwise as it is, and joins shuffle. Give it a settled table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, list]:
    """docs with the columns that have one of the names taken under other names, and what selects all under their own again."""
    lower = {c.lower() for c in taken}
    moved = {c: f"{c} {uuid.uuid4().hex}" for c in docs.columns if c.lower() in lower}
    quoted = lambda c: F.col("`" + moved.get(c, c).replace("`", "``") + "`").alias(c)
    return docs.withColumnsRenamed(moved), [quoted(c) for c in docs.columns]


def widened(docs: DataFrame, function, added: list[T.StructField]) -> DataFrame:
    """docs with the columns that an Arrow function adds at the end. Spark can't pass names with dots to it, so these get others there."""
    plain = docs.toDF(*(f"dotted {i} {uuid.uuid4().hex}" if "." in c else c for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(released(function, keeps=True), T.StructType([*plain.schema.fields, *added])).toDF(*docs.columns, *(f.name for f in added))


def release() -> None:
    """What a task, or the driver, has freed goes back to the system; else an idle process keeps it while others need memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker keeps between tasks, by name: the last one alone, until it has been idle for so many seconds.
_KEPT: dict = {}
_IDLE, _TASKS = 5.0, itertools.count(1)
_LAST = [0]


def kept(name: str, make):
    """make(), once in a worker for tasks that follow each other under one name."""
    if name not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[name] = make()
    return _KEPT[name]


def _forget(task: int) -> None:
    """Lets go of what is kept if no task has begun since. A task holds what it uses itself, so one that begins now loses nothing."""
    if _LAST[0] == task:
        _KEPT.clear()
        release()


def released(function, keeps: bool = False):
    """An Arrow function that releases memory before its first batch and after its last, with what is kept for other work unless
    it keeps something itself; what it keeps goes when its worker has been idle for a while."""

    def run(batches):
        task = _LAST[0] = next(_TASKS)
        if not keeps:
            _KEPT.clear()
        release()
        try:
            yield from function(batches)
        finally:
            release()
            if keeps:
                timer = threading.Timer(_IDLE, _forget, (task,))
                timer.daemon = True
                timer.start()

    return run


def text_key(text: str = "text"):
    """Tells texts with the same doc_id apart."""
    return F.xxhash64(F.col(text), F.length(text))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text starts (one more entry than texts)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def text_slices(column, budget: int):
    """(from, texts) of an Arrow column of strings, null as empty: about so many code points at a time, so that no more of a
    batch than that lies in Python."""
    for a, b in slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), budget):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def slices(sizes, budget: int):
    """(from, to) index ranges whose sizes add up to about the budget; one large item gets its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


_GAMMA, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        z = x + _GAMMA
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))
