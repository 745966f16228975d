"""Book memory as a stream: whatever the batches and restarts, the last decision on each name is what counts."""

import random
from datetime import datetime, timedelta

import pytest

from phrasewright.streaming import books

SCHEMA = "book string, key string, value string, action string, at timestamp"
START = datetime(2024, 1, 1)


def _run(spark, folder, late=None):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    books.kept(books.remembered(events, late), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{folder}/out")


def _add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _plain(rows):
    last = {}
    for book, key, value, action, at in rows:
        new = (at is not None, at or START, action or "", value is not None, value or "")
        if (book, key) not in last or new > last[book, key]:
            last[book, key] = new
    return {(b, k, v if has else None, a) for (b, k), (_, _, a, has, v) in last.items() if a != "undo"}


def _told(changes):
    return {(r.book, r.key, r.value, r.action) for r in books.current(changes).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_like_one_fold_after_restarts(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [
        (draw.choice(["a", "b", None]), draw.choice("xyz"), draw.choice(["1", "2", None]), draw.choice(["accept", "reject", "undo", None]), draw.choice([None, START + timedelta(minutes=draw.randrange(40))]))
        for _ in range(120)
    ] + [("hot", "x", str(i), "accept", START + timedelta(minutes=i % 30)) for i in range(200)]
    draw.shuffle(rows)
    for cut in range(0, len(rows), 160):
        _add(spark, tmp_path, rows[cut : cut + 160])
        changes = _run(spark, tmp_path)
        assert _told(changes) == _plain(rows[: cut + 160])
    before = changes.count()
    _add(spark, tmp_path, rows)
    assert _run(spark, tmp_path).count() == before, "repeated decisions tell nothing"


def test_late_decisions_and_forgotten_undos(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    _add(spark, tmp_path, [("a", "x", "1", "accept", at(0)), ("a", "y", "1", "accept", at(5))])
    _run(spark, tmp_path, "10 minutes")
    _add(spark, tmp_path, [("a", "x", None, "undo", at(8)), ("a", "z", "3", "accept", at(60))])
    assert _told(_run(spark, tmp_path, "10 minutes")) == {("a", "y", "1", "accept"), ("a", "z", "3", "accept")}
    _add(spark, tmp_path, [("a", "x", "late", "accept", at(7)), ("a", "w", "late", "accept", at(20)), ("a", "z", "4", "accept", at(55))])
    assert _told(_run(spark, tmp_path, "10 minutes")) == {("a", "y", "1", "accept"), ("a", "z", "3", "accept")}
    _add(spark, tmp_path, [("a", "x", "again", "accept", at(61))])
    assert ("a", "x", "again", "accept") in _told(_run(spark, tmp_path, "10 minutes"))


def test_no_decisions(spark, tmp_path):
    _add(spark, tmp_path, [])
    assert _told(_run(spark, tmp_path)) == set()
