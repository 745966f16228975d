"""interval_coalesce against its SQL on one thread. On more, DuckDB sorts rows with equal ranges anew for each of the SQL's two windows,
so that what it gives changes from run to run where a user has a range twice."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from phrasewright.plans import catalogue as C


@pytest.mark.parametrize("ids", [range(0, 4000), range(-2000, 2000), range(2**60, 2**60 + 4000)])
def test_ranges_are_those_of_the_sql(spark, tmp_path, ids):
    rnd = random.Random(4)
    pq.write_table(pa.table({"event_id": [*ids, *rnd.choices(ids, k=1000)], "user_id": pa.array([rnd.choice((1, 2, 3, 50, 51, None)) if rnd.random() < 0.2 else rnd.randint(100, 300) for _ in range(5000)], pa.int64())}), tmp_path / "events.parquet")
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(db.execute(C.SQL["interval_coalesce"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in C.interval_coalesce(spark, str(tmp_path)).collect()), key=str) == want
