"""The pipeline on the smallest tables: each stage's decisions hold in its result."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as C
    from phrasewright.llm.common import settle, table

    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs
    for name, stage in C.STAGES:
        after = settle(stage(spark, before, FOLDER), "test")
        if name != "pieces":
            assert after.columns == columns
        if name in ("toxicity", "quality", "near duplicates"):
            assert after.exceptAll(before.select(after.columns)).count() == 0 and after.count() <= before.count()
        if name == "near duplicates":
            assert after.count() == after.select("text").distinct().count()
        if name == "mixing":
            assert after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
        before = after
    assert before.where("not round_trip").count() == 0 and before.count()
