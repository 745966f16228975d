"""A training corpus from documents: toxic and poor ones go, near duplicates are thinned, sources are mixed, pieces coded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewright.llm import dart_minhash, entropy_mix, kneser_ney, nbest_pieces, toxicity
from phrasewright.llm.common import aside, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the labelled rows among docs don't teach us to call toxic; null and empty texts stay, repeated rows
    stay or go together, and columns keep their names and values."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    moved, back = aside(docs, "__toxicity", "__offending")
    return toxicity.score(moved, model).where(F.col("__toxicity") < toxicity.THRESHOLD).select(*back)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose perplexity is usual in trusted text of their language; null and blank texts go."""
    moved, back = aside(docs, "__perplexity", "__limit", "__keep")
    return kneser_ney.classify(moved, table(spark, sf_dir, "labels")).where("__keep").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class. Texts without words, null and empty ones too, are classes of their own and stay;
    of rows with the same doc_id and text one stays, and an empty table stays empty."""
    return dart_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows. Texts without words, null and empty ones too, are not taken;
    null is a source like any other, repeated rows are rows of their own, and an empty table stays empty."""
    return entropy_mix.copied(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces. Null texts are coded as empty ones, which have no pieces; repeated rows are coded alike, and an
    empty table stays empty."""
    return nbest_pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The stages train models and search candidates, which SQL can't express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
