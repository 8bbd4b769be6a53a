"""A training corpus from raw documents, in five stages.

Every stage works on all that its predecessor kept and returns the columns of ``documents``, the
last one the pieces of packed sequences: toxic documents go, then those of low quality, then all but
one of each group of near duplicates, then those that leak a benchmark item; the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscore.llm import decontaminate, neardup, packing, ranking, toxicity
from bucketscore.staging import broadcast_limit, stage

TOXIC, GOOD = 0.7, 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(docs: DataFrame) -> DataFrame:
    """The whole row as one column, so that its names cannot clash; its text crosses to Python in it."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without those in ``rejected(doc_id)``. A row with a null id stays."""
    gone = stage(rejected.select("doc_id").distinct(), "rejected")
    # A row of ids takes some 60 bytes in a broadcast; beyond the session's limit, Spark shuffles.
    small = 60 * gone.rows <= max(broadcast_limit(docs.sparkSession), 8 << 20)
    return docs.join(F.broadcast(gone.df) if small else gone.df, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return model.score(_rows(docs), within="row").filter(F.col("score") < TOXIC).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ranking.fit(docs, _table(spark, sf_dir, "labels"), threshold=GOOD)
    return model.score(_rows(docs), within="row").filter(F.col("score") >= GOOD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, neardup.components(docs).filter(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fitted models and packing have no SQL; the operators behind the stages have tests in tests/llm, run() has none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, "stage").df
    return docs
