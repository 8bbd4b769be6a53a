"""Standardisation and checks of feature arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscore.functions.scalar import UNROLL_LIMIT, doubles
from bucketscore.staging import Staged


def as_array(df: DataFrame, features: str = "features") -> DataFrame:
    """The features as ``array<double>``, from an array or a dense or sparse vector column."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(features, vector_to_array(features))
    return df.withColumn(features, F.col(features).cast("array<double>"))


def as_vector(df: DataFrame, features: str = "features") -> DataFrame:
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df
    return df.withColumn(features, array_to_vector(features))


def point_facts(features: str = "features") -> dict[str, Column]:
    """Aggregates that ``dimension`` checks, to be measured while points are written."""
    missing = F.col(features).isNull() | F.exists(features, lambda x: x.isNull() | F.isnan(x))
    size = F.size(features)
    return {"shortest": F.min(size), "longest": F.max(size), "missing": F.count_if(missing)}


def dimension(points: Staged) -> int:
    """The one length of all feature arrays; raises on an empty table, nulls or uneven lengths."""
    facts = points.facts
    if points.rows == 0:
        raise ValueError("no rows to fit on")
    if facts["missing"]:
        raise ValueError(f"{facts['missing']} rows have null or NaN features")
    if facts["shortest"] != facts["longest"] or facts["longest"] == 0:
        raise ValueError(f"feature arrays must share one positive length, found {facts['shortest']} to {facts['longest']}")
    return int(facts["longest"])


@dataclass(frozen=True)
class Scaling:
    """Mean and sample standard deviation per feature; as long as one feature array."""

    mean: list[float]
    std: list[float]

    def apply(self, df: DataFrame, features: str = "features") -> DataFrame:
        return df.withColumn(features, standardized(F.col(features), self))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m, s) for i, (m, s) in enumerate(zip(self.mean, self.std))]
        return spark.createDataFrame(rows, "pos int, mean double, std double")


def standardized(features: Column, scaling: Scaling) -> Column:
    """``(x - mean) / std``; a constant feature becomes 0."""
    if len(scaling.mean) <= UNROLL_LIMIT:
        cells = [
            (F.get(features, F.lit(i)) - F.lit(m)) / F.lit(s) if s else F.get(features, F.lit(i)) * 0.0
            for i, (m, s) in enumerate(zip(scaling.mean, scaling.std))
        ]
        return F.array(*cells)
    mean, std = doubles(scaling.mean), doubles(scaling.std)
    centred = F.zip_with(features, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: F.when(s == 0.0, x * 0.0).otherwise(x / s))


def feature_stats(df: DataFrame, features: str = "features") -> DataFrame:
    """``(pos, mean, std)`` of every feature in one pass, with one row of sums per task."""
    summary = Summarizer.metrics("mean", "std").summary(array_to_vector(F.col(features)))
    row = df.agg(summary.alias("s"))
    cells = F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"))
    return row.select(F.posexplode(cells).alias("pos", "cell")).select("pos", "cell.mean", "cell.std")


def fit_scaling(df: DataFrame, features: str = "features") -> Scaling:
    rows = sorted(feature_stats(df, features).collect(), key=lambda r: r.pos)
    return Scaling([r.mean for r in rows], [r.std for r in rows])
