"""Seeded row selection. Every draw depends on the row id, so reruns and retries agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.functions.scalar import hash01

# Above this share of anomalies, training keeps about this target share.
REBALANCE_ABOVE = 0.02
REBALANCE_TARGET = 0.01


@dataclass(frozen=True)
class ClassCounts:
    rows: int
    anomalies: int

    @property
    def keep_probability(self) -> float:
        """Chance for an anomaly to stay in the training rows."""
        if self.rows == 0 or self.anomalies / self.rows <= REBALANCE_ABOVE:
            return 1.0
        return REBALANCE_TARGET * self.rows / self.anomalies


def is_anomaly(label: str, anomaly_value: float = 1.0) -> Column:
    """False for unlabelled rows."""
    return F.coalesce(F.col(label) == F.lit(anomaly_value), F.lit(False))


def class_counts(df: DataFrame, label: str = "label", anomaly_value: float = 1.0) -> ClassCounts:
    row = df.agg(F.count(F.lit(1)), F.count_if(is_anomaly(label, anomaly_value))).first()
    return ClassCounts(int(row[0]), int(row[1]))


def kept_in_training(
    counts: ClassCounts, id_col: str = "id", label: str = "label", seed: int = 7, anomaly_value: float = 1.0
) -> Column:
    """Predicate of the rebalanced training set: all normal rows, and a share of the anomalies."""
    if counts.keep_probability >= 1.0:
        return F.lit(True)
    return ~is_anomaly(label, anomaly_value) | (hash01(id_col, seed, "rebalance") < counts.keep_probability)


def rebalance(
    df: DataFrame, id_col: str = "id", label: str = "label", seed: int = 7, anomaly_value: float = 1.0
) -> DataFrame:
    counts = class_counts(df, label, anomaly_value)
    return df.filter(kept_in_training(counts, id_col, label, seed, anomaly_value))


def sample(df: DataFrame, fraction: float, id_col: str = "id", seed: int = 7) -> DataFrame:
    return df.filter(hash01(id_col, seed, "sample") < fraction)


def split(df: DataFrame, train: float = 0.8, id_col: str = "id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; every row is in exactly one of them."""
    draw = hash01(id_col, seed, "split")
    return df.filter(draw < train), df.filter(draw >= train)


def with_fold(df: DataFrame, folds: int = 5, id_col: str = "id", seed: int = 7) -> DataFrame:
    """Add ``fold`` in 0..folds-1. Fold ``f`` trains on ``fold <> f`` and tests on ``fold = f``."""
    return df.withColumn("fold", F.floor(hash01(id_col, seed, "fold") * folds).cast("int"))
