"""Reach of points, per-bucket estimators, scores and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.functions.exact import inverse_sums, inverse_total
from bucketscore.functions.running import kth_smallest
from bucketscore.operators.buckets import neighbor_counts, sum_over_buckets
from bucketscore.operators.lsh import HashFamily, hash_points
from bucketscore.staging import Staged

ESTIMATORS = ("e1", "e2", "e3", "e4")
SCORES = ("score1", "score2", "score3", "score4")


def estimator_columns(size: Column, reach_sum: Column, inverse_sum: Column) -> list[Column]:
    """The four bucket values: size, mean reach, size over mean reach, sum of inverse reach."""
    count = size.cast("double")
    return [
        count.alias("e1"),
        (reach_sum / count).alias("e2"),
        (count * count / reach_sum).alias("e3"),
        inverse_sum.alias("e4"),
    ]


def reach(
    points: DataFrame,
    family: HashFamily,
    counts: Staged,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> DataFrame:
    """``reach``: the summed size of a training point's buckets, itself included in each."""
    near = neighbor_counts(points, family, counts, n_points, id_col, (), features)
    return near.select(id_col, *family.scope, (F.col("neighbors") + family.num_tables).alias("reach"))


def reach_estimators(
    points: DataFrame,
    family: HashFamily,
    counts: Staged,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> DataFrame:
    """Bucket table ``keys, n, e1..e4``.

    The reach of a point goes back to its buckets by joining it to the point, one row each, and
    hashing once more; the many hashed rows are never joined on the id.
    """
    near = reach(points, family, counts, n_points, id_col, features)
    return estimators_from_reach(points, family, near, id_col, features)


def estimators_from_reach(
    points: DataFrame, family: HashFamily, near: DataFrame, id_col: str = "id", features: str = "features"
) -> DataFrame:
    """The bucket table for points whose ``reach`` is known."""
    rows = points.select(id_col, features).join(near, id_col)
    hashed = hash_points(rows, family, features, keep=["reach"])
    sums = hashed.groupBy(*family.keys).agg(
        F.count(F.lit(1)).alias("n"),
        # A decimal: the sum over a crowded bucket of a large table passes 2^63.
        F.sum(F.col("reach").cast("decimal(20,0)")).cast("double").alias("_reach"),
        *inverse_sums(F.col("reach"), "_inverse"),
    )
    values = estimator_columns(F.col("n"), F.col("_reach"), inverse_total("_inverse"))
    return sums.select(*family.keys, "n", *values)


def count_scores(
    points: DataFrame,
    family: HashFamily,
    counts: Staged,
    n_points: int,
    id_col: str = "id",
    carry: Sequence[str] = (),
    features: str = "features",
) -> DataFrame:
    """``score``: minus the summed size of the buckets a point falls in."""
    values = {"score": -F.col("n")}
    return sum_over_buckets(points, family, counts, values, n_points, id_col, carry, features)


def reach_scores(
    points: DataFrame,
    family: HashFamily,
    estimators: Staged,
    n_points: int,
    id_col: str = "id",
    carry: Sequence[str] = (),
    features: str = "features",
) -> DataFrame:
    """``score1..score4``: minus the summed estimators of the buckets a point falls in."""
    values = {score: -F.col(e) for score, e in zip(SCORES, ESTIMATORS)}
    # The sums of the first score are whole numbers.
    return sum_over_buckets(points, family, estimators, values, n_points, id_col, carry, features, exact=SCORES[1:])


def left_out_scores(
    points: DataFrame,
    family: HashFamily,
    estimators: Staged,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> DataFrame:
    """``score1..score4`` of training rows as if each were a fresh row: it is taken out of its buckets.

    A bucket of C rows with summed reach R and summed inverse reach I amounts to (C - 1, R - r, I - 1/r)
    without a row of reach r. That reach is the summed size of the row's buckets. What the row adds to the
    reach of the others stays in.
    """
    own = sum_over_buckets(points, family, estimators, {"reach": F.col("n")}, n_points, id_col, (), features)
    rows = points.select(id_col, features).join(own, id_col)
    others, total = F.col("n") - 1, F.col("e2") * F.col("n") - F.col("reach")
    values = {
        SCORES[0]: -others,
        SCORES[1]: -F.when(others > 0, total / others).otherwise(0.0),
        SCORES[2]: -F.when(others > 0, others.cast("double") * others / total).otherwise(0.0),
        SCORES[3]: -F.when(others > 0, F.greatest(F.col("e4") - 1.0 / F.col("reach"), F.lit(0.0))).otherwise(0.0),
    }
    sums = sum_over_buckets(rows, family, estimators, values, n_points, id_col, ["reach"], features, exact=SCORES[1:], per_point=True)
    return sums.select(id_col, F.col(SCORES[0]).cast("double").alias(SCORES[0]), *SCORES[1:])


def neighbor_threshold(neighbors: DataFrame, k: int) -> DataFrame:
    """One row: the k-th smallest neighbour count. Points at or below it are called anomalies."""
    return kth_smallest(neighbors, "neighbors", max(1, k)).select(F.col("kth").alias("threshold"))
