"""Exact running totals over a whole table without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bucketscore.staging import stage

ROWS_PER_RANGE = 1_000_000


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    value: Column | None = None,
) -> DataFrame:
    """Add ``upto_<c>`` for each of ``sums``: the total of ``c`` over rows up to this one.

    ``df`` has one row per ``(by, order)``; callers group before they call. The value axis is cut
    into ranges of similar row counts. Each range is summed, the few range totals are accumulated,
    and the running sum inside a range is a window over that range alone. ``value`` is a double that
    grows with ``order``, if that is no number itself.
    """
    by = list(by)
    staged = stage(df, "ordered")
    table = staged.df
    ranges = math.ceil(staged.rows / rows_per_range)
    if ranges <= 1:
        window = Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)
        window = window.rowsBetween(Window.unboundedPreceding, 0)
        return table.select("*", *[F.sum(c).over(window).alias(f"upto_{c}") for c in sums])

    points = [i / ranges for i in range(1, ranges)]
    value = F.col(order).cast("double") if value is None else value
    cuts = table.agg(F.percentile_approx(value, points, 10 * ranges)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="error").transform(
        table.withColumn("_value", value)
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    across = across.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    starts = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_all_{c}").over(across), F.lit(0)).alias(f"_start_{c}") for c in sums]
    )
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums])
    joined = local.join(starts, [*by, "_range"])
    return joined.select(*table.columns, *[(F.col(f"_in_{c}") + F.col(f"_start_{c}")).alias(f"upto_{c}") for c in sums])


def kth_smallest(df: DataFrame, value: str, k: int) -> DataFrame:
    """One row ``kth``: the k-th smallest ``value``, duplicates counted."""
    tally = df.groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    ranked = running_totals(tally, value, ["rows"])
    return ranked.filter(F.col("upto_rows") >= k).agg(F.min(value).alias("kth"))
