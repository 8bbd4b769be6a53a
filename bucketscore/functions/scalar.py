"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_LIMIT = 64


def doubles(values: Sequence[float]) -> Column:
    """Constant ``array<double>``, handed to Spark in one piece."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def hash01(id_col: str | Column, seed: int, purpose: str) -> Column:
    """Uniform number in [0, 1) that depends only on the row id, the seed and the purpose.

    Draws for different purposes are independent, also with one seed.
    """
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(col.cast("string"), F.lit(f":{seed}:{purpose}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def distance(left: Column, right: Column, dim: int) -> Column:
    """Euclidean distance of two arrays of length ``dim``."""
    if dim <= UNROLL_LIMIT:
        gaps = [F.get(left, F.lit(i)) - F.get(right, F.lit(i)) for i in range(dim)]
        total = gaps[0] * gaps[0]
        for gap in gaps[1:]:
            total = total + gap * gap
        return F.sqrt(total)
    squares = F.zip_with(left, right, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def key_text(columns: Sequence[str]) -> Column:
    """Bucket key as text, for reports."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram ``(bin, bin_low, rows)``; the maximum belongs to the last bin.

    Equal values are merged first, so the two reads of the bounds and the binning see one row
    per distinct value.
    """
    merged = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    low = merged.agg(F.min("v")).scalar()
    high = merged.agg(F.max("v")).scalar()
    bounded = merged.select("v", "c", low.alias("low"), high.alias("high"))
    index = F.least(F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))
    placed = bounded.withColumn("bin", F.when(F.col("high") > F.col("low"), index).otherwise(F.lit(0)).cast("int"))
    return placed.groupBy("bin").agg(
        F.min(F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / bins).alias("bin_low"),
        F.sum("c").alias("rows"),
    )
