"""Reading and writing labelled points."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscore.operators.scaling import as_array, as_vector
from bucketscore.staging import stage


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``label, features array<double>``. Naming the width saves the pass that looks for it."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path).select("label", vector_to_array("features").alias("features"))


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features", mode: str = "error") -> None:
    """One file per partition; zeros of sparse vectors are left out."""
    points = as_vector(df, features).select(F.col(label).alias("label"), F.col(features).alias("features"))
    points.write.mode(mode).format("libsvm").save(path)


def write_folds(df: DataFrame, path: str, label: str = "label", features: str = "features", mode: str = "error") -> None:
    """Folds as LIBSVM, one folder per value of ``fold``."""
    points = as_vector(df, features).select(
        F.col(label).alias("label"), F.col(features).alias("features"), F.col("fold")
    )
    points.write.mode(mode).partitionBy("fold").format("libsvm").save(path)


def write_scored(scored: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Scored rows as parquet, or as text where arrays and vectors become ``;`` lists."""
    if fmt == "csv":
        scored = _flat_text(scored)
    scored.write.mode(mode).format(fmt).save(path)


def _flat_text(df: DataFrame) -> DataFrame:
    for field in df.schema.fields:
        if field.dataType.typeName() in ("vectorudt", "array"):
            df = as_array(df, field.name).withColumn(
                field.name, F.concat_ws(";", F.transform(field.name, lambda x: x.cast("string")))
            )
    return df


def with_content_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Id from the content of a row: the same for equal rows, whatever the partitioning.

    A value has a mark in front, so that null differs from any text.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in df.columns]
    return df.withColumn(name, F.md5(F.concat_ws("\u0001", *cells)))


def with_row_number(df: DataFrame, name: str = "id") -> DataFrame:
    """Consecutive ids from 0 without a sort: row position plus the rows of earlier partitions."""
    rows = stage(df.withColumn("_spot", F.monotonically_increasing_id()), "numbered").df
    part = F.shiftright("_spot", 33)
    rows = rows.withColumn("_part", part)
    # One row per partition of the input.
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    position = F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + position).alias(name))
