"""Points taken from the given tables: ``id, label, features``, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscore.operators.encoding import Categories, fit_one_hot
from bucketscore.operators.scaling import Scaling, fit_scaling

ORDER_FEATURES = ("sum_qty", "sum_price", "avg_discount", "avg_tax", "o_totalprice")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str, cutoff: int = 10) -> DataFrame:
    """One point per order; an order with many lines is an anomaly."""
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_price"),
            F.avg("l_discount").alias("avg_discount"),
            F.avg("l_tax").alias("avg_tax"),
        )
    )
    prices = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    joined = lines.join(prices, F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("n_lines") >= cutoff, 1.0).otherwise(0.0)
    return joined.select(F.col("l_orderkey").alias("id"), label.alias("label"), F.array(*ORDER_FEATURES).alias("features"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """One point per embedding; class 7 is the anomaly."""
    label = F.when(F.col("label") == 7, 1.0).otherwise(0.0)
    features = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), features.alias("features"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return event_points(table(spark, folder, "events"))


def event_points(rows: DataFrame) -> DataFrame:
    """One point per event; a value of 200 or more is an anomaly."""
    label = F.when(F.col("value") >= 200, 1.0).otherwise(0.0)
    features = F.array("value", F.hour("ts").cast("double"), F.dayofweek("ts").cast("double"))
    return rows.select(F.col("event_id").alias("id"), label.alias("label"), features.alias("features"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One point per document, from counts over its whole text; toxic is the anomaly, null if not labelled."""
    texts = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    words = F.split("text", " ")
    size = F.length("text")
    digits = size - F.length(F.translate("text", "0123456789", ""))
    capitals = size - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    features = F.array(
        F.col("n_chars").cast("double"),
        F.size(words).cast("double"),
        F.size(F.array_distinct(words)) / F.size(words),
        F.coalesce(F.try_divide(digits, size), F.lit(0.0)),
        F.coalesce(F.try_divide(capitals, size), F.lit(0.0)),
    )
    return texts.select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label"), features.alias("features"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """One point per customer: market segment and nation as categories, then the balance.

    The segment's code is the rank of its name.
    """
    rows = table(spark, folder, "customer")
    names = rows.agg(F.array_sort(F.collect_set("c_mktsegment"))).scalar()
    code = (F.array_position(names, F.col("c_mktsegment")) - 1).cast("double")
    features = F.array(code, F.col("c_nationkey").cast("double"), F.col("c_acctbal"))
    return rows.select(F.col("c_custkey").alias("id"), F.lit(None).cast("double").alias("label"), features.alias("features"))


def customer_dictionary(spark: SparkSession, folder: str) -> Categories:
    return fit_one_hot(customers(spark, folder), 2)


def scaled(points: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    scaling: Scaling = fit_scaling(points if fit_on is None else fit_on)
    return scaling.apply(points)
