"""Connected components of a graph that never leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.staging import drop, gathered, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest neighbour, then its smaller ones. Both replace a tree by a flatter one and never make
    more edges than there were, also around a hub with a third of all edges, and they end in one
    star per component after about the logarithm of the longest chain of rounds. Each round is
    written to the shared folder, so the lineage stays short and lost executors cost one round.
    The tasks of a round go with its edges: a graph that one task holds has rounds of one task and
    no shuffle, whatever the session's number of partitions.

    Edges with a null end and loops say nothing and are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    mark = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0).cast("bigint"))
    start = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = stage(start.distinct(), "edges", mark=mark)
    while True:
        near = gathered(now.df, now.rows)
        ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = near.select(F.explode(ends).alias("end")).select("end.a", "end.b")
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = near.join(smallest.withColumnRenamed("a", "b"), "b").select("a", F.col("low").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("low"))
        # A node's neighbours go to the smallest of them, and the node itself in that one's place.
        node = F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
        small = large.join(smallest, "a").select(node.alias("a"), F.col("low").alias("b"))
        after = stage(gathered(small.distinct(), now.rows), "edges", mark=mark)
        done = (after.rows, after.facts["mark"]) == (now.rows, now.facts["mark"])
        drop(spark, now)
        now = after
        if done:
            break
    stars = gathered(now.df, now.rows)
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
