"""Bucket tables: populations, their statistics, and exact sums over the buckets of a point."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.functions.exact import FRACTIONS, exact_total, parts, parts_sums
from bucketscore.functions.scalar import distance, doubles, histogram
from bucketscore.operators.local import Lookup, local_counts, local_sums
from bucketscore.operators.lsh import HashFamily, cut_keys, hash_points
from bucketscore.staging import Staged, broadcast_limit, row_bytes, stage

# Bytes that the crowded buckets may take as a broadcast side where the session's limit is lower.
CROWDED_BYTES = 32 << 20
# Bytes of keys and values up to which tasks look buckets up in a copy of the table, if the session broadcasts at all.
LOCAL_BYTES = 32 << 20
# Hashed rows from which they do.
LOCAL_ROWS = 1_000_000
# Bytes of a partition up to which a shuffled join builds a hash table instead of sorting.
HASH_BUILD_BYTES = 64 << 20


def bucket_counts(points: DataFrame, family: HashFamily, features: str = "features") -> DataFrame:
    """Population ``n`` of every bucket. Crowded buckets merge per batch and per task."""
    whole = replace(family, prefixes=())
    counts = local_counts(points, whole, features).groupBy(*whole.keys).agg(F.sum("n").alias("n"))
    if not family.prefixes:
        return counts
    # Buckets of a prefix are sums of those of the whole key.
    return cut_keys(counts, family, "n").groupBy(*family.keys).agg(F.sum("n").alias("n"))


def bucket_stats(counts: DataFrame, n_points: int, by: Sequence[str] = ()) -> DataFrame:
    """Bucket numbers, and mean and spread of the size of buckets with more than one member."""
    crowded = F.when(F.col("n") > 1, F.col("n"))
    return (
        counts.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("buckets"),
            F.count(crowded).alias("multi_buckets"),
            F.avg(crowded).alias("mean_size"),
            F.stddev_pop(crowded).alias("std_size"),
        )
        .select(
            *by,
            "buckets",
            "multi_buckets",
            "mean_size",
            F.coalesce(F.col("mean_size") / n_points, F.lit(0.0)).alias("relative_size"),
            "std_size",
            (F.col("std_size") / n_points).alias("relative_std"),
        )
    )


def stage_counts(points: DataFrame, family: HashFamily, features: str = "features") -> Staged:
    """The bucket populations as a table, with the number of multi-member buckets."""
    return stage(bucket_counts(points, family, features), "counts", multi=F.count_if(F.col("n") > 1))


def _fits(table: Staged, array_length: int) -> bool:
    width = row_bytes(table.df.schema, array_length)
    return table.rows * width <= broadcast_limit(table.df.sparkSession)


def join_buckets(
    points: DataFrame,
    family: HashFamily,
    table: Staged,
    n_points: int,
    keep: Sequence[str] = ("id",),
    features: str = "features",
    array_length: int = 0,
) -> DataFrame:
    """Points joined to the rows of ``table`` (one per bucket, with its size ``n``) they fall in.

    A table within the broadcast limit is broadcast and nothing is shuffled. Beyond it, crowded
    buckets are split off: at most ``share`` buckets per hash table can hold more than
    ``n_points / share`` of the points each, so a broadcast of those is bounded whatever the data
    looks like, and their many points skip the shuffle. Only points of the remaining, small
    buckets are shuffled, so no join key is hot. Points to score may crowd where the training points
    did not; the adaptive skew join splits such a key, since the table is always the build side.
    """
    hashed = hash_points(points, family, features, keep)
    first, *more = join_hashed(hashed, family, table, n_points, array_length)
    for part in more:
        first = first.unionByName(part)
    return first


def join_hashed(hashed: DataFrame, family: HashFamily, table: Staged, n_points: int, array_length: int = 0) -> list[DataFrame]:
    """``join_buckets`` for hashed points, as one DataFrame or as two of which each has all rows of its buckets."""
    if _fits(table, array_length):
        return [hashed.join(F.broadcast(table.df), family.keys)]

    width = row_bytes(table.df.schema, array_length)
    share = _crowded_share(family, table, width)
    if share < 2:
        # Rows too wide to broadcast even the largest buckets: the adaptive skew join splits them.
        return [_shuffled_join(hashed, table.df, table.rows, width, family.keys)]
    is_crowded = F.col("n") > n_points // share
    crowded = table.df.filter(is_crowded)
    crowded_part = hashed.join(F.broadcast(crowded), family.keys)
    rest = hashed.join(F.broadcast(crowded.select(*family.keys)), family.keys, "left_anti")
    rest_part = _shuffled_join(rest, table.df.filter(~is_crowded), table.rows, width, family.keys)
    return [crowded_part, rest_part]


def _shuffled_join(hashed: DataFrame, table: DataFrame, rows: int, width: int, keys: Sequence[str]) -> DataFrame:
    """Equi-join with a table of distinct keys, which therefore spread evenly over partitions.

    The strategy is stated, because size estimates miss the fan-out of hashing and would take the
    hashed side for the small one.
    """
    partitions = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strategy = "shuffle_hash" if rows * width / partitions <= HASH_BUILD_BYTES else "merge"
    return hashed.join(table.hint(strategy), keys)


def _crowded_share(family: HashFamily, table: Staged, width: int) -> int:
    """The share for which all crowded buckets together stay within the broadcast bound."""
    bound = max(broadcast_limit(table.df.sparkSession), CROWDED_BYTES)
    return bound // (width * family.num_tables * family.scopes)


def sum_over_buckets(
    points: DataFrame,
    family: HashFamily,
    table: Staged,
    values: Mapping[str, Column],
    n_points: int,
    id_col: str = "id",
    carry: Sequence[str] = (),
    features: str = "features",
    merge_widths: bool = False,
    array_length: int = 0,
    exact: Sequence[str] = (),
    per_point: bool = False,
) -> DataFrame:
    """For each point, the sum of each value over the buckets it falls in; no bucket counts 0.

    ``carry`` lists columns that depend on the id alone; ``merge_widths`` gives one row per point
    where the family has several widths. The values in ``exact`` are doubles of one sign, whose sums do
    not depend on the order of the tables. The rows of one point leave the hashing step side by
    side, so partial aggregation brings them down to one before the shuffle. ``per_point`` says that the
    values name columns of ``carry`` too; without it, a table of bounded size is looked up batch by batch.
    """
    args = (points, family, table, values, n_points, id_col, carry, features, merge_widths, array_length, exact, per_point)
    return parts_total(bucket_parts(*args), values, exact)


def parts_total(added: DataFrame, values: Sequence[str], exact: Sequence[str] = ()) -> DataFrame:
    """The sums whose parts ``bucket_parts`` gave."""
    made = {f"{name}_{k}" for name in exact for k in range(FRACTIONS + 1)}
    totals = [exact_total(name).alias(name) if name in exact else F.col(name) for name in values]
    return added.select(*[c for c in added.columns if c not in made and c not in values], *totals)


def merged_parts(tables: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """``bucket_parts`` of families that share out the tables, added up."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union.groupBy(*group).agg(*[F.sum(c).alias(c) for c in union.columns if c not in group])


def bucket_parts(
    points: DataFrame,
    family: HashFamily,
    table: Staged,
    values: Mapping[str, Column],
    n_points: int,
    id_col: str = "id",
    carry: Sequence[str] = (),
    features: str = "features",
    merge_widths: bool = False,
    array_length: int = 0,
    exact: Sequence[str] = (),
    per_point: bool = False,
) -> DataFrame:
    """What ``sum_over_buckets`` returns, the values in ``exact`` as whole numbers that may be added further."""
    scope = [] if merge_widths else family.scope
    group = [id_col, *carry, *scope]
    if not per_point and n_points * family.num_tables * family.scopes > LOCAL_ROWS:
        found = _local_parts(points, family, table, values, id_col, carry, features, merge_widths, exact)
        if found is not None:
            return found
    if _fits(table, array_length):
        hashed = hash_points(points, family, features, [id_col, *carry])
        found = hashed.join(F.broadcast(table.df), family.keys, "left")
        found = found.select(*group, *[F.coalesce(v, F.lit(0)).alias(name) for name, v in values.items()])
    else:
        matched = join_buckets(points, family, table, n_points, [id_col, *carry], features, array_length)
        matched = matched.select(*group, *[v.alias(name) for name, v in values.items()])
        # A zero for every point, so that those in no bucket stay in without an outer join.
        every = points.select(id_col, *carry)
        if "w" in scope:
            every = every.select("*", F.explode(doubles(family.widths)).alias("w"))
        if "length" in scope:
            every = every.select("*", F.explode(F.array(*[F.lit(n) for n in family.prefixes])).alias("length"))
        types = {f.name: f.dataType for f in matched.schema.fields}
        every = every.select(*group, *[F.lit(0).cast(types[name]).alias(name) for name in values])
        found = matched.unionByName(every)
    sums = [s for name in values for s in (parts_sums(F.col(name), name) if name in exact else [F.sum(name).alias(name)])]
    return found.groupBy(*group).agg(*sums)


def _local_parts(points, family, table, values, id_col, carry, features, merge_widths, exact) -> DataFrame | None:
    """``bucket_parts`` by looking up a copy of the table; None if it is too large or holds other than numbers."""
    cut = {f"{name}_{k}" if name in exact else name: part for name, v in values.items() for k, part in enumerate(parts(v) if name in exact else [v])}
    if not 0 < table.rows * 8 * (1 + len(cut)) <= LOCAL_BYTES or not broadcast_limit(points.sparkSession):
        return None
    chosen = table.df.select(*family.keys, *[part.alias(name) for name, part in cut.items()])
    types = {name: chosen.schema[name].dataType.typeName() for name in cut}
    if not set(types.values()) <= {"integer", "long", "double"}:
        return None
    rows = chosen.toArrow()
    lookup = Lookup(family, rows)
    if not lookup.packs:
        return None
    kinds = {kind: [name for name in cut if (types[name] == "double") == (kind == "real")] for kind in ("whole", "real")}
    columns = [
        np.array([rows[name].to_numpy() for name in names], dtype=dtype).reshape(len(names), rows.num_rows).T
        for names, dtype in zip(kinds.values(), (np.int64, np.float64))
    ]
    sums = local_sums(family, lookup, *columns, merge_widths, F.col(features))
    scopes = [None] if merge_widths or not family.scope else lookup.scopes
    of = {
        (s, name): F.get(F.col(f"_sums.{kind}"), F.lit(s * len(names) + k))
        for s in range(len(scopes)) for kind, names in kinds.items() for k, name in enumerate(names)
    }
    grouped = points.select(id_col, *carry, sums.alias("_sums")).groupBy(id_col, *carry)
    added = grouped.agg(*[F.sum(c).alias(f"_{s}_{name}") for (s, name), c in of.items()])
    if scopes == [None]:
        return added.select(id_col, *carry, *[F.col(f"_0_{name}").alias(name) for name in cut])
    labels = [{"w": F.lit(float(w)), "length": F.lit(length)} for w, length in scopes]
    structs = [
        F.struct(*[labels[s][c].alias(c) for c in family.scope], *[F.col(f"_{s}_{name}").alias(name) for name in cut])
        for s in range(len(scopes))
    ]
    return added.select(id_col, *carry, F.inline(F.array(*structs)))


def crowded_only(counts: Staged) -> Staged:
    """The buckets with two or more members."""
    multi = counts.df.filter("n > 1")
    rows = counts.facts["multi"] if "multi" in counts.facts else multi.count()
    return Staged(multi, rows, counts.path)


def neighbor_counts(
    points: DataFrame,
    family: HashFamily,
    counts: Staged,
    n_points: int,
    id_col: str = "id",
    carry: Sequence[str] = (),
    features: str = "features",
) -> DataFrame:
    """``neighbors``: over all tables, the other members of the point's buckets (a multiset count).

    Buckets with one member add nothing and stay out of the join.
    """
    multi = crowded_only(counts)
    values = {"neighbors": F.col("n") - 1}
    return sum_over_buckets(points, family, multi, values, n_points, id_col, carry, features)


def bucket_members(
    points: DataFrame,
    family: HashFamily,
    counts: Staged,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> DataFrame:
    """Who shares a bucket: one row per bucket of two or more and member, never a list."""
    multi = crowded_only(counts)
    return join_buckets(points, family, multi, n_points, [id_col], features)


def bucket_size_histogram(counts: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(counts, "n", bins)


def buckets_of_point(
    points: DataFrame,
    family: HashFamily,
    counts: DataFrame,
    point: Column,
    features: str = "features",
) -> DataFrame:
    """The rows of ``counts`` for the buckets of the one point that ``point`` selects."""
    own = hash_points(points.filter(point), family, features, keep=())
    # One row per hash table, so the broadcast is bounded by the family itself.
    return counts.join(F.broadcast(own), family.keys, "left_semi")


def first_of_class(points: DataFrame, predicate: Column, id_col: str = "id") -> Column:
    """The smallest id among the rows of a class, as a scalar for filters."""
    return points.filter(predicate).agg(F.min(id_col)).scalar()


def bucket_distances(
    points: DataFrame,
    family: HashFamily,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> DataFrame:
    """Mean distance of the members of a bucket to its reference, the member with the lowest id.

    Buckets of two or more; the reference itself counts with distance 0.
    """
    hashed = hash_points(points, family, features, keep=[id_col])
    grouped = hashed.groupBy(*family.keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("_head"))
    heads = stage(grouped.filter("n > 1"), "heads")
    located = points.select(F.col(id_col).alias("_head"), F.col(features).alias("_origin"))
    # A point heads at most one bucket per table, so its id is not a hot key on either side.
    side = F.broadcast(heads.df) if _fits(heads, 0) else heads.df.hint("merge")
    references = stage(side.join(located, "_head"), "references")
    members = points.select(id_col, features)
    joined = join_buckets(members, family, references, n_points, [features], features, family.dim)
    gap = distance(F.col(features), F.col("_origin"), family.dim)
    return joined.groupBy(*family.keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_distance")
    )
