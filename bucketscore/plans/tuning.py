"""Choice of the bucket width (and, on request, the key length)."""

from __future__ import annotations

import logging
import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscore.functions.scalar import distance, doubles, hash01
from bucketscore.operators.buckets import LOCAL_BYTES, LOCAL_ROWS, bucket_counts, bucket_stats, merged_parts, neighbor_counts, stage_counts
from bucketscore.operators.local import Lookup, local_members
from bucketscore.operators.lsh import HashFamily, hash_points
from bucketscore.operators.sampling import sample
from bucketscore.staging import Staged, drop, passing, stage

log = logging.getLogger(__name__)

# Wanted mean size of buckets with more than one member, as a share of the rows.
LOW_SHARE = 0.05
HIGH_SHARE = 0.1
# Accepted minimum neighbour count as a multiple of the wanted one.
MIN_TOLERANCE = 0.2
MAX_TOLERANCE = 4.0

# A sweep for reports; the search for a width has no fixed ends.
CANDIDATES = tuple(2.0**e for e in range(9, -4, -1))
# Accepted minimum neighbour count of a radius as a multiple of the wanted one.
RADIUS_MIN_TOLERANCE = 0.1
RADIUS_MAX_TOLERANCE = 10.0
# Radii that one hashing pass measures.
RADII = 4
# Hashed rows of one pass of a width sweep.
SWEPT_AT_ONCE = 1 << 29
# Hashed rows of one pass over neighbours, where buckets are too many to be looked up.
COUNTED_AT_ONCE = 1 << 26
# Points far out that are tried for one without any neighbour.
LONELY = 500
# Halvings of the width that one hashing pass measures.
HALVINGS = 8
# A double tells no more halvings of the data's extent apart.
LAST_HALVING = 52
# The search for a width inside a gap stops when its ends are this close to each other.
PRECISION = 0.01


def w_sweep(points: DataFrame, family: HashFamily, widths, n_points: int, features: str = "features") -> DataFrame:
    """Bucket statistics for each width. The projections are computed once for all of them."""
    wide = replace(family.at(*widths), label_width=True)
    parts = wide.parts(SWEPT_AT_ONCE // max(1, n_points * wide.scopes))
    if len(parts) == 1:
        return bucket_stats(bucket_counts(points, wide, features), n_points, by=["w"])
    # Some tables at a time: how many buckets there are of each size is little, and adds up.
    tallies = None
    for part in parts:
        with passing(points.sparkSession) as kept:
            sizes = bucket_counts(points, part, features).groupBy("w", "n").agg(F.count(F.lit(1)).alias("buckets"))
            kept.append(stage(sizes, "sizes"))
        tallies = kept[0].df if tallies is None else tallies.unionByName(kept[0].df)
    crowded = F.when(F.col("n") > 1, F.col("buckets"))
    size = F.col("n").cast("decimal(19,0)")
    sums = tallies.groupBy("w").agg(
        F.sum("buckets").alias("buckets"),
        F.coalesce(F.sum(crowded), F.lit(0)).alias("multi_buckets"),
        F.sum(crowded * size).cast("decimal(38,0)").alias("_size"),
        F.sum(crowded * size * size).cast("decimal(38,0)").alias("_squares"),
    )
    multi = F.col("multi_buckets").cast("decimal(38,0)")
    spread = F.sqrt((F.col("_squares") * multi - F.col("_size") * F.col("_size")).cast("double"))
    return sums.select(
        "w",
        "buckets",
        "multi_buckets",
        F.try_divide(F.col("_size").cast("double"), F.col("multi_buckets")).alias("mean_size"),
        F.coalesce(F.try_divide(F.col("_size").cast("double"), F.col("multi_buckets")) / n_points, F.lit(0.0)).alias("relative_size"),
        F.try_divide(spread, F.col("multi_buckets")).alias("std_size"),
        (F.try_divide(spread, F.col("multi_buckets")) / n_points).alias("relative_std"),
    )


def extent(points: DataFrame, family: HashFamily, features: str = "features") -> float:
    """The first power of two that no projection of the points spreads beyond.

    A bucket of that width is cut at most once by each plane. The spread of a projection is at most
    the length of the plane times the diagonal of the box that holds all points.
    """
    sides = points.select(F.posexplode(features).alias("pos", "x")).groupBy("pos").agg((F.max("x") - F.min("x")).alias("side"))
    squares = sides.agg(F.sum((F.col("side") / family.radius) ** 2)).first()[0]
    spread = math.sqrt(squares or 0.0) * float(np.sqrt((family.planes**2).sum(axis=1)).max())
    return 2.0 ** math.ceil(math.log2(spread)) if spread else 1.0


def halved_counts(points: DataFrame, finest: HashFamily, halvings: int, features: str = "features") -> DataFrame:
    """Bucket counts ``(level, keys, n)`` at the width of ``finest`` (level 0) and wider ones.

    Points are hashed once. Each level doubles the width, so its codes are those of level 0 halved
    ``level`` times, and its buckets are sums of the counted ones.
    """
    counted = bucket_counts(points, finest, features)
    levels = counted.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(halvings - 1))))
    codes = [F.expr(f"shiftright({c}, level)").alias(c) for c in finest.codes]
    return levels.select("level", "t", *codes, "n").groupBy("level", "t", *finest.codes).agg(F.sum("n").alias("n"))


def different_rows(points: DataFrame, features: str = "features") -> int:
    """How many different feature rows there are; by 128 bits of hash, rows of any width."""
    marks = points.select(F.xxhash64(features).alias("x"), F.xxhash64(F.lit(1), F.reverse(features)).alias("y"))
    return marks.distinct().count()


def tune_family(
    points: DataFrame,
    family: HashFamily,
    low: float = LOW_SHARE,
    high: float = HIGH_SHARE,
    fraction: float = 1.0,
    id_col: str = "id",
    features: str = "features",
    seed: int = 7,
    n_points: int | None = None,
    precision: float = PRECISION,
) -> HashFamily:
    """``family`` at a width whose mean relative size of multi-member buckets lies in ``[low, high]``.

    The search starts at the extent of the data and halves the width until a share below ``low`` is
    met, ``HALVINGS`` of them for each hashing pass, whatever the scale of the features. The smallest
    width in range wins. Otherwise the gap that holds the range is narrowed geometrically to
    ``precision``; then the nearest width is taken with a warning. It is an error if all different
    rows are apart and the share is still too large, because then no width can help: rows that are
    equal stay together. The family returned is the one that was measured, offsets included.
    """
    if not 0 <= low <= high or low > 1:
        raise ValueError(f"no share can lie in [{low}, {high}]: one bucket per table has a share of 1")
    table = stage(points.select(id_col, features), "tuning") if n_points is None else None
    rows, chosen = (n_points, points) if table is None else (table.rows, table.df)
    if rows == 0:
        raise ValueError("no rows to tune on")
    if fraction < 1.0:
        chosen = sample(chosen, fraction, id_col, seed)
        rows = chosen.count()
        if rows == 0:
            raise ValueError(f"a share of {fraction} leaves no rows to tune on")

    def miss(share: float) -> float:
        return max(low - share, share - high, 0.0)

    widest = replace(family.at(extent(chosen, family, features)), label_width=False)
    shares: dict[float, float] = {}
    measured: dict[float, HashFamily] = {}

    def hits() -> list[float]:
        return [w for w, share in shares.items() if miss(share) == 0.0]

    halvings, apart = -1, None
    while not shares or min(shares.values()) >= low:
        if halvings >= LAST_HALVING or apart is not None and buckets >= apart * family.num_tables:
            if not hits():
                raise ValueError(f"rows that are equal keep the share at {min(shares.values())}, above {high}")
            break
        halvings += HALVINGS
        stats = bucket_stats(halved_counts(chosen, widest.finer(halvings), HALVINGS, features), rows, by=["level"])
        for r in stats.select("level", "relative_size", "buckets").collect():
            nested = widest.finer(halvings - r.level)
            shares[nested.widths[0]], measured[nested.widths[0]] = r.relative_size, nested
            if r.level == 0:
                buckets = r.buckets
        if apart is None and min(shares.values()) >= low:
            apart = different_rows(chosen, features)
    while not hits():
        bottom = max(w for w, share in shares.items() if share < low)
        top = min((w for w, share in shares.items() if share > high and w > bottom), default=bottom)
        if top <= bottom * (1 + precision):
            break
        step = (top / bottom) ** 0.25
        for r in w_sweep(chosen, family, [bottom * step**i for i in (1, 2, 3)], rows, features).select("w", "relative_size").collect():
            shares[r.w], measured[r.w] = r.relative_size, family.at(r.w)
    if table is not None:
        drop(points.sparkSession, table)
    if hits():
        return measured[min(hits())]
    best = min(shares, key=lambda w: (miss(shares[w]), w))
    log.warning("no width reached a share in [%s, %s]; using %s with %s", low, high, best, shares[best])
    return measured[best]


def tune_w(points: DataFrame, family: HashFamily, *args, **options) -> float:
    """The width that ``tune_family`` chooses, with the same arguments."""
    return tune_family(points, family, *args, **options).widths[0]


def minimum_neighbors(points: DataFrame, family: HashFamily, n_points: int, id_col: str = "id", features: str = "features") -> int:
    """The smallest neighbour count of any point."""
    spark, hashed = points.sparkSession, n_points * family.num_tables
    tables = family.num_tables
    if hashed > COUNTED_AT_ONCE:
        one = bucket_number(points, family.parts(1)[0], features)
        if one * tables * 16 > LOCAL_BYTES:
            tables = COUNTED_AT_ONCE // n_points
    sums: list[Staged] = []
    for part in family.parts(tables):
        with passing(spark) as kept:
            counts = stage_counts(points, part, features)
            near = neighbor_counts(points, part, counts, n_points, id_col, (), features)
            if tables >= family.num_tables:
                return int(near.agg(F.min("neighbors")).first()[0])
            both = [near] if not sums else [sums[-1].df, near]
            kept.append(stage(merged_parts(both, [id_col]), "neighbors"))
        drop(spark, *sums)
        sums = kept
    least = sums[0].df.agg(F.min("neighbors")).first()[0]
    drop(spark, *sums)
    return int(least)


def bucket_number(points: DataFrame, family: HashFamily, features: str = "features") -> int:
    """How many buckets there are."""
    return bucket_counts(points, family, features).count()


def widths_without_neighbors(
    points: DataFrame, family: HashFamily, id_col: str = "id", features: str = "features"
) -> set[float]:
    """Widths of the family at which a point of those farthest out has been found to have no neighbour.

    A width that is not in the set may have such a point all the same.
    """
    middle = points.select(F.posexplode(features).alias("_pos", "_x")).groupBy("_pos").agg(F.avg("_x").alias("_x"))
    center = [r._x for r in middle.orderBy("_pos").collect()]
    if len(center) != family.dim:
        return set()
    away = distance(F.col(features), doubles(center), family.dim)
    ids = points.filter(F.col(id_col).isNotNull()).orderBy(away.desc(), id_col).limit(LONELY).select(id_col).distinct()
    # The count of an id is that of all its rows.
    few = points.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"), F.first(features).alias(features))
    wide = replace(family, label_width=True)
    hashed = hash_points(few.filter("_rows = 1"), wide, features, [id_col])
    own = hashed.groupBy(*wide.keys).agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").toArrow()
    lookup = Lookup(wide, own)
    if not own.num_rows or not lookup.packs:
        return set()
    members = local_members(points, wide, lookup, features).groupBy("row").agg(F.sum("n").alias("n"))
    alone = members.filter("n = 1").toArrow()["row"].to_numpy()
    found = own.select(["w", "_id"]).take(alone).group_by(["w", "_id"]).aggregate([([], "count_all")]).to_pylist()
    return {r["w"] for r in found if r["count_all"] == family.num_tables}


def least_by_length(
    points: DataFrame, family: HashFamily, lengths, n_points: int, id_col: str = "id", features: str = "features"
) -> dict[int, tuple[int, int]]:
    """For the family's key cut to each length, the smallest neighbour count and the number of buckets.

    Points are hashed for whole keys; what is counted for those is added up for all shorter ones.
    """
    cut = replace(family, prefixes=tuple(lengths))
    counts = stage_counts(points, cut, features)
    near = neighbor_counts(points, cut, counts, n_points, id_col, (), features)
    least = {r.length: r.least for r in near.groupBy("length").agg(F.min("neighbors").alias("least")).collect()}
    buckets = {r.length: r.n for r in counts.df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    drop(points.sparkSession, counts)
    return {n: (int(least[n]), buckets[n]) for n in lengths}


def tune_key_length(
    points: DataFrame,
    family: HashFamily,
    wanted: int,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> HashFamily:
    """A family whose minimum neighbour count is within tolerance of ``wanted``.

    The lengths tried are prefixes of one key. Buckets of a prefix contain those of the whole key,
    so the minimum can only fall as the key grows. The key is doubled until its minimum is within
    the tolerance above ``wanted``; one more pass then measures all its prefixes. The shortest within the
    tolerance is taken; if that one is below it, it or the one before, whichever is nearer. It is an
    error if all different rows are apart and the minimum is still too large.
    """
    longest = replace(family, key_length=1, stored=None)
    least, apart = None, None
    while least is None or least > wanted * MAX_TOLERANCE:
        if least is not None:
            apart = different_rows(points, features) if apart is None else apart
            if buckets >= apart * family.num_tables:
                raise ValueError(f"rows that are equal keep {least} neighbours at any key length")
        # Other planes than those of the shorter key.
        longest = replace(family, key_length=2 * longest.key_length, stored=None)
        least, buckets = least_by_length(points, longest, [longest.key_length], n_points, id_col, features)[longest.key_length]
    found = least_by_length(points, longest, range(1, longest.key_length), n_points, id_col, features)
    seen = {length: count for length, (count, _) in found.items()} | {longest.key_length: least}
    reached = min(length for length, count in seen.items() if count <= wanted * MAX_TOLERANCE)
    if seen[reached] < wanted * MIN_TOLERANCE and reached > 1:
        nearer = min((reached - 1, reached), key=lambda length: (abs(seen[length] - wanted), length))
        log.warning("no key length reached %s neighbours; using %s with %s", wanted, nearer, seen[nearer])
        return longest.shorten(nearer)
    return longest.shorten(reached)


def least_neighbors(
    points: DataFrame, family: HashFamily, radii, n_points: int, id_col: str = "id", features: str = "features"
) -> dict[float, tuple[int, int]]:
    """For each radius, the smallest neighbour count of any point and the number of buckets.

    Dividing the points by a radius and multiplying the width by it are the same hash, so the points
    are projected once and the radii are widths of one family.
    """
    least = least_by_radius(points, family, radii, n_points, id_col, features)
    return {r: (n, bucket_number(points, at_radius(family, r), features)) for r, n in least.items()}


def at_radius(family: HashFamily, radius: float) -> HashFamily:
    """Dividing the points by a radius and multiplying the width by it are the same hash."""
    (width,) = family.widths
    return replace(family.at(width * radius), label_width=False)


def least_by_radius(
    points: DataFrame, family: HashFamily, radii, n_points: int, id_col: str = "id", features: str = "features"
) -> dict[float, int]:
    """For each radius, the smallest neighbour count of any point."""
    families = {float(r): at_radius(family, r) for r in radii}
    settled: set[float] = set()
    if n_points * family.num_tables * len(families) > LOCAL_ROWS:
        wide = family.at(*[f.widths[0] for f in families.values()])
        # No count is below that of a point that is alone.
        settled = widths_without_neighbors(points, wide, id_col, features)
    return {
        r: 0 if f.widths[0] in settled else minimum_neighbors(points, f, n_points, id_col, features)
        for r, f in families.items()
    }


def tune_radius(
    points: DataFrame,
    family: HashFamily,
    wanted: int,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
    start: float | None = None,
    precision: float = PRECISION,
) -> HashFamily:
    """``family`` at a radius where the point with the fewest neighbours has about ``wanted``.

    The search starts at ``start``, else at the distance of two random points, doubles the radius until
    the minimum is within or above the tolerance and halves it until it is within or below, a few radii for each pass.
    The smallest such radius in tolerance wins. Otherwise the gap between too few and too many is narrowed
    geometrically; at ``precision`` the radius whose minimum is nearest is taken, with a warning. It is an
    error if one bucket per table has too few rows, or if rows that are equal keep too many together.
    """
    if wanted < 1 or n_points < 1:
        raise ValueError("wanted and n_points must be at least 1")
    first = start if start is not None else starting_radius(points, family.dim, id_col, features, family.seed) or 1.0
    low, high = RADIUS_MIN_TOLERANCE * wanted, RADIUS_MAX_TOLERANCE * wanted
    found: dict[float, int] = {}

    def measure(radii) -> None:
        found.update(least_by_radius(points, family, radii, n_points, id_col, features))

    def buckets(radius: float) -> int:
        return bucket_number(points, at_radius(family, radius), features)

    def hits() -> list[float]:
        return [r for r, least in found.items() if low <= least <= high]

    measure([first * 2.0**e for e in range(RADII)])
    while found[max(found)] < low:
        if buckets(max(found)) <= family.num_tables:
            raise ValueError(f"one bucket per table gives {found[max(found)]} neighbours, {wanted} are wanted")
        measure([max(found) * 2.0**e for e in range(1, RADII + 1)])
    apart = None
    while found[min(found)] >= low:
        apart = different_rows(points, features) if apart is None else apart
        if buckets(min(found)) >= apart * family.num_tables:
            if not hits():
                raise ValueError(f"rows that are equal keep {found[min(found)]} neighbours at any radius")
            break
        measure([min(found) * 2.0**-e for e in range(1, RADII + 1)])
    while not hits():
        bottom = max(r for r, least in found.items() if least < low)
        top = min((r for r, least in found.items() if least > high and r > bottom), default=bottom)
        if top <= bottom * (1 + precision):
            break
        step = (top / bottom) ** 0.25
        measure([bottom * step**i for i in (1, 2, 3)])
    if hits():
        return replace(family, radius=family.radius * min(hits()))
    best = min(found, key=lambda r: (abs(found[r] - wanted), r))
    log.warning("no radius reached %s neighbours; using %s with %s", wanted, best, found[best])
    return replace(family, radius=family.radius * best)


def starting_radius(points: DataFrame, dim: int, id_col: str = "id", features: str = "features", seed: int = 7) -> float:
    """Distance of two seeded random points, a scale to start a search from."""
    pair = points.orderBy(hash01(id_col, seed, "radius"), id_col).limit(2)
    ends = pair.agg(F.min_by(features, id_col).alias("p"), F.max_by(features, id_col).alias("q"))
    return float(ends.select(distance(F.col("p"), F.col("q"), dim)).first()[0])
