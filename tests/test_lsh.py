import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketscore.operators.buckets import bucket_counts
from bucketscore.operators.local import local_counts
from bucketscore.operators.lsh import HashFamily, hash_points


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((300, 5)))]
    return spark.createDataFrame(rows, "id bigint, features array<double>")


FAMILY = HashFamily(dim=5, key_length=3, num_tables=4, widths=(2.0,), seed=11)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def expected(points, family):
    out = set()
    for row in points.collect():
        for w in family.widths:
            codes = np.floor(np.dot(family.planes, np.array(row.features) / family.radius) / w + family.offsets)
            codes = codes.astype(int).reshape(family.num_tables, -1)
            for t, key in enumerate(codes.tolist()):
                out.add((row.id, *([w] if family.sweeping else []), t, *key))
    return out


def test_codes_follow_the_formula(points):
    assert as_set(hash_points(points, FAMILY)) == expected(points, FAMILY)


def test_radius_divides(points):
    family = HashFamily(5, 3, 4, (2.0,), radius=2.5, seed=11)
    assert as_set(hash_points(points, family)) == expected(points, family)
    assert as_set(hash_points(points, family)) == as_set(hash_points(points, FAMILY.at(5.0)))


def test_native_and_arrow_forms_agree(points):
    assert as_set(hash_points(points, FAMILY, native=True)) == as_set(hash_points(points, FAMILY))


def test_sweep_equals_single_widths(points):
    sweep = FAMILY.at(1.0, 4.0)
    swept = hash_points(points, sweep)
    assert swept.columns == ["id", "w", "t", "k0", "k1", "k2"]
    for w in (1.0, 4.0):
        assert as_set(swept.filter(F.col("w") == w).drop("w")) == as_set(hash_points(points, FAMILY.at(w)))


def test_per_row_widths(points):
    sweep = FAMILY.at(1.0, 4.0)
    listed = points.withColumn(
        "ws", F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("tag")) for i, w in enumerate((1.0, 4.0))])
    )
    hashed = hash_points(listed, sweep, per_row_widths="ws")
    assert as_set(hashed.drop("tag")) == as_set(hash_points(points, sweep))
    assert {(r.w, r.tag) for r in hashed.select("w", "tag").distinct().collect()} == {(1.0, 0), (4.0, 1)}


def test_partitioning_and_order_do_not_matter(points):
    again = points.orderBy(F.desc("id")).repartition(7)
    assert as_set(hash_points(again, FAMILY)) == as_set(hash_points(points, FAMILY))


def test_counts_add_up(points):
    counts = bucket_counts(points, FAMILY)
    assert counts.agg(F.sum("n")).first()[0] == 300 * 4
    wide = bucket_counts(points, FAMILY.at(1e9))
    assert wide.count() == 4


def test_planes_survive_a_table(spark, points):
    again = HashFamily.from_planes_df(FAMILY.planes_df(spark), dim=5, key_length=3, num_tables=4, widths=(2.0,), seed=0)
    assert as_set(hash_points(points, again)) == as_set(hash_points(points, FAMILY))


@pytest.mark.parametrize("bad", ["array(1.0, 2.0)", "cast(null as array<double>)", "array(1.0, 2.0, null, 4.0, 5.0)",
                                 "array(1.0, 2.0, 3.0, 4.0, double('NaN'))"])
def test_bad_features_are_refused(spark, bad):
    df = spark.sql(f"select 1L as id, cast({bad} as array<double>) as features")
    with pytest.raises(Exception, match="features must be"):
        hash_points(df, FAMILY).collect()


def test_bad_parameters_are_refused():
    for bad in (dict(widths=(0.0,)), dict(key_length=0), dict(widths=()), dict(widths=(1.0, 1.0)), dict(radius=-1.0)):
        with pytest.raises(ValueError):
            HashFamily(**{**dict(dim=2, key_length=1, num_tables=1), **bad})


@pytest.mark.parametrize("length, width", [(3, 0.7), (40, 1e-3)])
def test_counts_merge_before_they_leave_python(spark, length, width):
    """Equal to counted rows of ``hash_points``, also where a key is too long for one number."""
    family = HashFamily(3, length, 4, (width, 50.0), seed=3)
    copies = F.array(*[F.round(F.rand(s), 1) for s in range(3)])
    points = spark.range(0, 600, 1, 2).select("id", copies.alias("features"))
    counts = bucket_counts(points, family)
    rows = hash_points(points, family, keep=()).groupBy(*family.keys).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(counts.collect()) == sorted(rows.collect())
    batches = local_counts(points, family, "features")
    assert batches.count() < 600 * 4 * 2 and batches.agg(F.sum("n")).first()[0] == 600 * 4 * 2
