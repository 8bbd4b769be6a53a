import pytest
from pyspark.sql import functions as F

from bucketscore.functions.scalar import distance, hash01, histogram
from bucketscore.operators.encoding import category_dictionary, fit_one_hot, one_hot
from bucketscore.operators.sampling import class_counts, rebalance, sample, split, with_fold
from bucketscore.operators.scaling import Scaling, as_array, as_vector, fit_scaling
from bucketscore.sources.points import (
    read_libsvm,
    with_content_id,
    with_row_number,
    write_folds,
    write_libsvm,
    write_scored,
)

SCHEMA = "id bigint, label double, features array<double>"


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, float(i % 4 == 0), [float(i), 5.0, float(i % 3)]) for i in range(200)], SCHEMA)


def test_scaling(points):
    scaling = fit_scaling(points)
    assert scaling.mean == pytest.approx([99.5, 5.0, 0.995])
    assert scaling.std[1] == 0.0
    moments = scaling.apply(points).select(F.posexplode("features").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"))
    got = {r.p: (r.m, r.s) for r in moments.collect()}
    assert got[0] == (pytest.approx(0, abs=1e-12), pytest.approx(1))
    assert got[1] == (0.0, 0.0)
    assert [tuple(r) for r in scaling.to_df(points.sparkSession).orderBy("pos").collect()] == [
        (i, m, s) for i, (m, s) in enumerate(zip(scaling.mean, scaling.std))
    ]


def test_scaling_of_many_features(spark):
    rows = [(i, 0.0, [float((i + j) % 7) if j != 5 else 2.0 for j in range(80)]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    scaling = fit_scaling(df)
    got = {r.id: r.features for r in scaling.apply(df).collect()}
    for i, _, x in rows:
        want = [(v - m) / s if s else 0.0 for v, m, s in zip(x, scaling.mean, scaling.std)]
        assert got[i] == pytest.approx(want)


def test_vectors_and_arrays(points):
    again = as_array(as_vector(points))
    assert again.collect() == points.collect()
    assert as_vector(as_vector(points)).schema["features"].dataType.typeName() == "vectorudt"


def test_distance_short_and_long(spark):
    for dim in (3, 100):
        df = spark.createDataFrame([([1.0] * dim, [3.0] * dim)], "p array<double>, q array<double>")
        assert df.select(distance(F.col("p"), F.col("q"), dim)).first()[0] == pytest.approx(2 * dim**0.5)


def test_rebalance_branches(points):
    assert class_counts(points).anomalies == 50
    kept = rebalance(points, seed=1)
    assert kept.filter("label = 0").count() == 150
    draws = {r.id: r.u for r in points.filter("label = 1").select("id", hash01("id", 1, "rebalance").alias("u")).collect()}
    assert {r.id for r in kept.filter("label = 1").collect()} == {k for k, u in draws.items() if u < 0.01 * 200 / 50}
    few = points.filter("label = 0 or id = 0")
    assert rebalance(few).count() == 151
    assert kept.collect() == rebalance(points.repartition(3), seed=1).orderBy("id").collect()


def test_split_sample_and_folds(points):
    train, test = split(points)
    assert train.count() + test.count() == 200
    assert train.join(test, "id").count() == 0
    assert 130 < train.count() < 190
    assert sample(points, 1.0).count() == 200 and sample(points, 0.0).count() == 0
    folds = with_fold(points, 4).groupBy("fold").count().collect()
    assert {r.fold for r in folds} == {0, 1, 2, 3} and sum(r["count"] for r in folds) == 200
    draws = [r.u for r in points.select(hash01("id", 3, "sample").alias("u")).collect()]
    assert 0 <= min(draws) and max(draws) < 1 and len(set(draws)) == 200


def test_one_hot(spark):
    rows = [(1, 0.0, [2.0, 10.0, 0.5]), (2, 1.0, [0.9, 30.0, 1.5]), (3, 0.0, [2.0, 30.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.pos: r.cats for r in category_dictionary(df, 2).collect()} == {0: [0, 2], 1: [10, 30]}
    dictionary = fit_one_hot(df, 2)
    assert dictionary.sizes == (2, 2) and dictionary.width == 4
    slots = {(r.pos, r.value): (r.slot, r.rows) for r in dictionary.table.df.collect()}
    assert slots == {(0, 0): (0, 1), (0, 2): (1, 2), (1, 10): (2, 1), (1, 30): (3, 2)}
    got = {r.id: r.features for r in one_hot(df, dictionary, form="array").collect()}
    assert got == {1: [0, 1, 1, 0, 0.5], 2: [1, 0, 0, 1, 1.5], 3: [0, 1, 0, 1, 0.0]}
    sparse = {r.id: r.features for r in one_hot(df, dictionary).collect()}
    assert (sparse[2].size, sparse[2].indices, sparse[2]["values"]) == (5, [0, 3, 4], [1.0, 1.0, 1.5])
    fresh = spark.createDataFrame([(4, 0.0, [7.0, 10.0, 2.0])], SCHEMA)
    assert one_hot(fresh, dictionary, handle_invalid="zero", form="array").first().features == [0, 0, 1, 0, 2.0]
    with pytest.raises(Exception, match="unknown category in feature 0: 7"):
        one_hot(fresh, dictionary).collect()
    none = spark.createDataFrame([(5, 0.0, [None, 10.0])], SCHEMA)
    assert one_hot(none, dictionary, handle_invalid="zero").first().features.indices == [2]
    with pytest.raises(Exception, match="unknown category in feature 0: null"):
        one_hot(none, dictionary).collect()


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_wide_one_hot_with_a_hot_category(spark, limit, tmp_path):
    """More values than a dense row should have; a third of the rows share one of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        value = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 2).cast("double")
        features = F.array(value, (F.col("id") % 5).cast("double"), F.lit(0.5))
        wide = spark.range(180_000).select("id", F.lit(1.0).alias("label"), features.alias("features"))
        known = fit_one_hot(wide, 2)
        assert known.sizes == (120_001, 5) and known.rows == 180_000
        encoded = one_hot(wide, known, form="vector")
        plan = one_hot(wide, known)._jdf.queryExecution().toString()
        assert "array_to_vector" not in plan and "sequence(0, (" not in plan
        assert ("_salt" in plan) == (limit == "-1")
        rows = encoded.filter("id in (0, 3, 5, 179999)").collect()
        assert len(rows) == 4 and {type(r.features).__name__ for r in rows} == {"SparseVector"}
        value_at = {r.slot: r.value for r in known.table.df.collect()}
        for r in rows:
            assert r.features.size == 120_007 and list(r.features.values) == [1.0, 1.0, 0.5]
            first, second, tail = (int(i) for i in r.features.indices)
            assert value_at[first] == (7 if r.id % 3 == 0 else 2 * r.id) and value_at[second] == r.id % 5 and tail == 120_006
        write_libsvm(encoded, str(tmp_path / "wide"))
        back = spark.read.format("libsvm").option("numFeatures", "120007").load(str(tmp_path / "wide"))
        assert back.count() == 180_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 9, 10, 10)], "v double")
    assert {r.bin: r.rows for r in histogram(df, "v", 5).collect()} == {0: 2, 1: 1, 4: 3}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [(r.bin, r.rows) for r in histogram(flat, "v", 5).collect()] == [(0, 2)]
    assert histogram(df.limit(0), "v", 5).count() == 0


def test_libsvm(spark, points, tmp_path):
    write_libsvm(points, str(tmp_path / "a"))
    back = read_libsvm(spark, str(tmp_path / "a"), 3)
    key = lambda df: sorted((r.label, *r.features) for r in df.collect())
    assert key(back) == key(points)
    assert key(read_libsvm(spark, str(tmp_path / "a"))) == key(points)
    write_folds(with_fold(points, 3), str(tmp_path / "f"))
    folds = spark.read.format("libsvm").option("numFeatures", "3").load(str(tmp_path / "f"))
    assert folds.groupBy("fold").count().orderBy("fold").collect() == with_fold(points, 3).groupBy("fold").count().orderBy("fold").collect()


def test_write_scored(spark, points, tmp_path):
    scored = as_vector(points).withColumn("score", F.col("id") * 0.5)
    write_scored(scored, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 200
    write_scored(scored, str(tmp_path / "c"), "csv")
    line = spark.read.csv(str(tmp_path / "c"), schema="id bigint, label double, features string, score double").filter("id = 4").first()
    assert tuple(line) == (4, 1.0, "4.0;5.0;1.0", 2.0)


def test_row_ids(spark, points):
    numbered = with_row_number(points.drop("id").repartition(6))
    assert sorted(r.id for r in numbered.select("id").collect()) == list(range(200))
    content = with_content_id(points.select("label", "features"))
    again = with_content_id(points.select("label", "features").repartition(5))
    assert sorted(r.id for r in content.collect()) == sorted(r.id for r in again.collect())


def test_workers_need_no_package_on_their_path(tmp_path):
    """The hashing step must run where the package is only known to the driver."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from bucketscore import HashFamily, hash_points\n"
        "df = s.sql('select 1L as id, array(1.0D, 2.0D) as features')\n"
        "print('ROWS', hash_points(df, HashFamily(2, 2, 3)).count(), len(hash_points(df, HashFamily(2, 2, 3)).collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 3 3" in out.stdout, out.stderr[-2000:]
