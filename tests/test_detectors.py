import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bucketscore import (
    BucketCountDetector,
    BucketCountModel,
    DualResolutionDetector,
    DualResolutionModel,
    HashFamily,
    ReachabilityDetector,
    ReachabilityModel,
    distance_sweep,
    grid_search,
    run_experiment,
    tune_w,
)
from bucketscore import staging
from bucketscore.functions.scalar import hash01
from bucketscore.operators import buckets as B
from bucketscore.plans import experiments, tuning
from bucketscore.plans.experiments import fold_bucket_sizes, fold_counts, grid_report, grid_scores, grid_summary, published_grid
from bucketscore.plans.tuning import halved_counts, least_by_length, least_neighbors, minimum_neighbors, starting_radius, tune_family, tune_key_length, tune_radius
from bucketscore.streaming.scoring import score_stream
from tests import brute

SCHEMA = "id bigint, label double, features array<double>"
FIXED = dict(keyLength=2, numTables=8, splitW=3.0, seed=5)


@pytest.fixture(scope="module")
def raw():
    """A Gaussian bulk and a few planted outliers."""
    rng = np.random.default_rng(4)
    bulk = [(0.0, x) for x in rng.standard_normal((400, 6)).tolist()]
    out = [(1.0, x) for x in rng.uniform(-6, 6, (6, 6)).tolist()]
    return {i: row for i, row in enumerate(bulk + out)}


@pytest.fixture(scope="module")
def points(spark, raw):
    return spark.createDataFrame([(k, y, x) for k, (y, x) in raw.items()], SCHEMA)


def family_of(**values):
    return HashFamily(6, FIXED["keyLength"], FIXED["numTables"], (FIXED["splitW"],), seed=FIXED["seed"], **values)


def test_bucket_count(points, raw):
    own = brute.bucket_ids({k: x for k, (_, x) in raw.items()}, family_of())
    r = brute.reach(own)
    model = BucketCountDetector(**FIXED).fit(points)
    assert model.threshold == sorted(v - 8 for v in r.values())[5]
    scored = {x.id: x for x in model.transform(points).collect()}
    assert {k: -x.score for k, x in scored.items()} == r
    assert all(x.prediction == float(r[k] <= model.threshold) for k, x in scored.items())
    alone = BucketCountDetector(**FIXED, excludeSelf=True).fit(points).transform(points)
    assert {x.id for x in alone.collect() if x.prediction} == {k for k, v in r.items() if v - 8 <= model.threshold}
    assert model.summary().first().buckets == len(brute.sizes(own))


def test_reachability(points, raw):
    own = brute.bucket_ids({k: x for k, (_, x) in raw.items()}, family_of())
    want = brute.scores(own, brute.estimators(own))
    model = ReachabilityDetector(**FIXED).fit(points)
    scored = model.transform(points)
    assert scored.columns == ["id", "label", "features", "score1", "score2", "score3", "score4", "prediction"]
    for x in scored.collect():
        assert [x.score1, x.score2, x.score3, x.score4] == pytest.approx(want[x.id])
    assert model.threshold == -sorted(v - 8 for v in brute.reach(own).values())[5]
    # Other scores: each training row is taken out of its buckets, as a fresh row would meet them.
    alone = brute.left_out_scores(own)
    for i, name in ((1, "score2"), (3, "score4")):
        other = ReachabilityDetector(**FIXED, predictionScore=name).fit(points)
        assert other.threshold == pytest.approx(sorted((s[i] for s in alone.values()), reverse=True)[5])
        rows = other.transform(points).collect()
        assert {x.id for x in rows if x.prediction} == {k for k, s in want.items() if s[i] >= other.threshold - 1e-12}
        left_out = other.set_params(excludeSelf=True).transform(points).collect()
        assert {x.id: [x.score1, x.score2, x.score3, x.score4] for x in left_out} == {k: pytest.approx(v) for k, v in alone.items()}


def test_dual_resolution(points, raw):
    plain = {k: x for k, (_, x) in raw.items()}
    family = family_of().at(1.5, 6.0)
    small, large = (brute.reach(brute.bucket_ids(plain, family, w)) for w in family.widths)
    detector = DualResolutionDetector(keyLength=2, numTables=8, seed=5, splitWSmall=1.5, splitWLarge=6.0)
    model = detector.fit(points)
    assert model.thresholds == [sorted(v - 8 for v in s.values())[5] for s in (small, large)]
    for x in model.transform(points).collect():
        assert (-x.score_small, -x.score_large) == (small[x.id], large[x.id])
        assert x.density_ratio == pytest.approx(small[x.id] / large[x.id])
        assert x.score == pytest.approx(-small[x.id] / large[x.id])
    far = points.sparkSession.createDataFrame([(1, None, [1e6, -1e6, 1e6, 1e6, 1e6, -1e6])], SCHEMA)
    row = model.transform(far).first()
    assert (row.density_ratio, row.score, row.prediction) == (None, 0.0, 1.0)


def test_dual_widths_are_tuned_apart(points):
    model = DualResolutionDetector(keyLength=2, numTables=8, seed=5).fit(points)
    assert model.family.widths[0] < model.family.widths[1]
    with pytest.raises(ValueError, match="below"):
        DualResolutionDetector(keyLength=2, numTables=8, splitWSmall=4.0, splitWLarge=2.0).fit(points)


@pytest.mark.parametrize(
    "detector, kind",
    [
        (BucketCountDetector(**FIXED), BucketCountModel),
        (ReachabilityDetector(**FIXED, predictionScore="score4"), ReachabilityModel),
        (DualResolutionDetector(keyLength=2, numTables=8, splitWSmall=1.5, splitWLarge=6.0), DualResolutionModel),
    ],
)
def test_save_and_load(spark, points, tmp_path, detector, kind):
    model = detector.fit(points)
    before = sorted(model.transform(points).drop("features").collect())
    model.save(str(tmp_path / "model"))
    model.release()
    again = kind.load(spark, str(tmp_path / "model"))
    assert sorted(again.transform(points).drop("features").collect()) == before
    assert again.getOrDefault("keyLength") == 2
    other = BucketCountModel if kind is not BucketCountModel else ReachabilityModel
    with pytest.raises(ValueError):
        other.load(spark, str(tmp_path / "model"))


def test_vectors_other_names_and_pipeline(points):
    renamed = points.select(F.col("id").alias("key"), F.col("label").alias("y"), array_to_vector("features").alias("v"))
    detector = ReachabilityDetector(**FIXED, idCol="key", featuresCol="v", labelCol="y")
    got = Pipeline(stages=[detector]).fit(renamed).transform(renamed)
    want = ReachabilityDetector(**FIXED).fit(points).transform(points)
    assert {(r.key, r.score1) for r in got.collect()} == {(r.id, r.score1) for r in want.collect()}


def test_multiplier_and_partitions(points):
    model = BucketCountDetector(**FIXED, numTablesMultiplier=3, numPartitions=5).fit(points)
    assert model.family.num_tables == 24
    assert model.buckets.df.agg(F.sum("n")).first()[0] == 24 * 406
    with pytest.raises(ValueError):
        BucketCountDetector(nosuch=1)


def test_no_anomaly_uses_contamination(points):
    clean = points.withColumn("label", F.lit(0.0))
    near = BucketCountDetector(**FIXED, contamination=0.05).fit(clean)
    few = BucketCountDetector(**FIXED).fit(clean)
    assert near.threshold >= few.threshold
    unlabelled = BucketCountDetector(**FIXED).fit(points.drop("label"))
    assert unlabelled.threshold == few.threshold


def test_rebalancing_is_repeatable(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(i % 10 == 0), x) for i, x in enumerate(rng.standard_normal((500, 6)).tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = df.filter((F.col("label") == 0) | (hash01("id", 5, "rebalance") < 0.1)).count()
    a = BucketCountDetector(**FIXED).fit(df)
    b = BucketCountDetector(**FIXED).fit(df.repartition(7))
    assert a.rows == b.rows == kept < 500
    assert sorted(a.buckets.df.collect()) == sorted(b.buckets.df.collect())


def test_edge_cases(spark):
    same = spark.createDataFrame([(i, 0.0, [1.0, 2.0]) for i in range(10)], SCHEMA)
    model = BucketCountDetector(**FIXED).fit(same)
    assert model.buckets.df.count() == 8
    assert {r.n for r in model.buckets.df.collect()} == {10}
    one = BucketCountDetector(**FIXED).fit(same.limit(1))
    assert one.threshold == 0
    assert one.summary().first().relative_size == 0.0
    for bad, message in (
        (same.limit(0), "no rows"),
        (spark.createDataFrame([(1, 0.0, [1.0]), (2, 0.0, [1.0, 2.0])], SCHEMA), "length"),
        (spark.createDataFrame([(1, 0.0, None)], SCHEMA), "null"),
        (spark.createDataFrame([(1, 0.0, [1.0, None])], SCHEMA), "null"),
        (spark.createDataFrame([(1, 0.0, [float("nan")])], SCHEMA), "NaN"),
    ):
        with pytest.raises(ValueError, match=message):
            BucketCountDetector(**FIXED).fit(bad)


@pytest.mark.parametrize("kind", [BucketCountDetector, ReachabilityDetector])
def test_repeated_ids_are_refused(points, kind):
    twice = points.unionByName(points.filter("id = 3"))
    with pytest.raises(ValueError, match="unique"):
        kind(**FIXED).fit(twice)


def test_planted_outliers_are_found(spark):
    rng = np.random.default_rng(9)
    bulk = [(0.0, x) for x in rng.standard_normal((5000, 8)).tolist()]
    out = [(1.0, x) for x in rng.uniform(-6, 6, (50, 8)).tolist()]
    df = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(bulk + out)], SCHEMA).repartition(4)
    model, measures = run_experiment(df, ReachabilityDetector(seed=3))
    got = {r.estimator: r.auroc for r in measures.collect()}
    assert min(got[f"score{i}"] for i in (1, 2, 3, 4)) > 0.95
    share = model.summary().first().relative_size
    assert 0.05 <= share <= 0.1


def test_scaling_on_all_rows(points):
    model, measures = run_experiment(points, BucketCountDetector(**FIXED), scale_on="all")
    assert {r.estimator for r in measures.collect()} == {"score", "prediction"}
    with pytest.raises(ValueError):
        run_experiment(points, BucketCountDetector(**FIXED), scale_on="test")


def test_histograms(points, raw):
    model = BucketCountDetector(**FIXED).fit(points)
    own = brute.bucket_ids({k: x for k, (_, x) in raw.items()}, family_of())
    count = brute.sizes(own)
    assert model.size_histogram().agg(F.sum("rows")).first()[0] == len(count)
    first = min(k for k, (y, _) in raw.items() if y == 1.0)
    around = model.size_histogram_around(points, anomaly=True, bins=4).collect()
    values = [count[b] for b in own[first]]
    low, high = min(values), max(values)
    want = {}
    for v in values:
        i = min(int((v - low) * 4 / (high - low)), 3) if high > low else 0
        want[i] = want.get(i, 0) + 1
    assert {r.bin: r.rows for r in around} == want
    assert model.size_histogram_around(points, anomaly=False).agg(F.sum("rows")).first()[0] == 8


def test_tune_w_in_range_and_refined(points):
    family = HashFamily(6, 2, 8, seed=5)
    chosen = tune_family(points, family)
    share = B.bucket_stats(B.bucket_counts(points, chosen), 406).first().relative_size
    assert 0.05 <= share <= 0.1 and tune_w(points, family) == chosen.widths[0]
    narrow = tune_family(points, family, low=share * 1.02, high=share * 1.2)
    refined = B.bucket_stats(B.bucket_counts(points, narrow), 406).first().relative_size
    assert share * 1.02 <= refined <= share * 1.2
    with pytest.raises(ValueError, match="one bucket"):
        tune_w(points, family, low=2.0, high=3.0)


def test_halved_counts_are_those_of_each_width(points):
    family = HashFamily(6, 3, 5, (64.0,), seed=5)
    finest = family.finer(7)
    assert finest.widths == (0.5,)
    levels = halved_counts(points, finest, 8)
    for level in (0, 3, 7):
        own = levels.filter(F.col("level") == level).select(*family.keys, "n").collect()
        assert sorted(own) == sorted(B.bucket_counts(points, family.finer(7 - level)).collect())
        counted = brute.sizes(brute.bucket_ids({r.id: r.features for r in points.collect()}, family.finer(7 - level), family.finer(7 - level).widths[0]))
        assert sorted(r.n for r in own) == sorted(counted.values())


@pytest.mark.parametrize("spread", [1e-2, 1e-6, 1e-9])
def test_tight_clusters_get_a_width(spark, spread):
    draw = np.random.default_rng(3)
    rows = [(i, [float(100 * (i % 3)) + spread * draw.random(), float(100 * (i // 3 % 3)) + spread * draw.random()]) for i in range(600)]
    table = spark.createDataFrame(rows, "id bigint, features array<double>")
    chosen = tune_family(table, HashFamily(2, 2, 6, seed=5))
    assert 0.05 <= B.bucket_stats(B.bucket_counts(table, chosen), 600).first().relative_size <= 0.1


def test_equal_rows_cannot_be_tuned(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "id bigint, features array<double>")
    with pytest.raises(ValueError, match="equal"):
        tune_w(table, HashFamily(2, 2, 6, seed=5))
    # Two of a kind are a share within range.
    pairs = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(40)], "id bigint, features array<double>")
    assert tune_w(pairs, HashFamily(2, 2, 6, seed=5)) > 0
    with pytest.raises(ValueError, match="no rows"):
        tune_w(table.limit(0), HashFamily(2, 2, 6, seed=5))


def test_tune_key_length(points):
    family = HashFamily(6, 1, 4, (4.0,), seed=5)
    bulk, rows = points.filter("label = 0"), 400
    longest = HashFamily(6, 22, 4, (16.0,), seed=5)
    least = {k: minimum_neighbors(bulk, longest.shorten(k), rows) for k in (1, 4, 6, 8)}
    assert least[1] >= least[4] >= least[6] >= least[8]
    wanted = least[6]
    assert wanted > 0
    chosen = tune_key_length(bulk, family.at(16.0), wanted, rows)
    assert 0.2 * wanted <= minimum_neighbors(bulk, chosen, rows) <= 4.0 * wanted
    assert tune_key_length(points, family, 10**6, 406).key_length >= 1
    assert starting_radius(points, 6) > 0


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_least_neighbors_by_key_length(points, raw, limit):
    """One pass for all prefixes gives what each of them gives alone."""
    family = HashFamily(6, 9, 4, (6.0,), seed=5)
    points.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        found = least_by_length(points, family, (1, 2, 5, 9), 406)
    finally:
        points.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = {k: x for k, (_, x) in raw.items()}
    for length, (least, buckets) in found.items():
        own = brute.bucket_ids(plain, family.shorten(length))
        count = brute.sizes(own)
        assert least == min(sum(count[b] - 1 for b in bs) for bs in own.values()) and buckets == len(count)


def test_key_length_search_ends_for_equal_rows(spark):
    same = spark.createDataFrame([(i, [float(i % 2)] * 6) for i in range(60)], "id bigint, features array<double>")
    family = HashFamily(6, 1, 4, (0.5,), seed=5)
    with pytest.raises(ValueError, match="equal"):
        tune_key_length(same, family, 1, 60)
    assert tune_key_length(same, family, 100, 60).key_length >= 1


@pytest.mark.parametrize("score", ["score1", "score2", "score3", "score4"])
def test_fresh_rows_are_flagged_as_often_as_wanted(spark, score):
    draw = np.random.default_rng(11)
    tables = []
    for part in range(2):
        rows = [(i, None, x) for i, x in enumerate(draw.standard_normal((3000, 3)).tolist())]
        tables.append(spark.createDataFrame(rows, SCHEMA).repartition(4))
    detector = ReachabilityDetector(keyLength=2, numTables=20, splitW=1.0, seed=5, contamination=0.2, predictionScore=score)
    model = detector.fit(tables[0])
    flagged = model.transform(tables[1]).agg(F.avg("prediction")).first()[0]
    assert 0.18 <= flagged <= 0.22
    # The training rows themselves, left out of their buckets, are flagged exactly as often.
    own = model.set_params(excludeSelf=True).transform(tables[0]).agg(F.sum("prediction")).first()[0]
    assert 600 <= own <= 600 + (60 if score == "score1" else 2)


def test_wanted_bucket_size_steers_the_width(points):
    sizes = []
    for wanted in (10, 60):
        model = BucketCountDetector(keyLength=2, numTables=8, seed=5, minBucketSize=wanted, tuneFraction=1.0).fit(points)
        sizes.append(model.summary().first().mean_size)
        assert wanted <= sizes[-1] <= 2 * wanted
    assert sizes[0] < sizes[1]


def test_least_neighbors_by_radius(points, raw):
    family = HashFamily(6, 2, 5, (3.0,), radius=2.0, seed=5)
    found = least_neighbors(points, family, (0.5, 1.0, 4.0), 406)
    plain = {k: x for k, (_, x) in raw.items()}
    for radius, (least, buckets) in found.items():
        own = brute.bucket_ids(plain, family, 3.0 * radius)
        count = brute.sizes(own)
        assert least == min(sum(count[b] - 1 for b in bs) for bs in own.values()) and buckets == len(count)


@pytest.mark.parametrize("wanted, start", [(3, 1.0), (40, None), (900, 1e-4), (5, 1e5)])
def test_tuned_radius_is_within_tolerance(points, wanted, start):
    family = HashFamily(6, 1, 4, (4.0,), radius=1.5, seed=5)
    bulk = points.filter("label = 0")
    chosen = tune_radius(bulk, family, wanted, 400, start=start)
    assert chosen.widths == family.widths and chosen.radius != family.radius
    assert 0.1 * wanted <= minimum_neighbors(bulk, chosen, 400) <= 10 * wanted


def test_radius_search_ends(points, spark):
    family = HashFamily(6, 1, 4, (4.0,), seed=5)
    with pytest.raises(ValueError, match="one bucket"):
        tune_radius(points, family, 10**6, 406)
    same = spark.createDataFrame([(i, [float(i % 2)] * 6) for i in range(60)], "id bigint, features array<double>")
    with pytest.raises(ValueError, match="equal"):
        tune_radius(same, family, 1, 60)
    assert tune_radius(same, family, 20, 60).radius > 0


def test_published_grid_times_every_width(points):
    options = dict(widths=(2.0, 8.0), key_length=2, num_tables=4, folds=2, seed=5)
    timed = published_grid({"a": points}, timed=True, **options)
    rows = {(r.dataset, r.w): r.asDict() for r in timed.collect()}
    assert set(rows) == {("a", 2.0), ("a", 8.0)}
    assert all(r.pop("seconds") > 0 for r in rows.values())
    plain = {(r.dataset, r.w): r.asDict() for r in published_grid({"a": points}, **options).collect()}
    assert plain == {k: pytest.approx(v) for k, v in rows.items()}


def test_distance_sweep(points, raw):
    family = HashFamily(6, 2, 4, seed=5)
    got = {r.radius: r.mean_distance for r in distance_sweep(points, family, 406, (0.5, 2.0), 3.0).collect()}
    plain = {k: x for k, (_, x) in raw.items()}
    for radius, value in got.items():
        members = {}
        for key, of in brute.bucket_ids(plain, family, radius * 3.0).items():
            for b in of:
                members.setdefault(b, []).append(key)
        means = []
        for m in members.values():
            if len(m) > 1:
                means.append(np.mean([np.linalg.norm(np.array(plain[i]) - np.array(plain[min(m)])) for i in m]))
        assert value == pytest.approx(np.mean(means))
    assert set(got) == {0.5, 2.0}


@pytest.mark.parametrize("limit", ["10MB", "-1"])
@pytest.mark.parametrize("widths", [(2.0,), (1.0, 4.0)])
def test_grid_equals_separate_fits(spark, points, raw, widths, limit):
    """Fold columns give what one fit per width and fold gives."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    family = HashFamily(6, 2, 5, seed=5)
    rows = grid_search(points, family, widths, folds=3, seed=5)
    got = {(r.w, r.fold, r.estimator): r.auroc for r in rows.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    fold = {r.id: r.f for r in points.select("id", F.floor(hash01("id", 5, "fold") * 3).alias("f")).collect()}
    for w in widths:
        own = brute.bucket_ids({k: x for k, (_, x) in raw.items()}, family, w)
        for f in range(3):
            table = brute.estimators({k: v for k, v in own.items() if fold[k] != f})
            found = brute.scores({k: v for k, v in own.items() if fold[k] == f}, table)
            labels = [raw[k][0] for k in found]
            for e in range(4):
                want = brute.auroc([s[e] for s in found.values()], labels)
                assert got[(w, f, e + 1)] == (want if want is None else pytest.approx(want))
    assert len(got) == len(widths) * 3 * 4


def test_grid_summary_and_sizes(points):
    family = HashFamily(6, 2, 5, (2.0, 4.0), seed=5)
    found = fold_counts(points, family, folds=3, seed=5)
    assert grid_scores(found, family, folds=3).count() == 406 * 2
    sizes = fold_bucket_sizes(found, 3).collect()
    assert {(r.w, r.fold) for r in sizes} == {(w, f) for w in (2.0, 4.0) for f in range(3)}
    total = found.training.count()
    own = {r.fold: r["count"] for r in found.training.groupBy("fold").count().collect()}
    for r in sizes:
        assert r.relative_size == pytest.approx(r.mean_size / (total - own[r.fold]))
    rows = points.sparkSession.createDataFrame([(1.0, 0, 1, 0.5), (1.0, 1, 1, 0.7), (1.0, 2, 1, None)], "w double, fold int, estimator int, auroc double")
    row = grid_summary(rows).first()
    assert (row.mean_auroc, row.std_auroc, row.folds) == (pytest.approx(0.6), pytest.approx(0.1), 2)


def test_stream_scores_equal_batch_scores(spark, points, tmp_path):
    model = BucketCountDetector(**FIXED).fit(points)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    points.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = score_stream(stream, model, lambda df, number: df.write.mode("append").parquet(sink))
    run = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {(r.id, r.score, r.prediction) for r in spark.read.parquet(sink).collect()}
    assert got == {(r.id, r.score, r.prediction) for r in model.transform(points).collect()}


@pytest.mark.parametrize("at_once", [406 * 2, 406 * 5 * 2])
def test_grid_in_passes_gives_the_same_and_leaves_nothing(spark, points, monkeypatch, at_once):
    """Widths and tables apart: two tables of one width at a time, or all tables of two widths."""
    made = points.withColumn("label", F.when(F.col("id") % 9 == 0, 1.0).otherwise(F.col("label")))
    family = HashFamily(6, 2, 5, seed=5)
    whole = {r.w: r.asDict() for r in grid_report(made, family, (0.5, 1.0, 4.0), 3, 5).drop("dataset").collect()}
    monkeypatch.setattr(experiments, "HASHED_AT_ONCE", at_once)
    monkeypatch.setattr(experiments, "TABLES_AT_ONCE", 1)
    staged = set()
    monkeypatch.setattr(staging, "session_folder", lambda s, name, make=staging.session_folder: staged.add(made := make(s, name)) or made)
    table = grid_report(made, family, (0.5, 1.0, 4.0), 3, 5).drop("dataset")
    assert whole == {r.w: pytest.approx(r.asDict(), rel=1e-12) for r in table.collect()}
    left = {os.path.basename(p).split("-")[0] for p in staged if os.path.isdir(f"{p}/rows")}
    assert left == {"folds", "areas", "sizes"}


def test_a_point_without_neighbors_settles_the_minimum(points, raw, monkeypatch):
    far = points.sparkSession.createDataFrame([(999, 1.0, [90.0] * 6), (1000, 1.0, [70.0] * 6), (1000, 1.0, [70.0] * 6)], SCHEMA)
    family = HashFamily(6, 2, 5, (1.0, 4.0, 1e6), seed=5)
    assert tuning.widths_without_neighbors(points.unionByName(far), family) == {1.0, 4.0}
    # The same id twice is no lonely point.
    assert tuning.widths_without_neighbors(points.filter("label = 0").unionByName(far.filter("id = 1000")), family.at(1e6)) == set()
    monkeypatch.setattr(tuning, "LOCAL_ROWS", 0)
    monkeypatch.setattr(tuning, "minimum_neighbors", lambda *a: pytest.fail("counted all the same"))
    assert tuning.least_by_radius(points.unionByName(far), family.at(1.0), [1.0, 2.0], 409) == {1.0: 0, 2.0: 0}


@pytest.mark.parametrize("width", [0.5, 6.0])
def test_minimum_neighbors_in_passes(points, raw, monkeypatch, width):
    family = HashFamily(6, 2, 5, (width,), seed=5)
    own = brute.bucket_ids({k: x for k, (_, x) in raw.items()}, family)
    count = brute.sizes(own)
    monkeypatch.setattr(tuning, "COUNTED_AT_ONCE", 406 * 2)
    monkeypatch.setattr(tuning, "LOCAL_BYTES", 0)
    assert minimum_neighbors(points, family, 406) == min(sum(count[b] - 1 for b in bs) for bs in own.values())


def test_sweep_in_passes(points, monkeypatch):
    family = HashFamily(6, 2, 5, seed=5)
    widths = (1e-4, 0.5, 4.0, 1e6)
    whole = {r.w: r.asDict() for r in tuning.w_sweep(points, family, widths, 406).collect()}
    monkeypatch.setattr(tuning, "SWEPT_AT_ONCE", 406 * 4 * 2)
    passes = tuning.w_sweep(points, family, widths, 406)
    assert {r.w: {k: pytest.approx(v) if v is not None else None for k, v in r.asDict().items()} for r in passes.collect()} == whole
    assert len(passes.inputFiles()) >= 3 and all("sizes" in f for f in passes.inputFiles())
