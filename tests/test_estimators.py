from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import bucketscore.operators.buckets as buckets_module
from bucketscore.functions.exact import exact_total, inverse_sums, inverse_total, parts_sums
from bucketscore.functions.running import kth_smallest, running_totals
from bucketscore.operators import buckets as B
from bucketscore.operators import reach as R
from bucketscore.operators.evaluate import auroc, confusion, evaluate, rank
from bucketscore.operators.lsh import HashFamily
from bucketscore.staging import broadcast_limit, stage
from tests import brute

FAMILY = HashFamily(dim=4, key_length=2, num_tables=6, widths=(3.0,), seed=5)


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(8)
    bulk = rng.standard_normal((200, 4)).tolist()
    # A third of all rows are copies of one point.
    copies = [[0.5, -0.5, 0.25, 1.0]] * 100
    return dict(enumerate(bulk + copies))


@pytest.fixture(scope="module")
def points(spark, raw):
    return spark.createDataFrame([(k, float(k % 10 == 0), x) for k, x in raw.items()], "id bigint, label double, features array<double>")


@pytest.fixture(params=["broadcast", "split", "share", "sort"])
def joins(request, spark, monkeypatch):
    """All ways to join: a broadcast table; crowded buckets apart; no room to broadcast at all."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param != "broadcast":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        crowded = {"split": 32 << 20, "share": 64 * 6 * 20, "sort": 0}[request.param]
        monkeypatch.setattr(buckets_module, "CROWDED_BYTES", crowded)
        monkeypatch.setattr(buckets_module, "HASH_BUILD_BYTES", 0 if request.param == "sort" else 64 << 20)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def table_of(df):
    return {(r.t, *[r[c] for c in FAMILY.codes]): r for r in df.collect()}


def test_counts_and_stats(points, raw):
    want = brute.sizes(brute.bucket_ids(raw, FAMILY))
    counts = B.stage_counts(points, FAMILY)
    assert {k: r.n for k, r in table_of(counts.df).items()} == dict(want)
    assert counts.facts["multi"] == sum(n > 1 for n in want.values())
    stats = B.bucket_stats(counts.df, 300).first()
    multi = [n for n in want.values() if n > 1]
    assert (stats.buckets, stats.multi_buckets) == (len(want), len(multi))
    assert stats.mean_size == pytest.approx(np.mean(multi))
    assert stats.relative_size == pytest.approx(np.mean(multi) / 300)
    assert stats.std_size == pytest.approx(np.std(multi))


def test_reach_estimators_and_scores(points, raw, joins):
    own = brute.bucket_ids(raw, FAMILY)
    counts = B.stage_counts(points, FAMILY)
    got = {r.id: r.reach for r in R.reach(points, FAMILY, counts, 300).collect()}
    assert got == brute.reach(own)
    want = brute.estimators(own)
    table = stage(R.reach_estimators(points, FAMILY, counts, 300), "estimators")
    found = table_of(table.df)
    assert found.keys() == want.keys()
    for key, row in found.items():
        assert [row.e1, row.e2, row.e3, row.e4] == pytest.approx(want[key])
    fresh = {1000: [0.1, 0.2, 0.3, 0.4], 1001: [900.0, -900.0, 900.0, 5.0], 1002: raw[250]}
    test = points.sparkSession.createDataFrame([(k, x) for k, x in fresh.items()], "id bigint, features array<double>")
    got = {r.id: [r.score1, r.score2, r.score3, r.score4] for r in R.reach_scores(test, FAMILY, table, 300).collect()}
    expected = brute.scores(brute.bucket_ids(fresh, FAMILY), want)
    assert got.keys() == fresh.keys()
    for key in fresh:
        assert got[key] == pytest.approx(expected[key])
    assert got[1001] == [0.0, 0.0, 0.0, 0.0]


def test_members_and_distances(points, raw, joins):
    own = brute.bucket_ids(raw, FAMILY)
    members = {}
    for key, of in own.items():
        for b in of:
            members.setdefault(b, []).append(key)
    multi = {b: sorted(m) for b, m in members.items() if len(m) > 1}
    counts = B.stage_counts(points, FAMILY)
    rows = B.bucket_members(points, FAMILY, counts, 300).collect()
    got = {}
    for r in rows:
        got.setdefault((r.t, r.k0, r.k1), []).append(r.id)
    assert {b: sorted(m) for b, m in got.items()} == multi
    found = table_of(B.bucket_distances(points, FAMILY, 300))
    assert found.keys() == multi.keys()
    for b, m in multi.items():
        gaps = [np.linalg.norm(np.array(raw[i]) - np.array(raw[m[0]])) for i in m]
        assert found[b].n == len(m)
        assert found[b].mean_distance == pytest.approx(np.mean(gaps))


def test_sweep_has_one_reach_per_width(points, raw, joins):
    family = FAMILY.at(1.0, 6.0)
    counts = B.stage_counts(points, family)
    got = {(r.w, r.id): r.reach for r in R.reach(points, family, counts, 300).collect()}
    for w in family.widths:
        want = brute.reach(brute.bucket_ids(raw, family, w))
        assert {k: v for (x, k), v in got.items() if x == w} == want


def test_plan_avoids_shuffling_rows_of_broadcast_tables(points, spark):
    counts = B.stage_counts(points, FAMILY)
    plan = R.reach(points, FAMILY, counts, 300)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("build_bytes", [64 << 20, 0])
def test_hot_keys_of_scored_rows_are_split(spark, monkeypatch, build_bytes):
    """Two thirds of the rows to score are copies that no training bucket is crowded with."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(buckets_module, "CROWDED_BYTES", 64 << 10)
    monkeypatch.setattr(buckets_module, "HASH_BUILD_BYTES", build_bytes)
    family = HashFamily(3, 3, 4, (0.2,), seed=3)
    random = [F.array(*[F.randn(s + i) for i in range(3)]) for s in (1, 4)]
    train = stage(spark.range(0, 50000, 1, 4).select("id", random[0].alias("features")), "train")
    copy = F.array(F.lit(0.31), F.lit(0.5), F.lit(-0.2))
    rows = spark.range(0, 150000, 1, 4).select("id", F.when(F.col("id") % 3 != 0, copy).otherwise(random[1]).alias("features"))
    test = stage(rows, "test")
    counts = B.stage_counts(train.df, family)
    plain = {r.id: r.score for r in R.count_scores(test.df, family, counts, train.rows).collect()}
    for key, value in settings.items():
        spark.conf.set(key, value)
    scored = R.count_scores(test.df, family, counts, train.rows)
    got = {r.id: r.score for r in scored.collect()}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    for key, value in old.items():
        spark.conf.set(key, value)
    assert got == plain and len(got) == 150000
    assert "skew=true" in plan


def test_invariants(points):
    counts = B.stage_counts(points, FAMILY)
    table = R.reach_estimators(points, FAMILY, counts, 300)
    near = R.reach(points, FAMILY, counts, 300)
    row = table.agg(F.sum("e1").alias("e1"), F.sum("e4").alias("e4"), F.max(F.abs(F.col("e3") - F.col("e1") / F.col("e2"))).alias("gap")).first()
    assert row.e1 == 300 * 6
    assert row.e4 == pytest.approx(near.agg(F.sum(6 / F.col("reach"))).first()[0])
    assert row.gap < 1e-9


X0 = [(1, 0, "A"), (2, 0, "A"), (3, 0, "A"), (4, 0, "B"), (1, 1, "P"), (2, 1, "P"), (3, 1, "Q"), (4, 1, "Q")]


def test_hand_made_estimators(spark):
    """The four-point example worked out on paper."""
    own = {}
    for key, t, k in X0:
        own.setdefault(key, []).append((t, k))
    assert brute.reach(own) == {1: 5, 2: 5, 3: 5, 4: 3}
    hashed = spark.createDataFrame(X0, "id bigint, t int, k string")
    near = spark.createDataFrame(list(brute.reach(own).items()), "id bigint, reach bigint")
    sums = hashed.join(near, "id").groupBy("t", "k").agg(
        F.count(F.lit(1)).alias("c"), F.sum("reach").alias("r"), F.sum(1.0 / F.col("reach")).alias("i"))
    rows = sums.select("t", "k", *R.estimator_columns(F.col("c"), F.col("r"), F.col("i"))).collect()
    got = {(r.t, r.k): [r.e1, r.e2, r.e3, r.e4] for r in rows}
    assert got[(0, "A")] == pytest.approx([3, 5, 0.6, 0.6])
    assert got[(0, "B")] == pytest.approx([1, 3, 1 / 3, 1 / 3])
    assert got[(1, "P")] == pytest.approx([2, 5, 0.4, 0.4])
    assert got[(1, "Q")] == pytest.approx([2, 4, 0.5, 8 / 15])
    found = brute.scores(own, {b: tuple(e) for b, e in got.items()})
    assert found[3] == pytest.approx([-5, -9, -1.1, -17 / 15])
    assert found[4] == pytest.approx([-3, -7, -5 / 6, -13 / 15])


@pytest.mark.parametrize("rows_per_range", [10, 1_000_000])
def test_running_totals(spark, rows_per_range):
    rng = np.random.default_rng(1)
    values = sorted(set(rng.integers(0, 1000, 300).tolist()))
    rows = [(g, v, int(rng.integers(0, 5))) for g in ("a", "b") for v in values]
    df = spark.createDataFrame(rows, "g string, v bigint, c bigint").repartition(5)
    got = {(r.g, r.v): r.upto_c for r in running_totals(df, "v", ["c"], ["g"], rows_per_range).collect()}
    for g in ("a", "b"):
        total = 0
        for _, v, c in sorted(r for r in rows if r[0] == g):
            total += c
            assert got[(g, v)] == total
    whole = df.groupBy("v").agg(F.sum("c").alias("c"))
    ends = running_totals(whole, "v", ["c"], (), rows_per_range).agg(F.max("upto_c")).first()[0]
    assert ends == sum(r[2] for r in rows)


def test_kth_smallest(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 3, 3, 9)], "v bigint")
    assert [kth_smallest(df, "v", k).first().kth for k in (1, 2, 3, 4, 5)] == [1, 3, 3, 5, 9]


@pytest.mark.parametrize(
    "scores, labels, want",
    [([1, 1, 2, 3], [0, 1, 0, 1], 0.625), ([1, 2], [1, 1], None), ([4, 4, 4], [0, 1, 0], 0.5), ([-3, -1], [0, 1], 1.0)],
)
def test_auroc_by_hand(spark, scores, labels, want):
    df = spark.createDataFrame([(float(s), float(y)) for s, y in zip(scores, labels)], "score double, label double")
    assert auroc(df).first().auroc == want


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 3}", float(rng.integers(0, 40)) / 3, float(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, label double")
    got = {r.g: r.auroc for r in auroc(df, by=["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        part = [r for r in rows if r[0] == g]
        assert got[g] == pytest.approx(brute.auroc([r[1] for r in part], [r[2] for r in part]))


def test_exact_sums_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    groups = {g: (10.0 ** rng.uniform(-9, 9, 40)).tolist() for g in range(30)}
    rows = [(g, sign, x) for g, xs in groups.items() for sign in (1.0, -1.0) for x in xs]
    results = []
    for seed in (1, 2):
        mixed = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
        df = spark.createDataFrame(mixed, "g int, sign double, x double").repartition(1 + seed)
        sums = df.groupBy("g", "sign").agg(*parts_sums(F.col("sign") * F.col("x"), "s")).select("g", "sign", exact_total("s").alias("s"))
        results.append({(r.g, r.sign): r.s for r in sums.collect()})
    assert results[0] == results[1]
    for (g, sign), found in results[0].items():
        assert found == pytest.approx(sign * float(sum(Fraction(x) for x in groups[g])), rel=1e-15)
    none = spark.createDataFrame([(None,)], "x double").agg(*parts_sums(F.col("x"), "s")).select(exact_total("s").alias("s"))
    assert none.first().s is None


def test_sums_of_inverses(spark):
    counts = {1: [7] * 7, 2: [3, 4, 5], 3: [10**9 + i for i in range(50)], 4: [2**41] * 9}
    df = spark.createDataFrame([(g, c) for g, cs in counts.items() for c in cs], "g int, c bigint").repartition(3)
    sums = df.groupBy("g").agg(*inverse_sums(F.col("c"), "s")).select("g", inverse_total("s").alias("s"))
    for r in sums.collect():
        assert r.s == pytest.approx(float(sum(Fraction(1, c) for c in counts[r.g])), rel=1e-11)


def test_sums_of_the_same_terms_tie(spark):
    rows = [(1, 1.0, x) for x in (0.1, 0.2, 0.3)] + [(2, 0.0, x) for x in (0.3, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "id int, label double, x double").coalesce(1)
    sums = df.groupBy("id", "label").agg(*parts_sums(F.col("x"), "s")).select("label", exact_total("s").alias("score"))
    assert auroc(sums).first().auroc == 0.5


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_scores_are_ranked_unrounded(spark, kind):
    """Apart in the 15th digit, or above 10^10; by pair counting, alone and with other scores."""
    rng = np.random.default_rng(6)
    if kind == "double":
        values = [0.123456789012345 + 1e-15 * int(i) for i in rng.integers(0, 30, 60)] + [2e10 + 1e-5, 2e10 + 2e-5]
    else:
        values = [-20_000_000_000 - int(i) for i in rng.integers(0, 30, 60)] + [-(2**60), -(2**60) - 1]
    rows = [(v, float(y), -v, 1.0) for v, y in zip(values, [*rng.integers(0, 2, 60), 1, 0])]
    df = spark.createDataFrame(rows, f"score {kind}, label double, other {kind}, prediction double")
    want = brute.auroc([r[0] for r in rows], [r[1] for r in rows], tie=0.0)
    assert auroc(df).first().auroc == pytest.approx(want, abs=1e-12)
    found = {r.estimator: r.auroc for r in evaluate(df, ("score", "other")).collect()}
    assert found == {"score": pytest.approx(want, abs=1e-12), "other": pytest.approx(1 - want, abs=1e-12), "prediction": 0.5}


def test_ranks_order_all_numbers(spark):
    values = [-1e300, -3.5, -1.25, -1.0, -0.5, -1e-300, 0.0, 1e-300, 0.25, 1.0, 1.5, 2.0**53, 2.0**53 + 2, 1e19, 1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.i for r in df.orderBy(rank(F.col("v"))).collect()] == list(range(len(values)))


def test_unlabelled_rows_take_no_part(spark):
    rows = [(1.0, 0.0, 0.0), (2.0, 1.0, 1.0), (0.0, None, 1.0)]
    df = spark.createDataFrame(rows, "score double, label double, prediction double")
    assert auroc(df).first().auroc == 1.0
    assert confusion(df).first()[:4] == (1, 1, 0, 0)


def test_confusion_without_denominators(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "prediction double, label double")
    row = confusion(df).first()
    assert (row.tn, row.accuracy, row.precision, row.recall, row.f1) == (2, 1.0, None, None, None)


def test_evaluate_ranks_scores_and_prediction(spark):
    rows = [(1.0, 0.0, 0.0), (2.0, 0.0, 1.0), (3.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "score double, prediction double, label double")
    got = {r.estimator: r for r in evaluate(df).collect()}
    assert got["score"].auroc == 1.0
    assert got["prediction"].auroc == 0.75
    assert (got["score"].tp, got["score"].fn, got["score"].precision) == (1, 1, 1.0)


def test_broadcast_limit_reads_sizes(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for text, want in (("-1", 0), ("10MB", 10 << 20), ("1024b", 1024), ("2g", 2 << 30), ("77", 77)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert broadcast_limit(spark) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("widths", [(3.0,), (1.0, 6.0)])
def test_looked_up_sums_are_those_of_joins(points, raw, monkeypatch, widths):
    """Large tables of points meet a bounded table of buckets batch by batch, without a row per hash table."""
    family = FAMILY.at(*widths)
    monkeypatch.setattr(buckets_module, "LOCAL_ROWS", 0)
    counts = B.stage_counts(points, family)
    twice = points.unionByName(points.filter("id < 5"))
    near = R.reach(twice, family, counts, 300)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.w if len(widths) > 1 else widths[0], r.id): r.reach for r in near.collect()}
    for w in widths:
        want = brute.reach(brute.bucket_ids(raw, family, w))
        # Rows of one id are added up.
        want = {k: v if k >= 5 else 2 * v - family.num_tables for k, v in want.items()}
        assert {k: v for (x, k), v in got.items() if x == w} == want
    if len(widths) == 1:
        table = stage(R.reach_estimators(points, family, counts, 300), "estimators")
        fast = sorted(R.reach_scores(points, family, table, 300).collect())
        monkeypatch.setattr(buckets_module, "LOCAL_BYTES", 0)
        assert fast == sorted(R.reach_scores(points, family, table, 300).collect())
