"""Registered queries: each is a Spark job over the given tables and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscore.functions.scalar import hash01, histogram, key_text
from bucketscore.operators import buckets as B
from bucketscore.operators import reach as R
from bucketscore.operators.encoding import category_dictionary, one_hot
from bucketscore.operators.evaluate import auroc, confusion
from bucketscore.operators.lsh import HashFamily, hash_points
from bucketscore.operators.sampling import class_counts, kept_in_training, rebalance, sample, split, with_fold
from bucketscore.operators.scaling import as_array, as_vector, feature_stats, fit_scaling, point_facts
from bucketscore.plans.detectors import (
    BucketCountDetector,
    DualResolutionDetector,
    ReachabilityDetector,
    ReachabilityModel,
    dual_scores,
)
from bucketscore.plans.experiments import (
    GRID_WIDTHS,
    distance_sweep,
    fold_bucket_sizes,
    fold_counts,
    grid_report,
    grid_search,
    grid_summary,
    published_grid,
    run_experiment,
)
from bucketscore.plans.experiments import SWEEP_RADII as RADII
from bucketscore.plans.tuning import CANDIDATES, least_by_length, minimum_neighbors, starting_radius, tune_key_length, tune_radius, tune_w, w_sweep
from bucketscore.sources.points import read_libsvm, with_content_id, with_row_number, write_folds, write_libsvm, write_scored
from bucketscore.streaming.scoring import parquet_sink, score_stream
from bucketscore.staging import Staged, session_folder, stage
from harness import oracle_sql as O
from harness import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}

SEED = 7
ORDERS = HashFamily(dim=5, key_length=4, num_tables=50, widths=(4.0,), seed=SEED)
ORDERS_DUAL = ORDERS.at(2.0, 8.0)
ORDERS_SWEEP = replace(ORDERS, label_width=True).at(*CANDIDATES)
ORDERS_RADII = HashFamily(5, 4, 10, seed=SEED)
ORDERS_GRID = replace(ORDERS, num_tables=10)
EMBEDDINGS = HashFamily(dim=64, key_length=4, num_tables=10, widths=(32.0,), seed=SEED)
EVENTS = HashFamily(dim=3, key_length=4, num_tables=20, widths=(2.0,), seed=SEED)
DOCUMENTS = HashFamily(dim=5, key_length=4, num_tables=20, widths=(4.0,), seed=SEED)


def query(function):
    QUERIES[function.__name__] = function
    return function


def oracle(function):
    name = function.__name__.removesuffix("_sql")
    ORACLES[name] = function
    return function


def r6(column, name: str):
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def cells(dim: int, digits: int = 6):
    return [r6(F.get("features", F.lit(i)), f"f{i}") for i in range(dim)]


def cells_sql(dim: int) -> str:
    return ", ".join(f"{O.rounded(f'x[{i + 1}]')} AS f{i}" for i in range(dim))


def staged_points(raw: DataFrame) -> Staged:
    """Points written once; the scaling is an expression on top of the table."""
    table = stage(raw, "points")
    return replace(table, df=V.scaled(table.df))


def staged_orders(spark, folder, cutoff=10) -> Staged:
    return staged_points(V.orders(spark, folder, cutoff))


def order_points(spark, folder, cutoff=10) -> DataFrame:
    return staged_orders(spark, folder, cutoff).df


def order_buckets(spark, folder, family=ORDERS, cutoff=10):
    """Scaled orders and their bucket counts."""
    table = staged_orders(spark, folder, cutoff)
    return table, B.stage_counts(table.df, family)


def train_test(spark, folder, cutoff=10):
    """Orders scaled by their training part, as (training rows, test rows)."""
    raw = stage(V.orders(spark, folder, cutoff), "orders").df
    table = V.scaled(raw, split(raw, 0.8, "id", SEED)[0])
    return split(table, 0.8, "id", SEED)


TRAIN = f"{O.hash01('id', SEED, 'split')} < 0.8e0"
ORDER_PTS = O.points("orders")
SPLIT_PTS = O.points("orders", fit_where=TRAIN) + f""",
train AS (SELECT * FROM pts WHERE {TRAIN}),
test AS (SELECT * FROM pts WHERE NOT ({TRAIN}))"""


def split_hashed(family: HashFamily) -> str:
    """CTEs: points, planes, training hashes ``h`` and test hashes ``g``."""
    return f"""{SPLIT_PTS}, {O.planes(family)},
{O.hashed(family, 'train')}, {O.hashed(family, 'test', name='g')}"""


# --- scaling, encoding, row selection -----------------------------------------------------------


@query
def standardize_stats(spark, folder):
    stats = feature_stats(V.orders(spark, folder))
    return stats.select("pos", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@oracle
def standardize_stats_sql():
    rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, {O.rounded(f'avg(f{i})')} AS mean, {O.rounded(f'stddev_samp(f{i})')} AS std FROM orders_raw"
        for i in range(5)
    )
    return f"WITH {O.raw('orders')} {rows}"


@query
def standardize_orders(spark, folder):
    return order_points(spark, folder).select("id", *cells(5))


@oracle
def standardize_orders_sql():
    return f"WITH {ORDER_PTS} SELECT id, {cells_sql(5)} FROM pts"


@query
def one_hot_customers(spark, folder):
    encoded = one_hot(V.customers(spark, folder), V.customer_dictionary(spark, folder), form="array")
    return encoded.select("id", F.concat_ws(",", F.transform("features", lambda x: F.round(x, 2).cast("string"))).alias("encoded"))


@query
def one_hot_slots(spark, folder):
    encoded = one_hot(V.customers(spark, folder), V.customer_dictionary(spark, folder))
    slots = encoded.select("id", F.inline(F.arrays_zip(F.col("features.indices").alias("slot"), F.col("features.values").alias("x"))))
    return slots.groupBy("slot").agg(F.count_if(F.col("x") != 0).alias("set_rows"), r6(F.sum("x"), "total"))


CUSTOMERS_SQL = """names AS (SELECT list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer),
nations AS (SELECT list_sort(list(DISTINCT c_nationkey)) AS keys FROM customer),
cust AS (SELECT c_custkey AS id, list_position(segments, c_mktsegment) - 1 AS seg, list_position(keys, c_nationkey) - 1 AS nat,
                c_acctbal AS bal, len(segments) AS ns, len(keys) AS nn FROM customer, names, nations)"""


@oracle
def one_hot_slots_sql():
    return f"""WITH {CUSTOMERS_SQL},
slots AS (SELECT id, list_transform(range(ns + nn), lambda i: CASE WHEN i = seg OR i = ns + nat THEN 1.0e0 ELSE 0.0e0 END) || [bal] AS f FROM cust),
cells AS (SELECT unnest(range(len(f))) AS slot, unnest(f) AS x FROM slots)
SELECT slot::INTEGER AS slot, count(*) FILTER (x <> 0) AS set_rows, {O.rounded('sum(x)')} AS total FROM cells GROUP BY slot"""


@oracle
def one_hot_customers_sql():
    return f"""WITH {CUSTOMERS_SQL}
SELECT id, array_to_string(list_transform(range(ns + nn), lambda i: CASE WHEN i = seg OR i = ns + nat THEN '1.0' ELSE '0.0' END)
       || [round(bal, 2)::VARCHAR], ',') AS encoded FROM cust"""


@query
def category_dictionary_customers(spark, folder):
    table = category_dictionary(V.customers(spark, folder), 2)
    return table.select("pos", F.concat_ws(",", F.transform("cats", lambda c: c.cast("string"))).alias("cats"))


@oracle
def category_dictionary_customers_sql():
    return f"""WITH {CUSTOMERS_SQL}, flat AS (
SELECT 0 AS pos, seg::INTEGER AS c FROM cust UNION SELECT 1, c_nationkey::INTEGER FROM customer)
SELECT pos, string_agg(c::VARCHAR, ',' ORDER BY c) AS cats FROM flat GROUP BY pos"""


@query
def vector_features(spark, folder):
    """Arrays to Spark ML vectors and back."""
    return as_array(as_vector(V.events(spark, folder))).select("id", *cells(3))


@oracle
def vector_features_sql():
    return f"WITH {O.raw('events')} SELECT id, {', '.join(f'{O.rounded(f"f{i}")} AS f{i}' for i in range(3))} FROM events_raw"


@query
def class_counts_views(spark, folder):
    parts = []
    for name, view in (("orders", V.orders), ("events", V.events), ("documents", V.documents), ("embeddings", V.embeddings)):
        rows = view(spark, folder).select("label")
        parts.append(rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1.0).alias("anomalies")).select(F.lit(name).alias("view"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@oracle
def class_counts_views_sql():
    names = ("orders", "events", "documents", "embeddings")
    ctes = ", ".join(O.raw(n) for n in names)
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT '{n}' AS view, count(*) AS rows, count(*) FILTER (label = 1) AS anomalies FROM {n}_raw" for n in names
    )


@query
def points_profile(spark, folder):
    facts = point_facts()
    return V.embeddings(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"),
        facts["shortest"].cast("bigint").alias("min_size"),
        facts["longest"].cast("bigint").alias("max_size"),
        facts["missing"].alias("bad_rows"),
    )


@oracle
def points_profile_sql():
    return """SELECT count(*) AS rows, min(len(embedding))::BIGINT AS min_size, max(len(embedding))::BIGINT AS max_size,
count(*) FILTER (len(list_filter(embedding, lambda e: e IS NULL OR isnan(e))) > 0) AS bad_rows FROM embeddings"""


@query
def rebalance_orders(spark, folder):
    return rebalance(V.orders(spark, folder, 9), seed=SEED).select("id", "label")


@oracle
def rebalance_orders_sql():
    return f"""WITH {O.raw('orders', 9)}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS a FROM orders_raw)
SELECT id, label FROM orders_raw, c
WHERE coalesce(label, 0) <> 1 OR a::DOUBLE / n <= 0.02e0 OR {O.hash01('id', SEED, 'rebalance')} < 0.01e0 * n / a"""


@query
def rebalance_documents(spark, folder):
    return rebalance(V.documents(spark, folder), seed=SEED).select("id", "label")


@oracle
def rebalance_documents_sql():
    return f"""WITH {O.raw('documents')}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS a FROM documents_raw)
SELECT id, label FROM documents_raw, c
WHERE coalesce(label, 0) <> 1 OR a::DOUBLE / n <= 0.02e0 OR {O.hash01('id', SEED, 'rebalance')} < 0.01e0 * n / a"""


@query
def sample_orders(spark, folder):
    return sample(V.orders(spark, folder), 0.05, seed=SEED).select("id")


@oracle
def sample_orders_sql():
    return f"WITH {O.raw('orders')} SELECT id FROM orders_raw WHERE {O.hash01('id', SEED, 'sample')} < 0.05e0"


@query
def split_orders(spark, folder):
    train, test = split(V.orders(spark, folder), seed=SEED)
    return train.select("id", F.lit("train").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))


@oracle
def split_orders_sql():
    return f"WITH {O.raw('orders')} SELECT id, CASE WHEN {TRAIN} THEN 'train' ELSE 'test' END AS part FROM orders_raw"


@query
def kfold_counts(spark, folder):
    return with_fold(V.orders(spark, folder), seed=SEED).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("rows"))


@oracle
def kfold_counts_sql():
    return f"""WITH {O.raw('orders')} SELECT floor({O.hash01('id', SEED, 'fold')} * 5)::INTEGER AS fold, label, count(*) AS rows
FROM orders_raw GROUP BY 1, 2"""


@query
def row_numbers(spark, folder):
    numbered = with_row_number(V.table(spark, folder, "lineitem").select("l_orderkey", "l_quantity"), "id")
    return numbered.agg(
        F.count(F.lit(1)).alias("rows"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.sum("id").alias("id_total"), F.count_distinct("id").alias("ids"), r6(F.sum("l_quantity"), "quantity"),
    )


@oracle
def row_numbers_sql():
    return f"""SELECT count(*) AS rows, min(i)::BIGINT AS low, max(i)::BIGINT AS high, sum(i)::BIGINT AS id_total,
count(DISTINCT i) AS ids, {O.rounded('sum(l_quantity)')} AS quantity
FROM (SELECT row_number() OVER () - 1 AS i, l_quantity FROM lineitem)"""


LINE_CELLS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query
def content_ids(spark, folder):
    keys = with_content_id(V.table(spark, folder, "lineitem").select(*LINE_CELLS))
    return keys.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


@oracle
def content_ids_sql():
    cells = ", ".join(f"coalesce('=' || {c}::VARCHAR, '')" for c in LINE_CELLS)
    return f"""SELECT md5(concat_ws(chr(1), {cells})) AS id, count(*) AS rows FROM lineitem GROUP BY 1"""


# --- hashing ------------------------------------------------------------------------------------


@query
def hash_orders(spark, folder):
    hashed = hash_points(order_points(spark, folder), ORDERS)
    return hashed.select("id", "t", key_text(ORDERS.codes).alias("key"))


@oracle
def hash_orders_sql():
    return f"WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)} SELECT id, t, {O.key_text(ORDERS)} AS key FROM h"


@query
def hash_orders_native(spark, folder):
    """The form without Python workers."""
    family = replace(ORDERS, num_tables=5)
    hashed = hash_points(order_points(spark, folder), family, native=True)
    return hashed.select("id", "t", key_text(family.codes).alias("key"))


@oracle
def hash_orders_native_sql():
    family = replace(ORDERS, num_tables=5)
    return f"WITH {ORDER_PTS}, {O.planes(family)}, {O.hashed(family)} SELECT id, t, {O.key_text(family)} AS key FROM h"


@query
def hash_embeddings(spark, folder):
    hashed = hash_points(V.scaled(V.embeddings(spark, folder)), EMBEDDINGS)
    return hashed.select("id", "t", key_text(EMBEDDINGS.codes).alias("key"))


@oracle
def hash_embeddings_sql():
    return f"""WITH {O.points('embeddings')}, {O.planes(EMBEDDINGS)}, {O.hashed(EMBEDDINGS)}
SELECT id, t, {O.key_text(EMBEDDINGS)} AS key FROM h"""


@query
def hash_orders_radius(spark, folder):
    family = replace(ORDERS, num_tables=10, radius=2.5)
    return hash_points(order_points(spark, folder), family).select("id", "t", key_text(family.codes).alias("key"))


@oracle
def hash_orders_radius_sql():
    family = replace(ORDERS, num_tables=10, radius=2.5)
    return f"WITH {ORDER_PTS}, {O.planes(family)}, {O.hashed(family)} SELECT id, t, {O.key_text(family)} AS key FROM h"


@query
def hash_neighbors(spark, folder):
    family = replace(ORDERS, num_tables=10)
    table, counts = order_buckets(spark, folder, family)
    members = B.bucket_members(table.df, family, counts, table.rows)
    return members.select("t", key_text(family.codes).alias("key"), "n", "id")


@oracle
def hash_neighbors_sql():
    family = replace(ORDERS, num_tables=10)
    return f"""WITH {ORDER_PTS}, {O.planes(family)}, {O.hashed(family)}, {O.counts(family)}
SELECT t, {O.key_text(family)} AS key, n, id FROM h JOIN b USING ({O.keys(family)}) WHERE n > 1"""


# --- bucket tables ------------------------------------------------------------------------------


@query
def bucket_counts(spark, folder):
    counts = B.bucket_counts(order_points(spark, folder), ORDERS)
    return counts.select("t", key_text(ORDERS.codes).alias("key"), "n")


@oracle
def bucket_counts_sql():
    return f"""WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.counts(ORDERS)}
SELECT t, {O.key_text(ORDERS)} AS key, n FROM b"""


@query
def bucket_stats(spark, folder):
    table, counts = order_buckets(spark, folder)
    stats = B.bucket_stats(counts.df, table.rows)
    names = ("mean_size", "relative_size", "std_size", "relative_std")
    return stats.select("buckets", "multi_buckets", *[r6(F.col(c), c) for c in names])


STATS_SQL = f"""count(*) AS buckets, count(*) FILTER (n > 1) AS multi_buckets,
{O.rounded('avg(n) FILTER (n > 1)')} AS mean_size, {O.rounded('coalesce(avg(n) FILTER (n > 1) / total, 0)')} AS relative_size,
{O.rounded('stddev_pop(n) FILTER (n > 1)')} AS std_size, {O.rounded('stddev_pop(n) FILTER (n > 1) / total')} AS relative_std"""


@oracle
def bucket_stats_sql():
    return f"""WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.counts(ORDERS)}
SELECT {STATS_SQL} FROM b, (SELECT count(*) AS total FROM pts) GROUP BY total"""


@query
def bucket_size_histogram(spark, folder):
    _, counts = order_buckets(spark, folder)
    return B.bucket_size_histogram(counts.df).select("bin", "rows")


@oracle
def bucket_size_histogram_sql():
    return f"""WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.counts(ORDERS)} {O.bins('b', 'n', 20)}"""


def _histogram_around(spark, folder, anomaly: bool):
    table, counts = order_buckets(spark, folder)
    wanted = F.col("label") == 1.0
    chosen = B.first_of_class(table.df, wanted if anomaly else ~wanted)
    around = B.buckets_of_point(table.df, ORDERS, counts.df, F.col("id") == chosen)
    return B.bucket_size_histogram(around).select("bin", "rows")


def _histogram_around_sql(sign: str):
    return f"""WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.counts(ORDERS)},
own AS (SELECT b.* FROM b JOIN h USING ({O.keys(ORDERS)}) WHERE h.id = (SELECT min(id) FROM pts WHERE label {sign} 1))
{O.bins('own', 'n', 20)}"""


@query
def bucket_histogram_for_anomaly(spark, folder):
    return _histogram_around(spark, folder, True)


@oracle
def bucket_histogram_for_anomaly_sql():
    return _histogram_around_sql("=")


@query
def bucket_histogram_for_normal(spark, folder):
    return _histogram_around(spark, folder, False)


@oracle
def bucket_histogram_for_normal_sql():
    return _histogram_around_sql("<>")


DISTANCE_FAMILY = replace(ORDERS, num_tables=10)


def _distances(spark, folder):
    table = staged_orders(spark, folder)
    return B.bucket_distances(table.df, DISTANCE_FAMILY, table.rows)


def distances_sql(family: HashFamily) -> str:
    return f"""WITH {ORDER_PTS}, {O.planes(family)}, {O.hashed(family)},
heads AS (SELECT {O.keys(family)}, min(id) AS head FROM h GROUP BY {O.keys(family)} HAVING count(*) > 1),
d AS (SELECT {O.keys(family)}, count(*) AS n, avg(list_distance(p.x, q.x)) AS mean_distance
      FROM h JOIN heads USING ({O.keys(family)}) JOIN pts p ON p.id = h.id JOIN pts q ON q.id = head
      GROUP BY {O.keys(family)})"""


@query
def bucket_distance(spark, folder):
    found = _distances(spark, folder)
    return found.select("t", key_text(DISTANCE_FAMILY.codes).alias("key"), "n", r6(F.col("mean_distance"), "mean_distance"))


@oracle
def bucket_distance_sql():
    return f"""{distances_sql(DISTANCE_FAMILY)}
SELECT t, {O.key_text(DISTANCE_FAMILY)} AS key, n, {O.rounded('mean_distance')} AS mean_distance FROM d"""


@query
def bucket_distance_histogram(spark, folder):
    found = stage(_distances(spark, folder), "distances").df
    return histogram(found, "mean_distance", 100).select("bin", "rows")


@oracle
def bucket_distance_histogram_sql():
    return f"{distances_sql(DISTANCE_FAMILY)} {O.bins('d', 'mean_distance', 100)}"


@query
def mean_bucket_distance(spark, folder):
    found = _distances(spark, folder)
    return found.agg(r6(F.avg("mean_distance"), "mean_distance"), F.count(F.lit(1)).alias("multi_buckets"))


@oracle
def mean_bucket_distance_sql():
    return f"""{distances_sql(DISTANCE_FAMILY)}
SELECT {O.rounded('avg(mean_distance)')} AS mean_distance, count(*) AS multi_buckets FROM d"""


@query
def distance_sweep_radius(spark, folder):
    table = staged_orders(spark, folder)
    found = distance_sweep(table.df, ORDERS_RADII, table.rows, RADII, 2.0)
    return found.select("radius", r6(F.col("mean_distance"), "mean_distance"), "multi_buckets")


@oracle
def distance_sweep_radius_sql():
    family = replace(ORDERS_RADII, label_width=True).at(*[r * 2.0 for r in RADII])
    return f"""{distances_sql(family)}
SELECT w / 2.0e0 AS radius, {O.rounded('avg(mean_distance)')} AS mean_distance, count(*) AS multi_buckets FROM d GROUP BY w"""


# --- neighbours, reach, estimators, scores ------------------------------------------------------


@query
def neighbor_counts(spark, folder):
    table, counts = order_buckets(spark, folder)
    return B.neighbor_counts(table.df, ORDERS, counts, table.rows)


NEAR_SQL = f"""{ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.counts(ORDERS)},
near AS (SELECT id, sum(n - 1)::BIGINT AS neighbors FROM h JOIN b USING ({O.keys(ORDERS)}) GROUP BY id)"""


@oracle
def neighbor_counts_sql():
    return f"WITH {NEAR_SQL} SELECT id, neighbors FROM near"


@query
def min_neighbors(spark, folder):
    table, counts = order_buckets(spark, folder)
    return B.neighbor_counts(table.df, ORDERS, counts, table.rows).agg(F.min("neighbors").alias("min_neighbors"))


@oracle
def min_neighbors_sql():
    return f"WITH {NEAR_SQL} SELECT min(neighbors) AS min_neighbors FROM near"


@query
def neighbor_threshold(spark, folder):
    table, counts = order_buckets(spark, folder)
    near = B.neighbor_counts(table.df, ORDERS, counts, table.rows)
    return R.neighbor_threshold(near, class_counts(table.df).anomalies)


@oracle
def neighbor_threshold_sql():
    return f"""WITH {NEAR_SQL} SELECT max(neighbors) AS threshold FROM (SELECT neighbors FROM near ORDER BY neighbors
LIMIT (SELECT count(*) FROM pts WHERE label = 1))"""


@query
def reach(spark, folder):
    table, counts = order_buckets(spark, folder)
    return R.reach(table.df, ORDERS, counts, table.rows)


@oracle
def reach_sql():
    return f"WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.reach_tables(ORDERS)} SELECT id, reach FROM r"


ES = ("e1", "e2", "e3", "e4")
ROUNDED_ES = ", ".join(f"{O.rounded(e)} AS {e}" for e in ES)


def _estimators(points: DataFrame, rows: int, family: HashFamily):
    counts = B.stage_counts(points, family)
    return R.reach_estimators(points, family, counts, rows)


@query
def reach_estimators(spark, folder):
    table = staged_orders(spark, folder)
    found = _estimators(table.df, table.rows, ORDERS)
    return found.select("t", key_text(ORDERS.codes).alias("key"), "n", *[r6(F.col(e), e) for e in ES])


@oracle
def reach_estimators_sql():
    return f"""WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.hashed(ORDERS)}, {O.reach_tables(ORDERS)}
SELECT t, {O.key_text(ORDERS)} AS key, n, {ROUNDED_ES} FROM e"""


@query
def reach_estimators_embeddings(spark, folder):
    table = staged_points(V.embeddings(spark, folder))
    found = _estimators(table.df, table.rows, EMBEDDINGS)
    return found.select("t", key_text(EMBEDDINGS.codes).alias("key"), "n", *[r6(F.col(e), e) for e in ES])


@oracle
def reach_estimators_embeddings_sql():
    return f"""WITH {O.points('embeddings')}, {O.planes(EMBEDDINGS)}, {O.hashed(EMBEDDINGS)}, {O.reach_tables(EMBEDDINGS)}
SELECT t, {O.key_text(EMBEDDINGS)} AS key, n, {ROUNDED_ES} FROM e"""


def _base(spark, folder, cutoff=10):
    train, test = train_test(spark, folder, cutoff)
    detector = BucketCountDetector(keyLength=4, numTables=50, splitW=4.0, seed=SEED)
    return detector.fit(train), test


BASE_SQL = f"""{split_hashed(ORDERS)}, {O.counts(ORDERS)},
near AS (SELECT id, sum(n - 1)::BIGINT AS neighbors FROM h JOIN b USING ({O.keys(ORDERS)}) GROUP BY id),
th AS (SELECT max(neighbors) AS threshold FROM (SELECT neighbors FROM near ORDER BY neighbors
       LIMIT (SELECT count(*) FROM train WHERE label = 1))),
scored AS (SELECT id, label, -s AS score, CASE WHEN s <= threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction
  FROM (SELECT id, sum(coalesce(n, 0))::BIGINT AS s FROM g LEFT JOIN b USING ({O.keys(ORDERS)}) GROUP BY id)
  JOIN test USING (id), th)"""


@query
def base_scores(spark, folder):
    model, test = _base(spark, folder)
    return model.transform(test).select("id", "score")


@oracle
def base_scores_sql():
    return f"WITH {BASE_SQL} SELECT id, score FROM scored"


@query
def base_predictions(spark, folder):
    model, test = _base(spark, folder)
    return model.transform(test).select("id", "label", "prediction")


@oracle
def base_predictions_sql():
    return f"WITH {BASE_SQL} SELECT id, label, prediction FROM scored"


@query
def base_training_predictions(spark, folder):
    """Training rows, each left out of its own buckets."""
    train, _ = train_test(spark, folder)
    detector = BucketCountDetector(keyLength=4, numTables=50, splitW=4.0, seed=SEED, excludeSelf=True)
    return detector.fit(train).transform(train).select("id", "prediction")


@oracle
def base_training_predictions_sql():
    return f"""WITH {BASE_SQL} SELECT id, CASE WHEN neighbors <= threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM near, th"""


SCORES = ("score1", "score2", "score3", "score4")
SCORE_SUMS = ", ".join(f"{O.exact_sum(f'-coalesce({e}, 0)')} AS {s}" for e, s in zip(ES, SCORES))
REACH_SQL = f"""{split_hashed(ORDERS)}, {O.reach_tables(ORDERS)},
scored AS (SELECT id, any_value(label) AS label, {SCORE_SUMS}
  FROM g LEFT JOIN e USING ({O.keys(ORDERS)}) JOIN test USING (id) GROUP BY id)"""


def _reach(spark, folder, **values):
    train, test = train_test(spark, folder)
    detector = ReachabilityDetector(keyLength=4, numTables=50, splitW=4.0, seed=SEED, **values)
    return detector.fit(train), test


@query
def reach_scores(spark, folder):
    model, test = _reach(spark, folder)
    return model.transform(test).select("id", *[r6(F.col(s), s) for s in SCORES])


@oracle
def reach_scores_sql():
    return f"WITH {REACH_SQL} SELECT id, {', '.join(f'{O.rounded(s)} AS {s}' for s in SCORES)} FROM scored"


@query
def reach_predictions(spark, folder):
    model, test = _reach(spark, folder)
    return model.transform(test).select("id", "prediction")


@oracle
def reach_predictions_sql():
    return f"""WITH {REACH_SQL}, th AS (SELECT max(reach) - {ORDERS.num_tables} AS threshold FROM (SELECT reach FROM r ORDER BY reach
LIMIT (SELECT count(*) FROM train WHERE label = 1)))
SELECT id, CASE WHEN score1 >= -threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM scored, th"""


def _reach_predictions(name: str):
    """Predictions by a score whose threshold comes from training rows left out of their own buckets."""

    def run(spark, folder):
        model, test = _reach(spark, folder, predictionScore=name)
        return model.transform(test).select("id", "prediction")

    def sql():
        value = {
            "score2": "CASE WHEN n > 1 THEN (e2 * n - reach) / (n - 1) ELSE 0.0e0 END",
            "score3": "CASE WHEN n > 1 THEN (n - 1)::DOUBLE * (n - 1) / (e2 * n - reach) ELSE 0.0e0 END",
            "score4": "CASE WHEN n > 1 THEN greatest(e4 - 1.0e0 / reach, 0.0e0) ELSE 0.0e0 END",
        }[name]
        return f"""WITH {REACH_SQL},
alone AS (SELECT id, {O.exact_sum(f'-({value})')} AS s FROM h JOIN e USING ({O.keys(ORDERS)}) JOIN r USING (id) GROUP BY id),
th AS (SELECT min(s) AS threshold FROM (SELECT s FROM alone ORDER BY s DESC LIMIT (SELECT count(*) FROM train WHERE label = 1)))
SELECT id, CASE WHEN {name} >= threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM scored, th"""

    QUERIES[f"reach_predictions_{name}"], ORACLES[f"reach_predictions_{name}"] = run, sql


for _name in SCORES[1:]:
    _reach_predictions(_name)


@query
def multiplied_tables_scores(spark, folder):
    """Ten tables, and a final family with five times as many."""
    train, test = train_test(spark, folder)
    detector = BucketCountDetector(keyLength=4, numTables=10, numTablesMultiplier=5, splitW=4.0, seed=SEED)
    return detector.fit(train).transform(test).select("id", "score")


@oracle
def multiplied_tables_scores_sql():
    return base_scores_sql()


@query
def partitioned_fit_scores(spark, folder):
    """Training rows dealt by their id into a given number of partitions."""
    train, test = train_test(spark, folder)
    detector = BucketCountDetector(keyLength=4, numTables=50, splitW=4.0, seed=SEED, numPartitions=24)
    return detector.fit(train).transform(test).select("id", "score")


@oracle
def partitioned_fit_scores_sql():
    return base_scores_sql()


@query
def tuned_dual_widths(spark, folder):
    """Both widths from the wanted sizes: the small one for a twentieth of the usual share."""
    train, _ = train_test(spark, folder)
    model = DualResolutionDetector(keyLength=4, numTables=20, smallBucketSize=5, largeBucketSize=100, seed=SEED).fit(train)
    return spark.createDataFrame([tuple(round(w, 9) for w in model.family.widths)], "w_small double, w_large double")


TUNED_DUAL = replace(ORDERS, num_tables=20)


@oracle
def tuned_dual_widths_sql():
    small = O.tuned(TUNED_DUAL, 8, "train", "0.05e0 * (5 / 100.0e0)", "0.1e0 * (5 / 100.0e0)")
    return f"""WITH {SPLIT_PTS}, {O.planes(TUNED_DUAL)}
SELECT (WITH {small}) AS w_small, (WITH {O.tuned(TUNED_DUAL, 8, 'train')}) AS w_large"""


@query
def tuned_bucket_size(spark, folder):
    """A width for a wanted mean bucket size in rows, and the size that the model has."""
    train, _ = train_test(spark, folder)
    model = BucketCountDetector(keyLength=4, numTables=20, minBucketSize=300, tuneFraction=1.0, seed=SEED).fit(train)
    size = model.summary().select((F.col("mean_size") >= 300) & (F.col("mean_size") <= 600)).first()[0]
    return spark.createDataFrame([(round(model.family.widths[0], 9), size)], "w double, in_range boolean")


@oracle
def tuned_bucket_size_sql():
    total = "(SELECT count(*) FROM train)"
    return f"""WITH {SPLIT_PTS}, {O.planes(TUNED_DUAL)}
SELECT (WITH {O.tuned(TUNED_DUAL, 8, 'train', f'300.0e0 / {total}', f'600.0e0 / {total}')}) AS w, true AS in_range"""


@query
def dual_scores_orders(spark, folder):
    table, counts = order_buckets(spark, folder, ORDERS_DUAL)
    scored = dual_scores(table.df, ORDERS_DUAL, counts, table.rows)
    return scored.select("id", "score_small", "score_large", r6(F.col("density_ratio"), "density_ratio"), r6(F.col("score"), "score"))


@oracle
def dual_scores_orders_sql():
    small, large = (O.number(w) for w in ORDERS_DUAL.widths)
    return f"""WITH {ORDER_PTS}, {O.planes(ORDERS_DUAL)}, {O.hashed(ORDERS_DUAL)}, {O.counts(ORDERS_DUAL)},
s AS (SELECT id, sum(n) FILTER (w = {small})::BIGINT AS small, sum(n) FILTER (w = {large})::BIGINT AS large
      FROM h JOIN b USING ({O.keys(ORDERS_DUAL)}) GROUP BY id)
SELECT id, -small AS score_small, -large AS score_large, {O.rounded('small::DOUBLE / large')} AS density_ratio,
       {O.rounded('-(small::DOUBLE / large)')} AS score FROM s"""


@query
def dual_predictions(spark, folder):
    train, test = train_test(spark, folder)
    detector = DualResolutionDetector(keyLength=4, numTables=50, splitWSmall=2.0, splitWLarge=8.0, seed=SEED)
    scored = detector.fit(train).transform(test)
    return scored.select("id", "score_small", "score_large", r6(F.col("density_ratio"), "density_ratio"), "prediction")


@oracle
def dual_predictions_sql():
    small, large = (O.number(w) for w in ORDERS_DUAL.widths)
    return f"""WITH {split_hashed(ORDERS_DUAL)}, {O.counts(ORDERS_DUAL)},
near AS (SELECT id, sum(n - 1) AS neighbors FROM h JOIN b USING ({O.keys(ORDERS_DUAL)}) WHERE w = {small} GROUP BY id),
th AS (SELECT max(neighbors) AS threshold FROM (SELECT neighbors FROM near ORDER BY neighbors LIMIT (SELECT count(*) FROM train WHERE label = 1))),
s AS (SELECT id, sum(CASE WHEN w = {small} THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS small,
             sum(CASE WHEN w = {large} THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS large
      FROM g LEFT JOIN b USING ({O.keys(ORDERS_DUAL)}) GROUP BY id)
SELECT id, -small AS score_small, -large AS score_large, {O.rounded('small::DOUBLE / nullif(large, 0)')} AS density_ratio,
       CASE WHEN small <= threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM s, th"""


@query
def top_anomalies(spark, folder):
    table, counts = order_buckets(spark, folder)
    scored = R.count_scores(table.df, ORDERS, counts, table.rows)
    return scored.orderBy(F.desc("score"), "id").limit(25)


@oracle
def top_anomalies_sql():
    return f"""WITH {NEAR_SQL} SELECT id, -(neighbors + {ORDERS.num_tables})::BIGINT AS score FROM near ORDER BY score DESC, id LIMIT 25"""


def _view_scores(spark, folder, view, family):
    table = staged_points(view(spark, folder))
    counts = B.stage_counts(table.df, family)
    found = stage(R.reach_estimators(table.df, family, counts, table.rows), "estimators")
    return R.reach_scores(table.df, family, found, table.rows).select("id", *[r6(F.col(s), s) for s in SCORES])


def _view_scores_sql(view, family):
    return f"""WITH {O.points(view)}, {O.planes(family)}, {O.hashed(family)}, {O.reach_tables(family)}
SELECT id, {', '.join(f'{O.rounded(f"-sum({e})")} AS {s}' for e, s in zip(ES, SCORES))}
FROM h JOIN e USING ({O.keys(family)}) GROUP BY id"""


@query
def event_scores(spark, folder):
    return _view_scores(spark, folder, V.events, EVENTS)


@oracle
def event_scores_sql():
    return _view_scores_sql("events", EVENTS)


@query
def document_scores(spark, folder):
    return _view_scores(spark, folder, V.documents, DOCUMENTS)


@oracle
def document_scores_sql():
    return _view_scores_sql("documents", DOCUMENTS)


# --- evaluation ---------------------------------------------------------------------------------

MEASURES = ("accuracy", "precision", "recall", "f1")


@query
def confusion_metrics(spark, folder):
    model, test = _base(spark, folder)
    found = confusion(model.transform(test))
    return found.select("tp", "tn", "fp", "fn", *[r6(F.col(m), m) for m in MEASURES])


@oracle
def confusion_metrics_sql():
    return f"""WITH {BASE_SQL}, c AS (SELECT count(*) FILTER (prediction = 1 AND label = 1) AS tp,
count(*) FILTER (prediction = 0 AND label = 0) AS tn, count(*) FILTER (prediction = 1 AND label = 0) AS fp,
count(*) FILTER (prediction = 0 AND label = 1) AS fn FROM scored)
SELECT *, {O.rounded('(tp + tn)::DOUBLE / (tp + tn + fp + fn)')} AS accuracy,
{O.rounded('tp::DOUBLE / nullif(tp + fp, 0)')} AS precision, {O.rounded('tp::DOUBLE / nullif(tp + fn, 0)')} AS recall,
{O.rounded('CASE WHEN tp > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) END')} AS f1 FROM c"""


@query
def auroc_scores(spark, folder):
    model, test = _reach(spark, folder)
    scored = stage(model.transform(test), "scored").df
    pairs = F.array(*[F.struct(F.lit(s).alias("estimator"), F.col(s).alias("value")) for s in SCORES])
    long = scored.select("label", F.inline(pairs))
    return auroc(long, "value", by=["estimator"]).select("estimator", r6(F.col("auroc"), "auroc"), "positives", "negatives")


@oracle
def auroc_scores_sql():
    long = " UNION ALL ".join(f"SELECT '{s}' AS estimator, label, {s} AS value FROM scored" for s in SCORES)
    return f"""WITH {REACH_SQL}, long AS ({long}), a AS ({O.auroc('long', 'value', 'estimator')})
SELECT estimator, {O.rounded('area')} AS auroc, positives, negatives FROM a"""


@query
def auroc_predictions(spark, folder):
    model, test = _base(spark, folder)
    scored = stage(model.transform(test), "scored").df
    return auroc(scored, "prediction").select(r6(F.col("auroc"), "auroc"), "positives", "negatives")


@oracle
def auroc_predictions_sql():
    return f"""WITH {BASE_SQL}, a AS ({O.auroc('scored', 'prediction')})
SELECT {O.rounded('area')} AS auroc, positives, negatives FROM a"""


@query
def auroc_embeddings(spark, folder):
    """Held-out AUROC by brute pair counting in the oracle."""
    table = staged_points(V.embeddings(spark, folder))
    counts = B.stage_counts(table.df, EMBEDDINGS)
    scored = R.count_scores(table.df, EMBEDDINGS, counts, table.rows, carry=["label"])
    return auroc(scored).select(r6(F.col("auroc"), "auroc"), "positives", "negatives")


@oracle
def auroc_embeddings_sql():
    return f"""WITH {O.points('embeddings')}, {O.planes(EMBEDDINGS)}, {O.hashed(EMBEDDINGS)}, {O.counts(EMBEDDINGS)},
s AS (SELECT id, -sum(n) AS score FROM h JOIN b USING ({O.keys(EMBEDDINGS)}) GROUP BY id),
l AS (SELECT score, label FROM s JOIN pts USING (id))
SELECT {O.rounded('avg(CASE WHEN p.score > q.score THEN 1.0e0 WHEN p.score = q.score THEN 0.5e0 ELSE 0.0e0 END)')} AS auroc,
       (SELECT count(*) FROM l WHERE label = 1) AS positives, (SELECT count(*) FROM l WHERE label <> 1) AS negatives
FROM l p, l q WHERE p.label = 1 AND q.label <> 1"""


# --- tuning and experiments ---------------------------------------------------------------------


@query
def w_sweep_orders(spark, folder):
    table = staged_orders(spark, folder)
    found = w_sweep(table.df, ORDERS_SWEEP, CANDIDATES, table.rows)
    return found.select("w", "buckets", "multi_buckets", r6(F.col("mean_size"), "mean_size"), r6(F.col("relative_size"), "relative_size"))


SWEEP_SQL = f"""{ORDER_PTS}, {O.planes(ORDERS_SWEEP)}, {O.hashed(ORDERS_SWEEP)}, {O.counts(ORDERS_SWEEP)},
sweep AS (SELECT w, count(*) AS buckets, count(*) FILTER (n > 1) AS multi_buckets, avg(n) FILTER (n > 1) AS mean_size,
                 coalesce(avg(n) FILTER (n > 1) / any_value(total), 0) AS relative_size
          FROM b, (SELECT count(*) AS total FROM pts) GROUP BY w)"""


@oracle
def w_sweep_orders_sql():
    return f"""WITH {SWEEP_SQL} SELECT w, buckets, multi_buckets, {O.rounded('mean_size')} AS mean_size,
{O.rounded('relative_size')} AS relative_size FROM sweep"""


@query
def tuned_w(spark, folder):
    chosen = tune_w(order_points(spark, folder), ORDERS)
    return spark.createDataFrame([(round(chosen, 9),)], "w double")


@oracle
def tuned_w_sql():
    return f"WITH {ORDER_PTS}, {O.planes(ORDERS)}, {O.tuned(ORDERS, 8)}"


CLUSTERS = HashFamily(dim=2, key_length=4, num_tables=50, seed=SEED)


@query
def tuned_w_clusters(spark, folder):
    """Customers in one tight cluster for each market segment: far apart, and a billionth of the balance wide."""
    points = V.customers(spark, folder)
    features = F.array(F.get("features", F.lit(0)), F.get("features", F.lit(2)) * 1e-9)
    chosen = tune_w(stage(points.withColumn("features", features), "clusters").df, CLUSTERS)
    return spark.createDataFrame([(round(chosen, 9),)], "w double")


@oracle
def tuned_w_clusters_sql():
    return f"""WITH {CUSTOMERS_SQL}, pts AS (SELECT id, [seg::DOUBLE, bal * 1.0e-9] AS x FROM cust),
{O.planes(CLUSTERS)}, {O.tuned(CLUSTERS, 40)}"""


LONG_KEYS = HashFamily(dim=5, key_length=22, num_tables=10, widths=(8.0,), seed=SEED)
KEY_LENGTHS = (1, 2, 4, 8, 12)


@query
def key_length_sweep(spark, folder):
    """Minimum neighbours for some lengths; prefixes of one key."""
    table = staged_orders(spark, folder)
    found = least_by_length(table.df, LONG_KEYS, KEY_LENGTHS, table.rows)
    rows = [(k, least) for k, (least, _) in found.items()]
    return spark.createDataFrame(rows, "key_length bigint, min_neighbors bigint")


@oracle
def key_length_sweep_sql():
    parts = []
    for k in KEY_LENGTHS:
        codes = ", ".join(LONG_KEYS.codes[:k])
        parts.append(f"""SELECT {k}::BIGINT AS key_length, min(s)::BIGINT AS min_neighbors FROM (SELECT id, sum(n - 1) AS s
FROM h JOIN (SELECT t, {codes}, count(*) AS n FROM h GROUP BY t, {codes}) USING (t, {codes}) GROUP BY id)""")
    return f"WITH {ORDER_PTS}, {O.planes(LONG_KEYS)}, {O.hashed(LONG_KEYS)} " + " UNION ALL ".join(parts)


KEY_SEARCH = replace(ORDERS, num_tables=10).at(8.0)
WANTED = 10


@query
def tuned_key_length(spark, folder):
    table = staged_orders(spark, folder)
    chosen = tune_key_length(table.df, KEY_SEARCH, WANTED, table.rows)
    least = minimum_neighbors(table.df, chosen, table.rows)
    return spark.createDataFrame([(chosen.key_length, least)], "key_length bigint, min_neighbors bigint")


@oracle
def tuned_key_length_sql():
    """The shortest prefix within the tolerance, of the first key that reaches it; keys double."""
    ctes, rows = [], []
    for size in (2, 4, 8, 16):
        family = replace(KEY_SEARCH, key_length=size, stored=None)
        ctes += [O.planes(family).replace("planes(", f"planes{size}(", 1), O.hashed(family, name=f"h{size}").replace("planes", f"planes{size}")]
        for k in range(1, size + 1):
            codes = ", ".join(family.codes[:k])
            rows.append(f"""SELECT {size} AS size, {k} AS k, min(s) AS least FROM (SELECT id, sum(n - 1) AS s FROM h{size}
JOIN (SELECT t, {codes}, count(*) AS n FROM h{size} GROUP BY t, {codes}) USING (t, {codes}) GROUP BY id)""")
    return f"""WITH {ORDER_PTS}, {", ".join(ctes)}, m AS ({" UNION ALL ".join(rows)}),
key AS (SELECT min(size) AS size FROM m WHERE k = size AND least <= 4 * {WANTED}),
found AS (SELECT m.* FROM m JOIN key USING (size)),
short AS (SELECT min(k) AS k FROM found WHERE least <= 4 * {WANTED})
SELECT found.k::BIGINT AS key_length, least::BIGINT AS min_neighbors FROM found, short
WHERE found.k = short.k OR found.k = short.k - 1 AND (SELECT f.least FROM found f WHERE f.k = short.k) < 0.2 * {WANTED}
ORDER BY abs(least - {WANTED}) * (found.k <> short.k OR (SELECT f.least FROM found f WHERE f.k = short.k) < 0.2 * {WANTED})::INTEGER, found.k LIMIT 1"""


@query
def tuned_w_unscaled(spark, folder):
    """Raw orders, whose features reach a hundred thousand."""
    chosen = tune_w(stage(V.orders(spark, folder), "orders").df, ORDERS)
    return spark.createDataFrame([(round(chosen, 9),)], "w double")


@oracle
def tuned_w_unscaled_sql():
    return f"""WITH {O.raw("orders")}, pts AS (SELECT id, [f0, f1, f2, f3, f4] AS x FROM orders_raw),
{O.planes(ORDERS)}, {O.tuned(ORDERS, 8)}"""


@query
def fold_anomalies(spark, folder):
    """Anomalies of each fold, and those that the rebalanced training rows keep."""
    rows = with_fold(V.orders(spark, folder, 9), seed=SEED)
    kept = kept_in_training(class_counts(rows), seed=SEED)
    return rows.filter("label = 1").groupBy("fold").agg(F.count(F.lit(1)).alias("anomalies"), F.count_if(kept).alias("kept"))


@oracle
def fold_anomalies_sql():
    return f"""WITH {O.raw('orders', 9)}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS a FROM orders_raw)
SELECT floor({O.hash01('id', SEED, 'fold')} * 5)::INTEGER AS fold, count(*) AS anomalies,
count(*) FILTER (a::DOUBLE / n <= 0.02e0 OR {O.hash01('id', SEED, 'rebalance')} < 0.01e0 * n / a) AS kept
FROM orders_raw, c WHERE label = 1 GROUP BY fold"""


@query
def start_radius(spark, folder):
    radius = starting_radius(order_points(spark, folder), 5, seed=SEED)
    return spark.createDataFrame([(round(radius, 6),)], "radius double")


@oracle
def start_radius_sql():
    return f"""WITH {ORDER_PTS}, two AS (SELECT * FROM pts ORDER BY {O.hash01('id', SEED, 'radius')}, id LIMIT 2)
SELECT {O.rounded('list_distance(arg_min(x, id), arg_max(x, id))')} AS radius FROM two"""


RADIUS_SEARCH = ORDERS.at(2.0)
RADIUS_WANTED = 20


@query
def tuned_radius(spark, folder):
    """The radius at which the loneliest order has about the wanted neighbours over all tables."""
    table = staged_orders(spark, folder)
    chosen = tune_radius(table.df, RADIUS_SEARCH, RADIUS_WANTED, table.rows, start=1.0)
    least = minimum_neighbors(table.df, chosen, table.rows)
    return spark.createDataFrame([(chosen.radius, least)], "radius double, min_neighbors bigint")


@oracle
def tuned_radius_sql():
    """The smallest power of two in tolerance; below it the minimum is too small."""
    family = replace(RADIUS_SEARCH, label_width=True).at(*(2.0 * 2.0**e for e in range(-2, 9)))
    k = O.keys(family)
    return f"""WITH {ORDER_PTS}, {O.planes(family)}, {O.hashed(family)}, {O.counts(family)},
m AS (SELECT w, min(s) AS least FROM (SELECT w, id, sum(n - 1) AS s FROM h JOIN b USING ({k}) GROUP BY w, id) GROUP BY w)
SELECT w / 2.0e0 AS radius, least::BIGINT AS min_neighbors FROM m
WHERE least BETWEEN 0.1e0 * {RADIUS_WANTED} AND 10 * {RADIUS_WANTED} ORDER BY w LIMIT 1"""


def _grid(spark, folder):
    table = staged_orders(spark, folder, 9)
    return grid_search(table.df, ORDERS_GRID, GRID_WIDTHS, 5, SEED)


GRID_FAMILY = replace(ORDERS_GRID, label_width=True).at(*GRID_WIDTHS)


def grid_sql(family: HashFamily = GRID_FAMILY, view: str = "orders") -> str:
    """Fold by fold, with a copy of the rows for every training set."""
    k = O.keys(family)
    return f"""{O.points(view, 9)}, {O.planes(family)},
c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS a FROM pts),
f AS MATERIALIZED (SELECT pts.*, floor({O.hash01('id', SEED, 'fold')} * 5)::INTEGER AS own,
             coalesce(label, 0) <> 1 OR a::DOUBLE / n <= 0.02e0 OR {O.hash01('id', SEED, 'rebalance')} < 0.01e0 * n / a AS kept FROM pts, c),
h AS MATERIALIZED (SELECT * FROM ({O.hashed(family, 'f', 'id, label, own, kept', 'x')[len('x AS (') : -1]})),
tr AS MATERIALIZED (SELECT h.*, fold FROM h, range(5) AS r(fold) WHERE kept AND own <> fold),
b AS (SELECT fold, {k}, count(*) AS n FROM tr GROUP BY fold, {k}),
r AS (SELECT fold, w, id, sum(n) AS reach FROM tr JOIN b USING (fold, {k}) GROUP BY fold, w, id),
e AS (SELECT fold, {k}, count(*)::DOUBLE AS e1, sum(reach)::DOUBLE / count(*) AS e2,
             count(*)::DOUBLE * count(*) / sum(reach) AS e3, {O.inverse_sum('reach::BIGINT')} AS e4
      FROM tr JOIN r USING (fold, w, id) GROUP BY fold, {k}),
scored AS (SELECT w, own AS fold, id, any_value(label) AS label,
                  {SCORE_SUMS}
           FROM (SELECT *, own AS fold FROM h) g LEFT JOIN e USING (fold, {k}) GROUP BY w, own, id),
long AS ({' UNION ALL '.join(f'SELECT w, fold, {i + 1} AS estimator, label, {s} AS value FROM scored' for i, s in enumerate(SCORES))}),
area AS ({O.auroc('long', 'value', 'w, fold, estimator')})"""


@query
def grid_search_folds(spark, folder):
    return _grid(spark, folder).select("w", "fold", "estimator", r6(F.col("auroc"), "auroc"), "positives", "negatives")


@oracle
def grid_search_folds_sql():
    return f"WITH {grid_sql()} SELECT w, fold, estimator, {O.rounded('area')} AS auroc, positives, negatives FROM area"


@query
def grid_search_summary(spark, folder):
    found = grid_summary(_grid(spark, folder))
    return found.select("w", "estimator", r6(F.col("mean_auroc"), "mean_auroc"), r6(F.col("std_auroc"), "std_auroc"), "folds")


@oracle
def grid_search_summary_sql():
    return f"""WITH {grid_sql()} SELECT w, estimator, {O.rounded('avg(area)')} AS mean_auroc,
{O.rounded('stddev_pop(area)')} AS std_auroc, count(area) AS folds FROM area GROUP BY w, estimator"""


@query
def grid_bucket_sizes(spark, folder):
    table = staged_orders(spark, folder)
    found = fold_bucket_sizes(fold_counts(table.df, GRID_FAMILY, 5, SEED))
    return found.groupBy("w").agg(
        r6(F.avg("mean_size"), "mean_size"), r6(F.avg("relative_size"), "relative_size"), r6(F.avg("multi_buckets"), "multi_buckets")
    )


@oracle
def grid_bucket_sizes_sql():
    k = O.keys(GRID_FAMILY)
    return f"""WITH {ORDER_PTS}, {O.planes(GRID_FAMILY)},
f AS MATERIALIZED (SELECT pts.*, floor({O.hash01('id', SEED, 'fold')} * 5)::INTEGER AS own FROM pts),
{O.hashed(GRID_FAMILY, 'f', 'own')},
b AS (SELECT fold, {k}, count(*) AS n FROM h, range(5) AS r(fold) WHERE own <> fold GROUP BY fold, {k}),
total AS (SELECT fold, count(*) AS rows FROM f, range(5) AS r(fold) WHERE own <> fold GROUP BY fold),
m AS (SELECT w, fold, avg(n) AS size, avg(n) / any_value(rows) AS share, count(*) AS c FROM b JOIN total USING (fold) WHERE n > 1 GROUP BY w, fold)
SELECT w, {O.rounded('avg(size)')} AS mean_size, {O.rounded('avg(share)')} AS relative_size, {O.rounded('avg(c)')} AS multi_buckets
FROM m GROUP BY w"""


REPORT = ("buckets", "multi_buckets", "mean_size", "relative_size", "relative_std")


@query
def grid_report_orders(spark, folder):
    table = staged_orders(spark, folder, 9)
    found = grid_report(table.df, ORDERS_GRID, GRID_WIDTHS, 5, SEED, dataset="orders")
    areas = [f"{kind}_auroc{e}" for kind in ("mean", "std") for e in range(1, 5)]
    return found.select("dataset", "key_length", "num_tables", "w", *[r6(F.col(c), c) for c in (*areas, *REPORT)])


def grid_report_sql(family: HashFamily, view: str) -> str:
    areas = ", ".join(
        f"{O.rounded(f'{kind}(area) FILTER (estimator = {e})')} AS {name}_auroc{e}"
        for kind, name in (("avg", "mean"), ("stddev_pop", "std"))
        for e in range(1, 5)
    )
    return f"""WITH {grid_sql(family, view)}, total AS (SELECT fold, count(*) AS rows FROM f, range(5) AS r(fold) WHERE kept AND own <> fold GROUP BY fold),
m AS (SELECT w, fold, count(*) AS buckets, count(*) FILTER (n > 1) AS multi_buckets, avg(n) FILTER (n > 1) AS mean_size,
             avg(n) FILTER (n > 1) / any_value(rows) AS relative_size, stddev_pop(n) FILTER (n > 1) / any_value(rows) AS relative_std
      FROM b JOIN total USING (fold) GROUP BY w, fold),
z AS (SELECT w, {', '.join(f'{O.rounded(f"avg({c})")} AS {c}' for c in REPORT)} FROM m GROUP BY w),
q AS (SELECT w, {areas} FROM area GROUP BY w)
SELECT '{view}' AS dataset, {family.key_length}::INTEGER AS key_length, {family.num_tables}::INTEGER AS num_tables,
       q.*, {', '.join(REPORT)} FROM q JOIN z USING (w)"""


@oracle
def grid_report_orders_sql():
    return grid_report_sql(GRID_FAMILY, "orders")


PUBLISHED = {"orders": 5, "events": 3, "documents": 5}


@query
def grid_report_published(spark, folder):
    """The published grid, widths, tables and folds, on three data sets."""
    datasets = {"orders": V.orders(spark, folder, 9), "events": V.events(spark, folder), "documents": V.documents(spark, folder)}
    found = published_grid(datasets, seed=SEED)
    areas = [f"{kind}_auroc{e}" for kind in ("mean", "std") for e in range(1, 5)]
    return found.select("dataset", "key_length", "num_tables", "w", *[r6(F.col(c), c) for c in (*areas, *REPORT)])


@oracle
def grid_report_published_sql():
    families = {view: replace(HashFamily(dim, 4, 50, seed=SEED), label_width=True).at(*GRID_WIDTHS) for view, dim in PUBLISHED.items()}
    return " UNION ALL BY NAME ".join(f"SELECT * FROM ({grid_report_sql(family, view)})" for view, family in families.items())


@query
def experiment_orders(spark, folder):
    """Standardise on the training part, split, fit, evaluate."""
    detector = ReachabilityDetector(keyLength=4, numTables=50, splitW=4.0, seed=SEED)
    _, measures = run_experiment(V.orders(spark, folder), detector, 0.8, SEED)
    names = ("auroc", "accuracy", "precision", "recall", "f1")
    return measures.select("estimator", "tp", "tn", "fp", "fn", *[r6(F.col(c), c) for c in names])


@oracle
def experiment_orders_sql():
    flags = f"""th AS (SELECT max(reach) - {ORDERS.num_tables} AS threshold FROM (SELECT reach FROM r ORDER BY reach
LIMIT (SELECT count(*) FROM train WHERE label = 1))),
flagged AS (SELECT scored.*, CASE WHEN score1 >= -threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM scored, th)"""
    long = " UNION ALL ".join(f"SELECT '{s}' AS estimator, label, {s} AS value FROM flagged" for s in (*SCORES, "prediction"))
    return f"""WITH {REACH_SQL}, {flags}, long AS ({long}), a AS ({O.auroc('long', 'value', 'estimator')}),
c AS (SELECT count(*) FILTER (prediction = 1 AND label = 1) AS tp, count(*) FILTER (prediction = 0 AND label = 0) AS tn,
count(*) FILTER (prediction = 1 AND label = 0) AS fp, count(*) FILTER (prediction = 0 AND label = 1) AS fn FROM flagged)
SELECT estimator, tp, tn, fp, fn, {O.rounded('area')} AS auroc, {O.rounded('(tp + tn)::DOUBLE / (tp + tn + fp + fn)')} AS accuracy,
{O.rounded('tp::DOUBLE / nullif(tp + fp, 0)')} AS precision, {O.rounded('tp::DOUBLE / nullif(tp + fn, 0)')} AS recall,
{O.rounded('CASE WHEN tp > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) END')} AS f1 FROM a, c"""


@query
def base_documents(spark, folder):
    """Whole texts, rebalanced training rows, and a threshold from the kept anomalies."""
    table = staged_points(V.documents(spark, folder))
    detector = BucketCountDetector(keyLength=4, numTables=20, splitW=4.0, seed=SEED)
    return detector.fit(table.df).transform(table.df).select("id", "label", "score", "prediction")


@oracle
def base_documents_sql():
    k = O.keys(DOCUMENTS)
    return f"""WITH {O.points('documents')}, {O.planes(DOCUMENTS)}, c AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS a FROM pts),
kept AS (SELECT pts.* FROM pts, c WHERE coalesce(label, 0) <> 1 OR a::DOUBLE / n <= 0.02e0 OR {O.hash01('id', SEED, 'rebalance')} < 0.01e0 * n / a),
{O.hashed(DOCUMENTS, 'kept')}, {O.hashed(DOCUMENTS, 'pts', name='g')}, {O.counts(DOCUMENTS)},
near AS (SELECT id, sum(n - 1) AS neighbors FROM h JOIN b USING ({k}) GROUP BY id),
ks AS (SELECT CASE WHEN count(*) FILTER (label = 1) > 0 THEN count(*) FILTER (label = 1)
              ELSE greatest(1, round_even(0.01e0 * count(*), 0)) END::BIGINT AS k FROM kept),
th AS (SELECT max(neighbors) AS threshold FROM (SELECT neighbors FROM near ORDER BY neighbors LIMIT (SELECT k FROM ks))),
s AS (SELECT id, sum(coalesce(n, 0))::BIGINT AS s FROM g LEFT JOIN b USING ({k}) GROUP BY id)
SELECT id, label, -s AS score, CASE WHEN s <= threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM s JOIN pts USING (id), th"""


@query
def stream_event_scores(spark, folder):
    """Events read as a stream and scored batch by batch against a fitted bucket table."""
    scaling = fit_scaling(V.events(spark, folder))
    detector = BucketCountDetector(keyLength=4, numTables=20, splitW=2.0, seed=SEED)
    model = detector.fit(scaling.apply(V.events(spark, folder)))
    schema = V.table(spark, folder, "events").schema
    # A glob, because a file source reads folders.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    points = scaling.apply(V.event_points(source))
    out = _fresh(spark, "stream")
    writer = score_stream(points, model, parquet_sink(out, "id", "score"))
    run = writer.option("checkpointLocation", _fresh(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("id bigint, score bigint, batch bigint").parquet(out).drop("batch")


@oracle
def stream_event_scores_sql():
    return f"""WITH {O.points('events')}, {O.planes(EVENTS)}, {O.hashed(EVENTS)}, {O.counts(EVENTS)}
SELECT id, -sum(n)::BIGINT AS score FROM h JOIN b USING ({O.keys(EVENTS)}) GROUP BY id"""


@query
def ml_transform(spark, folder):
    """The detector as a stage of a Spark ML pipeline."""
    train, test = train_test(spark, folder)
    stages = [ReachabilityDetector(keyLength=4, numTables=50, splitW=4.0, seed=SEED)]
    scored = Pipeline(stages=stages).fit(train).transform(test)
    return scored.select("id", "label", *[r6(F.col(s), s) for s in SCORES], "prediction")


@oracle
def ml_transform_sql():
    return f"""WITH {REACH_SQL}, th AS (SELECT max(reach) - {ORDERS.num_tables} AS threshold FROM (SELECT reach FROM r ORDER BY reach
LIMIT (SELECT count(*) FROM train WHERE label = 1)))
SELECT id, label, {', '.join(f'{O.rounded(s)} AS {s}' for s in SCORES)},
       CASE WHEN score1 >= -threshold THEN 1.0e0 ELSE 0.0e0 END AS prediction FROM scored, th"""


@query
def spark_auroc(spark, folder):
    """Spark's own AUROC next to ours."""
    table = staged_points(V.events(spark, folder))
    counts = B.stage_counts(table.df, EVENTS)
    scored = stage(R.count_scores(table.df, EVENTS, counts, table.rows, carry=["label"]), "scored").df
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    area = theirs.evaluate(scored.withColumn("score", F.col("score").cast("double")))
    return auroc(scored).select(r6(F.col("auroc"), "auroc"), F.lit(round(area, 6)).alias("spark_auroc"))


@oracle
def spark_auroc_sql():
    return f"""WITH {O.points('events')}, {O.planes(EVENTS)}, {O.hashed(EVENTS)}, {O.counts(EVENTS)},
s AS (SELECT id, -sum(n) AS score FROM h JOIN b USING ({O.keys(EVENTS)}) GROUP BY id),
l AS (SELECT score, label FROM s JOIN pts USING (id)), a AS ({O.auroc('l', 'score')})
SELECT {O.rounded('area')} AS auroc, {O.rounded('area')} AS spark_auroc FROM a"""


# --- files --------------------------------------------------------------------------------------


def _fresh(spark, name: str) -> str:
    return f"{session_folder(spark, name)}/rows"


@query
def libsvm_roundtrip(spark, folder):
    path = _fresh(spark, "libsvm")
    write_libsvm(V.orders(spark, folder), path)
    return read_libsvm(spark, path, 5).select("label", *cells(5))


@oracle
def libsvm_roundtrip_sql():
    return f"WITH {O.raw('orders')} SELECT label, {', '.join(f'{O.rounded(f"f{i}")} AS f{i}' for i in range(5))} FROM orders_raw"


@query
def one_hot_libsvm(spark, folder):
    """Encode, write sparse LIBSVM, and read it back with a named width."""
    dictionary = V.customer_dictionary(spark, folder)
    points = V.customers(spark, folder).withColumn("label", F.lit(0.0))
    encoded = one_hot(points, dictionary, form="vector")
    path = _fresh(spark, "one-hot")
    write_libsvm(encoded, path)
    cells = read_libsvm(spark, path, dictionary.width + 1).select(F.posexplode("features").alias("slot", "x"))
    return cells.groupBy("slot").agg(F.count_if(F.col("x") != 0).alias("set_rows"), r6(F.sum("x"), "total"))


@oracle
def one_hot_libsvm_sql():
    return one_hot_slots_sql()


@query
def scored_export(spark, folder):
    model, test = _base(spark, folder)
    path = _fresh(spark, "scored")
    write_scored(model.transform(test), path, "csv")
    rows = spark.read.csv(path, schema="id bigint, label double, features string, score bigint, prediction double")
    return rows.select("id", "label", F.size(F.split("features", ";")).alias("cells"), "score", "prediction")


@oracle
def scored_export_sql():
    return f"WITH {BASE_SQL} SELECT id, label, 5 AS cells, score, prediction FROM scored"


@query
def saved_model_scores(spark, folder):
    model, test = _reach(spark, folder)
    path = _fresh(spark, "model")
    model.save(path)
    again = ReachabilityModel.load(spark, path)
    return again.transform(test).select("id", *[r6(F.col(s), s) for s in SCORES])


@oracle
def saved_model_scores_sql():
    return reach_scores_sql()


@query
def libsvm_folds(spark, folder):
    path = _fresh(spark, "folds")
    write_folds(with_fold(V.orders(spark, folder), seed=SEED), path)
    rows = spark.read.format("libsvm").option("numFeatures", "5").load(path)
    return rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("rows"))


@oracle
def libsvm_folds_sql():
    return kfold_counts_sql()
