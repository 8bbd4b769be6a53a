"""The three detectors as Spark ML estimators and models.

Fitting produces a bucket table that stays a distributed table; only the hash planes, the widths
and the thresholds are held by the driver. Transforming joins hashed rows to that table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscore.functions.running import kth_smallest
from bucketscore.operators.buckets import (
    bucket_distances,
    bucket_size_histogram,
    bucket_stats,
    buckets_of_point,
    first_of_class,
    neighbor_counts,
    stage_counts,
    sum_over_buckets,
)
from bucketscore.operators.lsh import HashFamily
from bucketscore.operators.reach import (
    SCORES,
    estimators_from_reach,
    left_out_scores,
    neighbor_threshold,
    reach_scores,
)
from bucketscore.operators.sampling import ClassCounts, class_counts, is_anomaly, kept_in_training
from bucketscore.operators.scaling import as_array, dimension, point_facts
from bucketscore.plans.tuning import HIGH_SHARE, LOW_SHARE, tune_family
from bucketscore.staging import Staged, drop, stage


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


_int, _float, _text, _flag = (
    TypeConverters.toInt,
    TypeConverters.toFloat,
    TypeConverters.toString,
    TypeConverters.toBoolean,
)


class DetectorParams(Params):
    """Parameters shared by the detectors. One that is not set is chosen by the fit."""

    idCol = _param("idCol", "unique row id", _text)
    featuresCol = _param("featuresCol", "array<double> or vector of features", _text)
    labelCol = _param("labelCol", "label; null means unlabelled", _text)
    anomalyValue = _param("anomalyValue", "label of an anomaly", _float)
    keyLength = _param("keyLength", "codes per key", _int)
    numTables = _param("numTables", "hash tables", _int)
    numTablesMultiplier = _param("numTablesMultiplier", "factor on numTables for the final family", _int)
    splitW = _param("splitW", "bucket width; tuned if not set", _float)
    radius = _param("radius", "unit the features are divided by", _float)
    minBucketSize = _param("minBucketSize", "wanted mean size of buckets, up to twice as many; a share of the rows if not set", _int)
    numPartitions = _param("numPartitions", "partitions of the training rows; Spark chooses if not set", _int)
    seed = _param("seed", "seed of the planes and the draws", _int)
    contamination = _param("contamination", "share of anomalies to assume where none is labelled", _float)
    tuneFraction = _param("tuneFraction", "share of the training rows used to tune the width", _float)
    excludeSelf = _param("excludeSelf", "the rows to score are the training rows", _flag)

    def __init__(self, **values) -> None:
        super().__init__()
        # keyLength 4 and 50 tables, the shape every published run uses.
        self._setDefault(
            idCol="id", featuresCol="features", labelCol="label", anomalyValue=1.0, keyLength=4, numTables=50,
            numTablesMultiplier=1, radius=1.0, minBucketSize=50, seed=7, contamination=0.01, tuneFraction=1.0,
            excludeSelf=False,
        )
        self.set_params(**values)

    def set_params(self, **values):
        """Set any parameters by name."""
        unknown = [name for name in values if not self.hasParam(name)]
        if unknown:
            raise ValueError(f"unknown parameters: {unknown}")
        self._set(**values)
        return self

    @property
    def names(self) -> tuple[str, str, str]:
        return self.getOrDefault("featuresCol"), self.getOrDefault("idCol"), self.getOrDefault("labelCol")

    def _points(self, df: DataFrame, *more: str) -> DataFrame:
        features, id_col, _ = self.names
        return as_array(df.select(id_col, features, *more), features)


@dataclass(frozen=True)
class _Training:
    points: DataFrame
    staged: Staged
    dim: int
    rows: int
    anomalies: int


class _Detector(Estimator, DetectorParams):
    def _training(self, df: DataFrame) -> _Training:
        """Training rows, written once for the passes of the fit, then checked and rebalanced.

        The input is read a single time; what the checks need is measured as it is written.
        """
        features, id_col, label = self.names
        value, seed = self.getOrDefault("anomalyValue"), self.getOrDefault("seed")
        labelled = label in df.columns
        points = self._points(df, *([label] if labelled else []))
        if not labelled:
            points = points.withColumn(label, F.lit(None).cast("double"))
        if self.isSet("numPartitions"):
            points = points.repartition(self.getOrDefault("numPartitions"), id_col)
        anomaly = is_anomaly(label, value)
        table = stage(points, "training", anomalies=F.count_if(anomaly), **point_facts(features))
        dim = dimension(table)
        classes = ClassCounts(table.rows, int(table.facts["anomalies"]))
        if classes.keep_probability >= 1.0:
            return _Training(table.df, table, dim, classes.rows, classes.anomalies)
        kept = table.df.filter(kept_in_training(classes, id_col, label, seed, value))
        after = class_counts(kept, label, value)
        return _Training(kept, table, dim, after.rows, after.anomalies)

    def _start_family(self, dim: int) -> HashFamily:
        get = self.getOrDefault
        return HashFamily(dim, get("keyLength"), get("numTables"), (4.0,), get("radius"), get("seed"))

    def _tuned(self, data: _Training, family: HashFamily, scale: float = 1.0) -> HashFamily:
        features, id_col, _ = self.names
        low, high = LOW_SHARE, HIGH_SHARE
        if self.isSet("minBucketSize"):
            # Buckets of that size to twice that size.
            low = min(1.0, self.getOrDefault("minBucketSize") / data.rows)
            high = 2 * low
        return tune_family(
            data.points, family, low * scale, high * scale, self.getOrDefault("tuneFraction"),
            id_col, features, self.getOrDefault("seed"), data.rows,
        )

    def _family(self, data: _Training) -> HashFamily:
        """The family of the model: as tuned, unless the width is given or there are to be more tables."""
        start = self._start_family(data.dim)
        chosen = start.at(self.getOrDefault("splitW")) if self.isSet("splitW") else self._tuned(data, start)
        return chosen.times(self.getOrDefault("numTablesMultiplier"))

    def _neighbors(self, data: _Training, family: HashFamily, counts: Staged) -> Staged:
        """Neighbour counts of the training rows. One row per id, so a repeated id shows here."""
        features, id_col, _ = self.names
        near = stage(neighbor_counts(data.points, family, counts, data.rows, id_col, (), features), "neighbors")
        if near.rows != data.rows * (len(family.widths) if family.sweeping else 1):
            raise ValueError(f"{id_col} must be unique: {data.rows} training rows, {near.rows} rows by id")
        return near

    def _expected(self, data: _Training) -> int:
        """How many training rows the threshold should flag."""
        share = round(self.getOrDefault("contamination") * data.rows)
        return data.anomalies or max(1, int(share))


class _DetectorModel(Model, DetectorParams):
    score_columns: tuple[str, ...] = ("score",)

    def __init__(self, family: HashFamily, buckets: Staged, thresholds: list[float], rows: int, **values) -> None:
        super().__init__(**values)
        self.family, self.buckets, self.thresholds, self.rows = family, buckets, thresholds, rows

    @property
    def threshold(self) -> float:
        return self.thresholds[0]

    def _like(self, detector: DetectorParams):
        detector._copyValues(self)
        return self

    def copy(self, extra=None):
        made = type(self)(self.family, self.buckets, self.thresholds, self.rows)
        return self._copyValues(made, extra)

    def _scores(self, points: DataFrame, id_col: str) -> DataFrame:
        raise NotImplementedError

    def _decide(self, scored: DataFrame) -> Column:
        raise NotImplementedError

    def _own(self) -> int:
        """What a training row adds to its own buckets."""
        return self.family.num_tables if self.getOrDefault("excludeSelf") else 0

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # The rows are written with a number of their own: the input runs once, and rows with
        # a repeated or null id are scored each for itself.
        numbered = dataset.withColumn("_row", F.monotonically_increasing_id())
        rows = stage(numbered, "rows").df
        features = self.getOrDefault("featuresCol")
        scores = self._scores(as_array(rows.select("_row", features), features), "_row")
        scores = scores.withColumn("prediction", F.when(self._decide(scores), 1.0).otherwise(0.0))
        return rows.join(scores, "_row").drop("_row")

    def summary(self) -> DataFrame:
        """Bucket numbers and sizes of the training rows."""
        return bucket_stats(self.buckets.df, self.rows, self.family.scope)

    def mean_bucket_distance(self, points: DataFrame) -> DataFrame:
        """Mean over multi-member buckets of the mean distance to the reference member."""
        features, id_col, _ = self.names
        per_bucket = bucket_distances(self._points(points), self.family, self.rows, id_col, features)
        return per_bucket.groupBy(*self.family.scope).agg(F.avg("mean_distance").alias("mean_distance"))

    def size_histogram(self, bins: int = 20) -> DataFrame:
        return bucket_size_histogram(self.buckets.df, bins)

    def size_histogram_around(self, points: DataFrame, anomaly: bool, bins: int = 20) -> DataFrame:
        """Sizes of the buckets that hold the first anomalous (or first normal) row."""
        features, id_col, label = self.names
        rows = self._points(points, label)
        wanted = F.coalesce(F.col(label) == self.getOrDefault("anomalyValue"), F.lit(False))
        chosen = first_of_class(rows, wanted if anomaly else ~wanted, id_col)
        around = buckets_of_point(rows, self.family, self.buckets.df, F.col(id_col) == chosen, features)
        return bucket_size_histogram(around, bins)

    def release(self) -> None:
        """Delete the staged bucket table of a fitted model that is no longer used; saved files stay."""
        drop(self.buckets.df.sparkSession, self.buckets)

    def save(self, path: str, mode: str = "error") -> None:
        """Bucket table and planes as parquet, the rest as one line of JSON."""
        spark = self.buckets.df.sparkSession
        self.buckets.df.write.mode(mode).parquet(f"{path}/buckets")
        self.family.planes_df(spark).coalesce(1).write.mode(mode).parquet(f"{path}/planes")
        family = {
            "dim": self.family.dim, "key_length": self.family.key_length, "num_tables": self.family.num_tables,
            "widths": list(self.family.widths), "radius": self.family.radius, "seed": self.family.seed,
            "label_width": self.family.label_width,
        }
        values = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        facts = {
            "class": type(self).__name__, "family": family, "thresholds": self.thresholds, "rows": self.rows,
            "bucket_rows": self.buckets.rows, "params": values,
        }
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        facts = json.loads(spark.read.text(f"{path}/facts").first().value)
        if facts["class"] != cls.__name__:
            raise ValueError(f"{path} holds a {facts['class']}")
        shape = dict(facts["family"], widths=tuple(facts["family"]["widths"]))
        family = HashFamily.from_planes_df(spark.read.parquet(f"{path}/planes"), **shape)
        table = Staged(spark.read.parquet(f"{path}/buckets"), facts["bucket_rows"], f"{path}/buckets", owned=False)
        return cls(family, table, facts["thresholds"], facts["rows"], **facts["params"])


class BucketCountDetector(_Detector):
    """Scores a row by the population of its buckets."""

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(tuneFraction=0.05)
        self.set_params(**values)

    def _fit(self, dataset: DataFrame) -> BucketCountModel:
        features, _, _ = self.names
        data = self._training(dataset)
        family = self._family(data)
        counts = stage_counts(data.points, family, features)
        near = self._neighbors(data, family, counts)
        threshold = neighbor_threshold(near.df, self._expected(data)).first().threshold
        drop(dataset.sparkSession, data.staged, near)
        return BucketCountModel(family, counts, [threshold], data.rows)._like(self)


class BucketCountModel(_DetectorModel):
    """Adds ``score`` (minus the summed sizes) and ``prediction``."""

    def _scores(self, points: DataFrame, id_col: str) -> DataFrame:
        features, _, _ = self.names
        values = {"score": -F.col("n")}
        return sum_over_buckets(points, self.family, self.buckets, values, self.rows, id_col, (), features)

    def _decide(self, scored: DataFrame) -> Column:
        return -F.col("score") - self._own() <= self.threshold


class ReachabilityDetector(_Detector):
    """Scores a row by four bucket estimators built from the reach of the training rows."""

    predictionScore = _param("predictionScore", "score that the prediction thresholds", _text)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(predictionScore=SCORES[0])
        self.set_params(**values)

    def _fit(self, dataset: DataFrame) -> ReachabilityModel:
        features, id_col, _ = self.names
        if self.getOrDefault("predictionScore") not in SCORES:
            raise ValueError(f"predictionScore is one of {SCORES}")
        data = self._training(dataset)
        family = self._family(data)
        counts = stage_counts(data.points, family, features)
        near = self._neighbors(data, family, counts)
        reach = near.df.select(id_col, (F.col("neighbors") + family.num_tables).alias("reach"))
        buckets = stage(estimators_from_reach(data.points, family, reach, id_col, features), "buckets")
        threshold = self._threshold(data, family, near, buckets)
        drop(dataset.sparkSession, data.staged, counts, near)
        return ReachabilityModel(family, buckets, [threshold], data.rows)._like(self)

    def _threshold(self, data: _Training, family: HashFamily, near: Staged, buckets: Staged) -> float:
        features, id_col, _ = self.names
        chosen, k = self.getOrDefault("predictionScore"), self._expected(data)
        if chosen == SCORES[0]:
            return -float(neighbor_threshold(near.df, k).first().threshold)
        scores = left_out_scores(data.points, family, buckets, data.rows, id_col, features)
        return -float(kth_smallest(scores.select((-F.col(chosen)).alias("value")), "value", k).first().kth)


class ReachabilityModel(_DetectorModel):
    """Adds ``score1..score4`` and ``prediction``; rows at or above the threshold are flagged.

    The threshold comes from training rows that are left out of their own buckets, as fresh rows are.
    With ``excludeSelf`` the scores are those of training rows left out in the same way.
    """

    score_columns = SCORES
    predictionScore = _param("predictionScore", "score that the prediction thresholds", _text)

    def __init__(self, family, buckets, thresholds, rows, **values) -> None:
        super().__init__(family, buckets, thresholds, rows)
        self._setDefault(predictionScore=SCORES[0])
        self.set_params(**values)

    def _scores(self, points: DataFrame, id_col: str) -> DataFrame:
        features, _, _ = self.names
        if self.getOrDefault("excludeSelf"):
            return left_out_scores(points, self.family, self.buckets, self.rows, id_col, features)
        return reach_scores(points, self.family, self.buckets, self.rows, id_col, (), features)

    def _decide(self, scored: DataFrame) -> Column:
        return F.col(self.getOrDefault("predictionScore")) >= self.threshold


class DualResolutionDetector(_Detector):
    """Compares the population around a row at a small and at a large bucket width."""

    splitWSmall = _param("splitWSmall", "small bucket width; tuned if not set", _float)
    splitWLarge = _param("splitWLarge", "large bucket width; tuned if not set", _float)
    smallBucketSize = _param("smallBucketSize", "wanted bucket size at the small width", _int)
    largeBucketSize = _param("largeBucketSize", "wanted bucket size at the large width", _int)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(smallBucketSize=5, largeBucketSize=100)
        self.set_params(**values)

    def _widths(self, data: _Training, family: HashFamily) -> tuple[float, float]:
        """The large width is tuned as usual; the small one for a share smaller by the size ratio."""
        get = self.getOrDefault
        large = get("splitWLarge") if self.isSet("splitWLarge") else self._tuned(data, family).widths[0]
        if self.isSet("splitWSmall"):
            small = get("splitWSmall")
        else:
            small = self._tuned(data, family, get("smallBucketSize") / get("largeBucketSize")).widths[0]
        if small >= large:
            # The share cannot fall below 2 / rows, so a small table may tune both to one width.
            raise ValueError(f"the small width {small} must be below the large width {large}; set one")
        return small, large

    def _fit(self, dataset: DataFrame) -> DualResolutionModel:
        features, _, _ = self.names
        data = self._training(dataset)
        start = self._start_family(data.dim)
        family = start.at(*self._widths(data, start)).times(self.getOrDefault("numTablesMultiplier"))
        counts = stage_counts(data.points, family, features)
        near = self._neighbors(data, family, counts)
        thresholds = [
            neighbor_threshold(near.df.filter(F.col("w") == w), self._expected(data)).first().threshold
            for w in family.widths
        ]
        drop(dataset.sparkSession, data.staged, near)
        return DualResolutionModel(family, counts, thresholds, data.rows)._like(self)


class DualResolutionModel(_DetectorModel):
    """Adds ``score_small``, ``score_large``, ``density_ratio``, ``score`` and ``prediction``."""

    score_columns = ("score", "score_small", "score_large")
    splitWSmall = DualResolutionDetector.splitWSmall
    splitWLarge = DualResolutionDetector.splitWLarge
    smallBucketSize = DualResolutionDetector.smallBucketSize
    largeBucketSize = DualResolutionDetector.largeBucketSize

    def _scores(self, points: DataFrame, id_col: str) -> DataFrame:
        features, _, _ = self.names
        return dual_scores(points, self.family, self.buckets, self.rows, id_col, features)

    def _decide(self, scored: DataFrame) -> Column:
        return -F.col("score_small") - self._own() <= self.threshold


def dual_scores(
    points: DataFrame,
    family: HashFamily,
    counts: Staged,
    n_points: int,
    id_col: str = "id",
    features: str = "features",
) -> DataFrame:
    """Minus the summed sizes at both widths, and their ratio (null where no bucket is known)."""
    small, large = family.widths
    values = {
        "_small": F.when(F.col("w") == small, F.col("n")).otherwise(0),
        "_large": F.when(F.col("w") == large, F.col("n")).otherwise(0),
    }
    sums = sum_over_buckets(points, family, counts, values, n_points, id_col, (), features, merge_widths=True)
    ratio = F.try_divide(F.col("_small"), F.col("_large"))
    return sums.select(
        id_col,
        (-F.col("_small")).alias("score_small"),
        (-F.col("_large")).alias("score_large"),
        ratio.alias("density_ratio"),
        (-F.coalesce(ratio, F.lit(0.0))).alias("score"),
    )
