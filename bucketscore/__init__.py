"""Density-based outlier scoring with locality-sensitive hashing, as Spark jobs."""

from bucketscore.operators.lsh import HashFamily, hash_points
from bucketscore.plans.detectors import (
    BucketCountDetector,
    BucketCountModel,
    DualResolutionDetector,
    DualResolutionModel,
    ReachabilityDetector,
    ReachabilityModel,
)
from bucketscore.plans.experiments import distance_sweep, grid_search, run_experiment
from bucketscore.plans.tuning import tune_family, tune_radius, tune_w, w_sweep

__all__ = [
    "BucketCountDetector",
    "BucketCountModel",
    "DualResolutionDetector",
    "DualResolutionModel",
    "HashFamily",
    "ReachabilityDetector",
    "ReachabilityModel",
    "distance_sweep",
    "grid_search",
    "hash_points",
    "run_experiment",
    "tune_family",
    "tune_radius",
    "tune_w",
    "w_sweep",
]
