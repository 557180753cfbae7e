"""One regressor over the windows of all symbols, with Spark's own learners."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from seqcast.operators.windows import unfold_windows
from seqcast.schema import FEATURES, WINDOW_LENGTH

ALGORITHMS = {"linear": LinearRegression, "gbt": GBTRegressor}


def window_features(windows: DataFrame) -> DataFrame:
    """Windows with ``features``, the flattened window as a vector."""
    return windows.withColumn("features", array_to_vector(F.flatten("x")))


def fit_forecaster(blocks: DataFrame, algo: str = "linear", length: int = WINDOW_LENGTH, **params) -> PipelineModel:
    """Fits the bar after the window, scaled, on train blocks of one category.

    A learner passes over its rows several times. What is kept between the
    passes are the blocks, which are hardly larger than the bars; the windows,
    larger by their length, are unfolded in every pass. The declared vector
    size saves the learner a job of its own to find it.
    """
    if algo not in ALGORITHMS:
        raise ValueError(f"algo must be one of {sorted(ALGORITHMS)}")
    if algo == "linear":
        params.setdefault("regParam", 1e-4)
    learner = ALGORITHMS[algo](featuresCol="features", labelCol="label", predictionCol="prediction", **params)
    size = VectorSizeHint(inputCol="features", size=length * len(FEATURES), handleInvalid="optimistic")
    ours = blocks.storageLevel == StorageLevel.NONE
    if ours:
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        windows = window_features(unfold_windows(blocks, length))
        return Pipeline(stages=[size, learner]).fit(windows.select("features", F.element_at("y", -1).alias("label")))
    finally:
        if ours:
            blocks.unpersist()
