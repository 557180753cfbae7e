"""Aggregates over bars and predictions. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqcast.functions.columns import split_position, truncated_int, window_count
from seqcast.schema import FEATURES, TRAIN_RATIO, WINDOW_LENGTH


def symbol_counts(bars: DataFrame) -> DataFrame:
    """Dated bars per symbol."""
    return bars.groupBy("symbol").agg(F.count("date").alias("count"))


def symbol_total(bars: DataFrame) -> DataFrame:
    """Number of symbols."""
    return bars.agg(F.countDistinct("symbol").alias("symbols"))


def series_length(bars: DataFrame) -> DataFrame:
    """Bars per symbol."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def feature_ranges(bars: DataFrame, by: str | None = "symbol", counted: bool = False) -> DataFrame:
    """Minimum and maximum of each feature, per symbol or over the whole table, and the bars ``n`` if asked for."""
    ranges = [F.count(F.lit(1)).alias("n")] if counted else []
    ranges += [f(name).alias(f"{tag}_{name}") for name in FEATURES for tag, f in (("min", F.min), ("max", F.max))]
    return bars.groupBy(*([by] if by else [])).agg(*ranges)


def window_counts(
    bars: DataFrame, length: int = WINDOW_LENGTH, ratio: float = TRAIN_RATIO
) -> DataFrame:
    """Series length, split position and number of train and test windows per symbol."""
    return (
        series_length(bars)
        .withColumn("split", split_position(F.col("n"), ratio))
        .withColumn("train_windows", window_count(F.col("split"), length))
        .withColumn("test_windows", window_count(F.col("n") - F.col("split"), length))
    )


def minibatch_size(bars: DataFrame, size: int = -1, batch_split: int = 1) -> DataFrame:
    """Mini-batch size per symbol: the given one, or the series length divided by ``batch_split``."""
    if batch_split < 1:
        raise ValueError("batch_split must be at least 1")
    chosen = F.lit(size).cast("bigint") if size != -1 else F.expr(f"n div {int(batch_split)}")
    return series_length(bars).select("symbol", "n", chosen.alias("batch_size"))


def mean_loss(scored: DataFrame, by: str | None = "symbol") -> DataFrame:
    """Mean squared error of ``prediction`` against ``actual``."""
    error = F.col("prediction") - F.col("actual")
    return scored.groupBy(*([by] if by else [])).agg(F.avg(error * error).alias("loss"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch with the lowest loss per symbol; of equal losses the earliest."""
    best = F.min(F.struct("loss", "epoch"))
    return history.groupBy("symbol").agg(best.alias("best")).select(
        "symbol", F.col("best.epoch").alias("epoch"), F.col("best.loss").alias("loss")
    )


def weighted_param_average(params: DataFrame) -> DataFrame:
    """Average of worker parameters ``(symbol, k, v, n)``, weighted by the ``n`` rows each worker saw."""
    total = F.sum(F.col("v") * F.col("n"))
    return params.groupBy("symbol", "k").agg((total / F.sum("n")).alias("v"))


def value_bounds(predictions: DataFrame, by: str | None = "symbol") -> DataFrame:
    """Axis bounds of the predicted and actual series: 98 % of the least and 102 % of the greatest value, as integers."""
    low = F.min(F.least("prediction", "actual")) * 0.98
    high = F.max(F.greatest("prediction", "actual")) * 1.02
    return predictions.groupBy(*([by] if by else [])).agg(
        truncated_int(low).alias("min_value"), truncated_int(high).alias("max_value")
    )
