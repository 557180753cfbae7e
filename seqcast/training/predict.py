"""Forecasts of the bar after each test window, in the units of the feature."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from seqcast.functions.columns import unscaled
from seqcast.operators.windows import unfold_windows
from seqcast.schema import FEATURES, WINDOW_LENGTH, Category
from seqcast.training.averaging import AveragedModel
from seqcast.training.forecaster import window_features

PREDICTION_COLUMNS = ("symbol", "window", "date", "category", "prediction", "actual")


def _labelled(df: DataFrame, category: Category) -> DataFrame:
    return df.withColumn("category", F.lit(category.value)).select(*PREDICTION_COLUMNS)


def _in_units(windows: DataFrame, prediction: Column, category: Category) -> DataFrame:
    """Unfolded test windows with the scaled ``prediction`` brought back by the ranges of their block."""
    if category is Category.ALL:
        parts = [unscaled(F.get(prediction, F.lit(k)), F.get("low", F.lit(k)), F.get("high", F.lit(k))) for k in range(len(FEATURES))]
        back = F.array(*parts)
    else:
        back = unscaled(prediction, F.get("low", F.lit(0)), F.get("high", F.lit(0)))
    return _labelled(windows.select("symbol", "window", "date", back.alias("prediction"), F.col("y").alias("actual")), category)


def predict_one_ahead(
    model: PipelineModel | AveragedModel, test: DataFrame, category: str = "close", length: int = WINDOW_LENGTH
) -> DataFrame:
    """Predicted and actual value of one category, from test blocks of that category."""
    wanted = Category.of(category)
    if wanted is Category.ALL:
        raise ValueError("use predict_all for all features")
    if isinstance(model, AveragedModel):
        return _labelled(model.transform(test), wanted)
    windows = window_features(unfold_windows(test, length))
    return _in_units(model.transform(windows), F.col("prediction"), wanted)


def predict_all(
    models: Mapping[str, PipelineModel] | AveragedModel, test: DataFrame, length: int = WINDOW_LENGTH
) -> DataFrame:
    """Predicted and actual values of the five features as arrays, from test blocks of category ALL.

    ``models`` is one averaged model with five outputs, or one forecaster per feature.
    """
    if isinstance(models, AveragedModel):
        return _labelled(models.transform(test), Category.ALL)
    scored = window_features(unfold_windows(test, length))
    for name in FEATURES:
        scored = models[name].transform(scored).withColumnRenamed("prediction", f"_{name}")
    return _in_units(scored, F.array(*[F.col(f"_{name}") for name in FEATURES]), Category.ALL)


def persistence_forecast(test: DataFrame, category: str = "close", length: int = WINDOW_LENGTH) -> DataFrame:
    """The last bar of the window taken as the forecast: the yardstick for every model."""
    wanted = Category.of(category)
    last = F.element_at("x", -1)
    guess = last if wanted is Category.ALL else F.get(last, F.lit(FEATURES.index(wanted.value)))
    return _in_units(unfold_windows(test, length), guess, wanted)


def prediction_series(predictions: DataFrame) -> DataFrame:
    """Chart data in long form: ``symbol, window, series, value``."""
    return predictions.select("symbol", "window", "prediction", "actual").unpivot(
        ["symbol", "window"], ["prediction", "actual"], "series", "value"
    )
