"""The registered queries: every operator on bars derived from the given tables.

Bars per brand serve as the common input, since their four prices differ most;
``by='supplier'`` gives ten times as many, shorter series.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqcast.functions.columns import target_column
from seqcast.operators import prep, scale, series, stats, windows
from seqcast.schema import FEATURES, Category
from seqcast.session import new_table_folder
from seqcast.sources.lineitem import bars_from_lineitem
from seqcast.sources.readers import SYMBOL_FILE_COLUMNS, read_bars_csv, read_symbol_files, read_symbol_folders, read_symbols
from seqcast.sources.writers import load_model, predictions_as_documents, save_model, write_predictions, write_symbol_files
from seqcast.training import predict
from seqcast.training.averaging import fit_averaged
from seqcast.training.forecaster import fit_forecaster, window_features
from seqcast.training.kernels import LinearKernel
from seqcast.training.maps import fit_least_squares, fit_linear_averaged

Query = Callable[..., DataFrame]
REGISTRY: dict[str, Query] = {}

def _query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _on_bars(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
        return operator(bars_from_lineitem(spark, sf_dir, by))

    run.__name__ = name
    _query(run)


def _supplier_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), "s_acctbal"
    )


def _spelled(name: str, values: str) -> list:
    """One column per feature of an array column."""
    return [F.get(F.col(values), F.lit(k)).alias(f"{name}_{f}") for k, f in enumerate(FEATURES)]


# --- bars, counts and ranges

_on_bars("bars", lambda bars: bars)
_on_bars("symbol_counts", stats.symbol_counts)
_on_bars("symbol_total", stats.symbol_total)
_on_bars("series_length", stats.series_length)
_on_bars("feature_ranges", stats.feature_ranges)
_on_bars("feature_ranges_global", partial(stats.feature_ranges, by=None))
_on_bars("minibatch_size", partial(stats.minibatch_size, batch_split=4))
_on_bars("window_counts", stats.window_counts)
_on_bars("preview", prep.preview)


@_query
def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_lineitem(spark, sf_dir, "supplier")


# --- projections, filters, joins


@_query
def cast_project(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Bars as text columns in another order, typed again."""
    bars = bars_from_lineitem(spark, sf_dir, by)
    return prep.cast_bars(bars.select(*[F.col(c).cast("string").alias(c) for c in reversed(bars.columns)]))


@_query
def bars_from_csv(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Bars written as CSV to the shared folder, in two folders with columns in different orders, and read from there."""
    path = new_table_folder(spark, "bars-csv")
    bars = bars_from_lineitem(spark, sf_dir, by)
    early = F.year("date") < 1995
    bars.where(early).write.csv(f"{path}/early", header=True)
    bars.where(~early).select(*reversed(bars.columns)).write.csv(f"{path}/late", header=True)
    return read_bars_csv(spark, [f"{path}/early", f"{path}/late"])


@_query
def bars_from_symbol_files(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Bars written as seven positional columns in a folder per symbol, and read by position from there."""
    path = new_table_folder(spark, "bars-by-symbol")
    bars = bars_from_lineitem(spark, sf_dir, by).withColumn("unadjusted_close", F.col("close") * 2)
    bars.select("symbol", *SYMBOL_FILE_COLUMNS).repartition("symbol", F.year("date")).write.partitionBy("symbol").csv(path, header=True)
    return read_symbol_folders(spark, path)


@_query
def bars_from_listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written to a file per supplier, and read from those of the suppliers with a positive balance alone."""
    path = new_table_folder(spark, "bars-files")
    write_symbol_files(bars_from_lineitem(spark, sf_dir, "supplier"), path)
    return read_symbol_files(spark, path, _supplier_symbols(spark, sf_dir).where(F.col("s_acctbal") > 0))


@_query
def listed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the symbols in a text file, which lists the large brands' parts one by one."""
    path = new_table_folder(spark, "symbols")
    spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_size") > 49).select("p_brand").write.text(path)
    return prep.select_symbols(bars_from_lineitem(spark, sf_dir, "brand"), read_symbols(spark, path))


@_query
def select_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of one symbol, the choice being the feature."""
    return prep.select_symbols(bars_from_lineitem(spark, sf_dir, "brand"), "Brand#13")


@_query
def symbol_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the suppliers with a positive balance."""
    listed = _supplier_symbols(spark, sf_dir).where(F.col("s_acctbal") > 0)
    return prep.select_symbols(bars_from_lineitem(spark, sf_dir, "supplier"), listed)


@_query
def missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed brands and suppliers without a bar of their own among the brand bars."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("symbol"))
    listed = _supplier_symbols(spark, sf_dir).select("symbol").unionByName(brands)
    return prep.missing_symbols(listed, bars_from_lineitem(spark, sf_dir, "brand"))


def _targets(bars: DataFrame) -> DataFrame:
    single = [target_column(c).alias(f"target_{c.value}") for c in Category if c is not Category.ALL]
    return bars.select("symbol", "date", *single, target_column("all").alias("every")).select(
        "symbol", "date", *[f"target_{f}" for f in FEATURES], *_spelled("all", "every")
    )


_on_bars("target_column", _targets)
_on_bars("drop_last_bars", partial(prep.drop_last_bars, k=1))


@_query
def union_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.union_bars(*[bars_from_lineitem(spark, sf_dir, by) for by in ("brand", "supplier")])


# --- positions and scaling

_on_bars("index_bars", lambda bars: series.index_bars(bars).select("symbol", "date", "i", "n"))
_on_bars(
    "chronological_split",
    lambda bars: series.chronological_split(bars).select("symbol", "date", "i", "n", "split", "part", "j"),
)


def _event_positions(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = events.select(F.col("event_type").alias("symbol"), F.col("ts").alias("date"), F.col("value").alias("close"), "event_id")
    return series.index_bars(bars, **settings).select("symbol", "event_id", "i", "n")


@_query
def intraday_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the microsecond in the order of each kind."""
    return _event_positions(spark, sf_dir)


@_query
def intraday_positions_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where an hour with more than six events counts as large."""
    return _event_positions(spark, sf_dir, bucket_bars=6)


_on_bars("minmax_symbol", scale.minmax_scale)
_on_bars("minmax_train_only", partial(scale.minmax_scale, stats_scope="train"))


@_query
def minmax_global(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    out = scale.minmax_scale_global(bars_from_lineitem(spark, sf_dir, by))
    values = vector_to_array("features")
    order = ("open", "low", "high", "volume", "close")
    return out.select("symbol", "date", *[F.round(values[k], 9).alias(f) for k, f in enumerate(order)])


def _close_there_and_back(bars: DataFrame) -> DataFrame:
    scaled = scale.minmax_scale(bars).select("symbol", "date", F.col("close").alias("prediction"))
    return scale.inverse_scale(scaled, scale.training_ranges(bars), "close")


def _all_there_and_back(bars: DataFrame) -> DataFrame:
    scaled = scale.minmax_scale(bars).select("symbol", "date", F.array(*FEATURES).alias("prediction"))
    back = scale.inverse_scale_all(scaled, scale.training_ranges(bars))
    return back.select("symbol", "date", *_spelled("back", "prediction"))


_on_bars("inverse_scale", _close_there_and_back)
_on_bars("inverse_scale_all", _all_there_and_back)


# --- windows, one row per step


def _train_steps(train: DataFrame) -> DataFrame:
    steps = train.select("symbol", "i", F.posexplode(F.arrays_zip("x", "y")).alias("t", "step"))
    return steps.select("symbol", "i", F.col("t").cast("bigint").alias("t"), F.col("step.x").alias("x"), F.col("step.y").alias("y")).select(
        "symbol", "i", "t", *_spelled("x", "x"), "y"
    )


def _train_steps_all(train: DataFrame) -> DataFrame:
    return _train_steps(train).select("*", *_spelled("y", "y")).drop("y")


def _test_steps(test: DataFrame) -> DataFrame:
    return test.select("symbol", "window", "date", "y", F.posexplode("x").alias("t", "x")).select(
        "symbol", "window", "date", F.col("t").cast("bigint").alias("t"), *_spelled("x", "x"), "y"
    )


def _test_steps_all(test: DataFrame) -> DataFrame:
    return _test_steps(test).select("*", *_spelled("y", "y")).drop("y")


_on_bars("train_windows", lambda bars: _train_steps(windows.make_windows(bars)[0]))
_on_bars("train_windows_blocked", lambda bars: _train_steps(windows.make_windows(bars, block_size=64)[0]))
_on_bars("train_windows_all", lambda bars: _train_steps_all(windows.make_windows(bars, category="all")[0]))
_on_bars("test_windows", lambda bars: _test_steps(windows.make_windows(bars)[1]))
_on_bars("test_windows_blocked", lambda bars: _test_steps(windows.make_windows(bars, block_size=22)[1]))
_on_bars("test_windows_all", lambda bars: _test_steps_all(windows.make_windows(bars, category="all")[1]))
_on_bars(
    "assign_batches",
    lambda bars: windows.assign_batches(windows.make_windows(bars)[0], 64).select("symbol", "i", "batch"),
)


# --- forecasts that have a SQL equivalent


def _persistence(bars: DataFrame, category: str = "close") -> DataFrame:
    return predict.persistence_forecast(windows.window_blocks(bars, "test", category=category), category)


def _persistence_all(bars: DataFrame) -> DataFrame:
    out = _persistence(bars, "all")
    spelled = [*_spelled("prediction", "prediction"), *_spelled("actual", "actual")]
    return out.select("symbol", "window", "date", "category", *spelled)


def _monthly_history(bars: DataFrame) -> DataFrame:
    """A loss table as training leaves it, with months in the place of epochs."""
    scored = _persistence(bars).withColumn("epoch", (F.year("date") * 12 + F.month("date")).cast("bigint"))
    error = F.col("prediction") - F.col("actual")
    return scored.groupBy("symbol", "epoch").agg(F.round(F.avg(error * error), 2).alias("loss"))


_on_bars("persistence_forecast", _persistence)
_on_bars("persistence_forecast_all", _persistence_all)
_on_bars("mean_loss", lambda bars: stats.mean_loss(_persistence(bars)).withColumn("loss", F.round("loss", 2)))
_on_bars("best_epoch", lambda bars: stats.best_epoch(_monthly_history(bars)))
_on_bars("value_bounds", lambda bars: stats.value_bounds(_persistence(bars)))
_on_bars("value_bounds_global", lambda bars: stats.value_bounds(_persistence(bars), by=None))
_on_bars("prediction_series", lambda bars: predict.prediction_series(_persistence(bars)))


@_query
def documents(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The points of the JSON documents, one row each."""
    pages = predictions_as_documents(_persistence(bars_from_lineitem(spark, sf_dir, by)), page_size=100)
    shape = "window array<bigint>, result map<string, array<double>>"
    read = pages.select("symbol", "page", F.from_json("document", shape).alias("d"))
    points = F.arrays_zip(
        F.col("d.window").alias("window"), F.col("d.result.predict").alias("prediction"), F.col("d.result.actual").alias("actual")
    )
    return read.select("symbol", "page", F.inline(points))


@_query
def documents_all(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The points of the JSON documents of all features, one row each."""
    pages = predictions_as_documents(_persistence(bars_from_lineitem(spark, sf_dir, by), "all"), page_size=100)
    shape = "window array<bigint>, result map<string, array<array<double>>>"
    read = pages.select("symbol", "page", F.from_json("document", shape).alias("d"))
    points = F.arrays_zip(
        F.col("d.window").alias("window"), F.col("d.result.predict").alias("prediction"), F.col("d.result.actual").alias("actual")
    )
    spelled = [*_spelled("prediction", "prediction"), *_spelled("actual", "actual")]
    return read.select("symbol", "page", F.inline(points)).select("symbol", "page", "window", *spelled)


@_query
def written_predictions(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Predictions written by symbol to the shared folder and read from there."""
    path = new_table_folder(spark, "predictions")
    write_predictions(_persistence(bars_from_lineitem(spark, sf_dir, by)), path)
    shape = "window bigint, date date, category string, prediction double, actual double, symbol string"
    return spark.read.schema(shape).parquet(path)


@_query
def weighted_param_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers per brand, known to each supplier from its own lines, averaged by lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    workers = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), "l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(F.min("l_extendedprice"), F.max("l_extendedprice"), F.sum("l_quantity")).alias("values"),
        )
    )
    long = workers.select("symbol", "n", F.posexplode("values").alias("k", "v"))
    return stats.weighted_param_average(long).select("symbol", "k", F.round("v", 6).alias("v"))


# --- trained forecasts

# One step from zero weights over whole blocks: the average over the workers is
# the full gradient, which SQL can state.
ONE_ROUND = dict(averaging_frequency=1, batch_size=512, max_epochs=1)


@_query
def averaged_round(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Weights after one round of parameter averaging with the linear kernel."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    model, _ = fit_averaged(blocks, LinearKernel(), **ONE_ROUND)
    return _weights(model)


@_query
def training_history(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Losses of the weights of that round over all train and all test windows."""
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by))
    _, history = fit_averaged(train, LinearKernel(), holdout=test, **ONE_ROUND)
    return history.select("symbol", "epoch", *[F.round(c, 9).alias(c) for c in ("train_loss", "test_loss")])


@_query
def averaged_round_joined(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The same round with the weights joined to the units, as beyond the limit of the broadcast, from a start of its own."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    first, _ = fit_averaged(blocks, LinearKernel(), **ONE_ROUND)
    model, _ = fit_averaged(blocks, LinearKernel(), start=first, broadcast_bytes=0, **ONE_ROUND)
    return _weights(model)


# One round to an epoch, and a step that is too long for some series, which stop early.
FOUR_EPOCHS = dict(averaging_frequency=1, batch_size=512, max_epochs=4, patience=1)
LONG_STEP = 0.04


def _losses(history: DataFrame) -> DataFrame:
    return history.select("symbol", "epoch", *[F.round(c, 9).alias(c) for c in ("train_loss", "test_loss")])


@_query
def early_stopping(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Losses of up to four epochs; a model stops once its held-out loss does not improve."""
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by))
    return _losses(fit_averaged(train, LinearKernel(learning_rate=LONG_STEP), holdout=test, **FOUR_EPOCHS)[1])


@_query
def early_stopping_by_maps(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The same from one pass over the blocks."""
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by))
    return _losses(fit_linear_averaged(train, LinearKernel(learning_rate=LONG_STEP), holdout=test, **FOUR_EPOCHS)[1])


@_query
def best_epoch_weights(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The weights that early stopping keeps: those of the epoch with the least held-out loss."""
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by))
    model, _ = fit_averaged(train, LinearKernel(learning_rate=LONG_STEP), holdout=test, **FOUR_EPOCHS)
    return _weights(model)


TWO_ROUNDS = dict(averaging_frequency=1, batch_size=256, max_epochs=2)


def _round_losses(model) -> DataFrame:
    return model.rounds.select("symbol", "epoch", "round", F.round("loss", 9).alias("loss"))


@_query
def round_history(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Loss of every round of two epochs, over the windows of the round."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    return _round_losses(fit_averaged(blocks, LinearKernel(), track_rounds=True, **TWO_ROUNDS)[0])


@_query
def round_history_by_maps(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The same from one pass over the blocks."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    return _round_losses(fit_linear_averaged(blocks, LinearKernel(), **TWO_ROUNDS)[0])


@_query
def continued_updater(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Two rounds with running mean squares of the slopes, the model saved and loaded between them: weights and running squares."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    kernel = LinearKernel(updater="rmsprop")
    first, _ = fit_averaged(blocks, kernel, **ONE_ROUND)
    model, _ = fit_averaged(blocks, kernel, start=_reloaded(spark, first), **ONE_ROUND)
    return _weights(model)


def _weights(model) -> DataFrame:
    weights = model.states.select("symbol", F.posexplode("state").alias("k", "v"))
    return weights.select("symbol", F.col("k").cast("bigint").alias("k"), F.round("v", 9).alias("v"))


@_query
def averaged_round_sized(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The same round with mini-batches of each symbol's own size, which here is not less than a block."""
    bars = bars_from_lineitem(spark, sf_dir, by)
    sizes = stats.minibatch_size(bars, batch_split=1)
    model, _ = fit_averaged(windows.window_blocks(bars, "train"), LinearKernel(), **{**ONE_ROUND, "batch_size": sizes})
    return _weights(model)


@_query
def continued_round(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """A second round, begun from the saved and loaded weights of the first."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    model, _ = fit_averaged(blocks, LinearKernel(), start=_reloaded(spark, fit_averaged(blocks, LinearKernel(), **ONE_ROUND)[0]), **ONE_ROUND)
    return _weights(model)


def _reloaded(spark: SparkSession, model):
    path = new_table_folder(spark, "model")
    save_model(model, path)
    return load_model(spark, path)


def _one_round_forecast(spark: SparkSession, sf_dir: str, by: str, reload: bool) -> DataFrame:
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by))
    model, _ = fit_averaged(train, LinearKernel(), **ONE_ROUND)
    out = predict.predict_one_ahead(_reloaded(spark, model) if reload else model, test)
    return out.withColumn("prediction", F.round("prediction", 2))


@_query
def one_round_forecast(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Forecast of the model after one round."""
    return _one_round_forecast(spark, sf_dir, by, reload=False)


@_query
def reloaded_forecast(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """The same with the model saved and loaded in between."""
    return _one_round_forecast(spark, sf_dir, by, reload=True)


@_query
def one_round_forecast_all(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Forecast of all features by the model after one round."""
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by), category="all")
    model, _ = fit_averaged(train, LinearKernel("all"), **ONE_ROUND)
    out = predict.predict_all(model, test)
    spelled = [F.round(F.get("prediction", F.lit(k)), 2).alias(f"prediction_{f}") for k, f in enumerate(FEATURES)]
    return out.select("symbol", "window", "date", "category", *spelled, *_spelled("actual", "actual"))


@_query
def linear_gradient(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Slope of the ridge objective at the fitted linear model: zero for every coefficient and the intercept."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    fitted = fit_forecaster(blocks, "linear", standardization=False, solver="normal")
    rows = window_features(windows.unfold_windows(blocks)).withColumn("label", F.element_at("y", -1))
    error = F.col("prediction") - F.col("label")
    scored = fitted.transform(rows).select(error.alias("error"), F.posexplode(F.concat(F.flatten("x"), F.array(F.lit(1.0)))).alias("k", "v"))
    line = fitted.stages[-1]
    weights = F.array(*[F.lit(float(w)) for w in line.coefficients], F.lit(0.0))
    # The learner divides its penalty by the spread of the label.
    penalty = line.getRegParam() / rows.agg(F.stddev("label")).first()[0]
    slope = F.avg(F.col("error") * F.col("v")) + penalty * F.get(weights, F.col("k"))
    return scored.groupBy("k").agg(slope.alias("slope")).select(F.col("k").cast("bigint").alias("k"), F.round(F.abs("slope"), 9).alias("slope"))


@_query
def linear_per_symbol(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Slope of every symbol's own ridge objective at its fitted model: zero for every coefficient and the intercept."""
    blocks = windows.window_blocks(bars_from_lineitem(spark, sf_dir, by), "train")
    model = fit_least_squares(blocks)
    weights = model.states.select("symbol", "state")
    rows = windows.unfold_windows(blocks).select("symbol", F.concat(F.flatten("x"), F.array(F.lit(1.0))).alias("x"), F.element_at("y", -1).alias("y"))
    fitted = F.aggregate(F.zip_with("x", "state", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    errors = rows.join(weights, "symbol").select("symbol", "state", "x", (fitted - F.col("y")).alias("error"))
    pulls = array_to_vector(F.transform("x", lambda v: v * F.col("error")))
    means = errors.groupBy("symbol").agg(F.any_value("state").alias("state"), vector_to_array(Summarizer.mean(pulls)).alias("pull"))
    penalty = F.when(F.col("k") < model.kernel.inputs, model.kernel.l2 * F.get("state", F.col("k"))).otherwise(0.0)
    slopes = means.select("symbol", "state", F.posexplode("pull").alias("k", "v")).select("symbol", "k", (F.col("v") + penalty).alias("slope"))
    return slopes.select("symbol", F.col("k").cast("bigint").alias("k"), F.round(F.abs("slope"), 9).alias("slope"))


@_query
def least_squares_forecast(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Forecast of every symbol's own least-squares model."""
    train, test = windows.both_blocks(bars_from_lineitem(spark, sf_dir, by))
    return predict.predict_one_ahead(fit_least_squares(train), test)


def _forecast(bars: DataFrame, algo: str, **params) -> DataFrame:
    train, test = windows.both_blocks(bars)
    return predict.predict_one_ahead(fit_forecaster(train, algo, **params), test)


_on_bars("linear_forecast", lambda bars: _forecast(bars, "linear"))
_on_bars("tree_forecast", lambda bars: _forecast(bars, "gbt", seed=12345))


def _averaged(bars: DataFrame, kernel, category: str, **settings) -> DataFrame:
    train, test = windows.both_blocks(bars, category=category)
    model, _ = fit_linear_averaged(train, kernel, holdout=test, **settings)
    if category == "all":
        return predict.predict_all(model, test)
    return predict.predict_one_ahead(model, test, category)


_on_bars("averaged_forecast", lambda bars: _averaged(bars, LinearKernel(), "close"))


def _all_features(bars: DataFrame) -> DataFrame:
    out = _averaged(bars, LinearKernel("all"), "all", per_symbol=False)
    spelled = [*_spelled("prediction", "prediction"), *_spelled("actual", "actual")]
    return out.select("symbol", "window", "date", "category", *spelled)


_on_bars("all_feature_forecast", _all_features)
