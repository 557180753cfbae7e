"""Min-max scaling per symbol and over the whole table, and its inverse."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from seqcast.functions.columns import scaled, unscaled
from seqcast.operators.series import BUCKET, SLICE, join_facts, number_bars, series_facts, split_columns
from seqcast.operators.skew import join_on_symbol
from seqcast.operators.stats import feature_ranges, series_length
from seqcast.schema import FEATURES, TRAIN_RATIO, VECTOR_FEATURES, Category
from seqcast.session import new_table_folder

SCOPES = ("all", "train")


def scaled_feature(name: str) -> Column:
    """A feature scaled with the range columns that stand beside it."""
    return scaled(F.col(name), F.col(f"min_{name}"), F.col(f"max_{name}"))


def _train_facts(parts: DataFrame) -> DataFrame:
    """Ranges of the train part, from split bars that kept their bucket."""
    return series_facts(parts, FEATURES, ranged=F.col("part") == "train").drop("offset", "n")


def _check_scope(stats_scope: str) -> None:
    if stats_scope not in SCOPES:
        raise ValueError(f"stats_scope must be one of {SCOPES}")


def ranged_series(bars: DataFrame, stats_scope: str = "all", ratio: float = TRAIN_RATIO) -> DataFrame:
    """Numbered and split bars with the ranges of their symbol.

    Over the whole series the ranges come with the numbering, in one join. Over
    the train part only, they need the split first and a second join.
    """
    _check_scope(stats_scope)
    if stats_scope == "all":
        return split_columns(number_bars(bars, FEATURES), ratio)
    parts = split_columns(number_bars(bars, keep_bucket=True), ratio)
    return join_facts(parts, _train_facts(parts)).drop(BUCKET, SLICE)


def training_ranges(bars: DataFrame, stats_scope: str = "all", ratio: float = TRAIN_RATIO) -> DataFrame:
    """The ranges :func:`minmax_scale` uses, one row per symbol, for the inverse.

    ``n`` are the bars of the symbol in the scope, by which joins with the
    ranges split what is hot. The table is written once and read from there.
    """
    _check_scope(stats_scope)
    scope = bars if stats_scope == "all" else split_columns(number_bars(bars), ratio).where(F.col("part") == "train")
    ranges = feature_ranges(scope, counted=True)
    path = new_table_folder(bars.sparkSession, "ranges")
    ranges.write.parquet(path)
    return bars.sparkSession.read.schema(ranges.schema).parquet(path)


def _with_ranges(rows: DataFrame, ranges: DataFrame, picked: DataFrame, spread_by: str) -> DataFrame:
    """Rows beside what is picked of the ranges; the bars of a symbol say how hot it is, where the ranges know them."""
    counts = ranges.select("symbol", "n") if "n" in ranges.columns else series_length(rows)
    return join_on_symbol(rows, picked, spread_by=spread_by, counts=counts)


def minmax_scale(bars: DataFrame, stats_scope: str = "all", ratio: float = TRAIN_RATIO) -> DataFrame:
    """Bars with every feature scaled by the range of its symbol.

    ``stats_scope='train'`` takes the ranges from the train part, so that test
    values may leave [0, 1] but nothing of the future is used.
    """
    _check_scope(stats_scope)
    # Only the ranges need positions; the bars meet one row per symbol, which Spark broadcasts where it finds it small.
    ranges = training_ranges(bars, stats_scope, ratio)
    ranged = _with_ranges(bars, ranges, ranges.drop("n"), "date")
    return ranged.select("symbol", "date", *[scaled_feature(name).alias(name) for name in FEATURES])


def minmax_scale_global(bars: DataFrame) -> DataFrame:
    """``symbol, date, features``: the vector of the features, scaled over the whole table.

    The fit is one aggregate whose single row of ranges comes to the driver.
    """
    ranges = feature_ranges(bars, by=None).first()
    values = [
        scaled(F.col(name), F.lit(ranges[f"min_{name}"]), F.lit(ranges[f"max_{name}"])) for name in VECTOR_FEATURES
    ]
    return bars.select("symbol", "date", array_to_vector(F.array(*values)).alias("features"))


def _spread_column(df: DataFrame, columns: tuple[str, ...]) -> str:
    return next(c for c in ("window", "i", "date", *columns) if c in df.columns)


def inverse_scale(df: DataFrame, ranges: DataFrame, category: str, columns: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """Scaled ``columns`` of one category back in the units of the feature."""
    name = Category.of(category).value
    picked = ranges.select("symbol", F.col(f"min_{name}").alias("_low"), F.col(f"max_{name}").alias("_high"))
    back = {c: unscaled(F.col(c), F.col("_low"), F.col("_high")) for c in columns}
    return _with_ranges(df, ranges, picked, _spread_column(df, columns)).withColumns(back).select(*df.columns)


def inverse_scale_all(df: DataFrame, ranges: DataFrame, columns: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """Scaled arrays of the five features back in their units, element by element."""
    limits = F.array(*[F.struct(F.col(f"min_{f}").alias("low"), F.col(f"max_{f}").alias("high")) for f in FEATURES])
    picked = ranges.select("symbol", limits.alias("_ranges"))
    back = {
        c: F.zip_with(F.col(c), F.col("_ranges"), lambda value, r: unscaled(value, r["low"], r["high"])) for c in columns
    }
    return _with_ranges(df, ranges, picked, _spread_column(df, columns)).withColumns(back).select(*df.columns)
