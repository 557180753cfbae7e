"""Sliding windows over the train and the test part of every series.

Windows are cut from *blocks*. A block is one row that holds the bars of up to
``block_size`` consecutive window starts of one symbol, plus the ``length``
bars the last of them reaches into. It is built by one aggregate on
``(symbol, block)``, so its size is fixed whatever the length of the series,
and a hot symbol is spread over many tasks. Blocks repeat ``length`` bars per
``block_size``; windows repeat every bar ``length`` times, and are therefore
unfolded last, and not at all where a consumer can slide over a block itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqcast.functions.columns import target_column, window_count
from seqcast.operators.scale import ranged_series, scaled_feature
from seqcast.schema import BLOCK_SIZE, FEATURES, TRAIN_RATIO, WINDOW_LENGTH, Category
from seqcast.session import new_table_folder

PARTS = ("train", "test")


def _scaled_features() -> Column:
    return F.array(*[scaled_feature(name) for name in FEATURES])


def _scaled_target(category: Category) -> Column:
    return _scaled_features() if category is Category.ALL else scaled_feature(category.value)


def _cut(
    bars: DataFrame,
    parts: tuple[str, ...],
    length: int,
    ratio: float,
    category: str,
    block_size: int,
    stats_scope: str,
) -> DataFrame:
    """Blocks of one or both parts, numbered and gathered in one pass, with the columns of a test block and ``part``."""
    if not set(parts) <= set(PARTS):
        raise ValueError(f"part must be one of {PARTS}")
    if length < 1:
        raise ValueError("length must be at least 1")
    if block_size < length:
        raise ValueError("block_size must not be less than length")
    wanted = Category.of(category)

    rows = F.when(F.col("part") == "train", F.col("split")).otherwise(F.col("n") - F.col("split"))
    needed = ranged_series(bars, stats_scope, ratio)
    if len(parts) == 1:
        needed = needed.where(F.col("part") == parts[0])
    needed = needed.withColumn("windows", window_count(rows, length))
    needed = needed.where((F.col("windows") > 0) & (F.col("j") < F.col("windows") + length))

    target = F.when(F.col("part") == "train", _scaled_target(wanted)).otherwise(target_column(wanted))
    bar = F.struct("j", _scaled_features().alias("x"), target.alias("y"), "date")
    ranges = F.struct(*[F.array(*[F.col(f"{tag}_{f}") for f in wanted.features]).alias(name) for tag, name in (("min", "low"), ("max", "high"))])

    home = F.expr(f"j div {block_size}")
    reaches_back = (F.col("j") >= block_size) & (F.col("j") % block_size < length)
    owners = F.when(reaches_back, F.array(home - 1, home)).otherwise(F.array(home))
    spread = (
        needed.select("symbol", "part", "windows", bar.alias("bar"), ranges.alias("ranges"), F.explode(owners).alias("block"))
        .where(F.col("block") * block_size < F.col("windows"))
        .groupBy("symbol", "part", "block")
        .agg(
            F.max("windows").alias("windows"),
            F.any_value("ranges").alias("ranges"),  # the same in every bar of a symbol
            F.sort_array(F.collect_list("bar")).alias("bars"),
        )
    )
    start = F.col("block") * block_size
    return spread.select(
        "symbol",
        "part",
        "block",
        start.alias("start"),
        F.least(F.lit(block_size), F.col("windows") - start).cast("int").alias("m"),
        *[F.col(f"bars.{name}").alias(name) for name in ("x", "y", "date")],
        "ranges.low",
        "ranges.high",
    )


def _columns_of(blocks: DataFrame, part: str) -> DataFrame:
    own = blocks.where(F.col("part") == part).drop("part")
    return own.drop("date", "low", "high") if part == "train" else own


def both_blocks(
    bars: DataFrame,
    length: int = WINDOW_LENGTH,
    ratio: float = TRAIN_RATIO,
    category: str = "close",
    block_size: int = BLOCK_SIZE,
    stats_scope: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """Train and test blocks of every series, from one pass over the bars.

    The blocks of both parts are written once to the shared folder, by part,
    and read from there.
    """
    path = new_table_folder(bars.sparkSession, "blocks")
    blocks = _cut(bars, PARTS, length, ratio, category, block_size, stats_scope)
    blocks.write.partitionBy("part").parquet(path)
    stored = bars.sparkSession.read.schema(blocks.schema).parquet(path)
    return _columns_of(stored, "train"), _columns_of(stored, "test")


def window_blocks(
    bars: DataFrame,
    part: str,
    length: int = WINDOW_LENGTH,
    ratio: float = TRAIN_RATIO,
    category: str = "close",
    block_size: int = BLOCK_SIZE,
    stats_scope: str = "all",
) -> DataFrame:
    """Blocks of the train or the test part.

    ``symbol, block, start, m, x, y``: ``start`` is the position of the first
    window in the part, ``m`` the number of windows, ``x`` the scaled features
    and ``y`` the target of every bar of the block. The target is scaled in the
    train part and raw in the test part. Test blocks also have the ``date`` of
    every bar, and ``low`` and ``high``, the ranges of the target, so that a
    forecast is brought back to its units without a join.
    """
    if part not in PARTS:
        raise ValueError(f"part must be one of {PARTS}")
    return _columns_of(_cut(bars, (part,), length, ratio, category, block_size, stats_scope), part)


def unfold_windows(blocks: DataFrame, length: int = WINDOW_LENGTH) -> DataFrame:
    """One row per window of the blocks.

    Train blocks give ``symbol, i, x, y``, where ``y`` holds the target of the
    next bar for each of the ``length`` steps. Test blocks give ``symbol,
    window, date, x, y, low, high``, where ``date`` and ``y`` belong to the bar
    after the window.
    """
    each = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("s"))
    position = F.col("start") + F.col("s")
    x = F.slice("x", F.col("s") + 1, F.lit(length)).alias("x")
    if "date" not in blocks.columns:
        return each.select("symbol", position.alias("i"), x, F.slice("y", F.col("s") + 2, F.lit(length)).alias("y"))
    following = F.col("s") + length
    return each.select(
        "symbol",
        position.alias("window"),
        F.get("date", following).alias("date"),
        x,
        F.get("y", following).alias("y"),
        "low",
        "high",
    )


def make_windows(
    bars: DataFrame,
    length: int = WINDOW_LENGTH,
    ratio: float = TRAIN_RATIO,
    category: str = "close",
    block_size: int = BLOCK_SIZE,
    stats_scope: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """Train and test windows of every series; the block size does not change them."""
    train, test = (unfold_windows(b, length) for b in both_blocks(bars, length, ratio, category, block_size, stats_scope))
    return train, test.drop("low", "high")


def assign_batches(windows: DataFrame, size: int | Column) -> DataFrame:
    """Train windows with ``batch``, the number of the mini-batch they are handed out in."""
    if isinstance(size, int) and size < 1:
        raise ValueError("size must be at least 1")
    width = F.lit(size) if isinstance(size, int) else size
    return windows.withColumn("batch", F.floor(F.col("i") / width).cast("bigint"))
