"""Positions in a series, and the train/test split.

A symbol may hold a large share of all bars, so no window here is partitioned
by symbol alone over the bars. Bars are numbered inside a calendar bucket (a
year of daily bars, an hour of intraday bars). A small table with one row per
symbol and bucket, made by a partial and final aggregate, carries what a bar
must know of its whole series: how many bars come before the bucket, how many
there are in all, and the feature ranges. Bucket and symbol together are the
join key, so a hot symbol is spread over as many keys as it has buckets. Nothing
bounds the bars of an hour, so intraday buckets are counted, and those of more
than ``BUCKET_BARS`` are cut into slices by date and values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from seqcast.functions.columns import split_position
from seqcast.operators.skew import join_on_key
from seqcast.schema import FEATURES, TRAIN_RATIO
from seqcast.session import new_table_folder

BUCKET, SLICE, PART = "_bucket", "_slice", "_part"
# Bars of an intraday bucket that are numbered together, about.
BUCKET_BARS = 1 << 20
# Bars of large buckets that one partition cuts into slices, about.
PART_BARS = BUCKET_BARS // 2
# Buckets that the undated bars of a symbol are spread over.
UNDATED = 4096


def _undated(bars: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*[c for c in FEATURES if c in bars.columns]), F.lit(UNDATED))


def calendar_bucket(bars: DataFrame) -> Column:
    """Year of a daily bar, hour number of an intraday bar; one of ``UNDATED`` numbers below all others without a date.

    The bucket is never NULL: undated bars keep their place at the start of
    their series, spread by a hash of their values, and the joins on the bucket
    need no filter, which lets Spark reuse one shuffle of the bars for both of
    their sides.
    """
    kind = bars.schema["date"].dataType
    if isinstance(kind, T.DateType):
        return F.coalesce(F.year("date"), (_undated(bars) - 2**31).cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        hour = F.expr("unix_seconds(cast(date as timestamp)) div 3600")
        return F.coalesce(hour, _undated(bars) - 2**62)
    raise TypeError(f"date must be a date or a timestamp, not {kind.simpleString()}")


def with_bucket(bars: DataFrame, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Bars with their bucket, and a slice if some bucket is cut into slices; only intraday buckets are counted."""
    bucketed = bars.withColumn(BUCKET, calendar_bucket(bars))
    return bucketed if isinstance(bars.schema["date"].dataType, T.DateType) else _sliced(bucketed, bucket_bars)


def place_keys(bucketed: DataFrame) -> list[str]:
    """The columns inside whose values a bar's place is found."""
    return ["symbol", BUCKET, *([SLICE] if SLICE in bucketed.columns else [])]


def _sliced(bucketed: DataFrame, most: int) -> DataFrame:
    """The bars, those of buckets with more than ``most`` in slices of about half as many, in order.

    A range partitioning by date and values, which samples its bounds, cuts the
    bars into parts; they are written, so that a bar stays in its part. There
    are as many parts as the bars of large buckets need, however small a slice
    is; inside its part, a bucket is cut into slices by rank. Only bars that are
    alike in everything can't be told apart, and stay together.
    """
    spark = bucketed.sparkSession
    key = ["symbol", BUCKET]
    counts = bucketed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    path = new_table_folder(spark, "large-buckets")
    counts.write.parquet(path)
    large = spark.read.schema(counts.schema).parquet(path)
    bars = large.agg(F.sum("n")).first()[0]
    if not bars:
        return bucketed
    names = large.select(*key)
    values = [c for c in FEATURES if c in bucketed.columns]
    uneven = join_on_key(bucketed, names, key, "left_semi", large, ["date", *values])
    parts = max(-(-bars // PART_BARS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = uneven.repartitionByRange(min(-(-2 * bars // most), parts), *key, "date", *values)
    path = new_table_folder(spark, "slices")
    cut = ordered.withColumn(PART, F.spark_partition_id()).select(*bucketed.columns, PART)
    cut.write.parquet(path)
    inside = Window.partitionBy(*key, PART).orderBy("date", *values)
    nth = F.floor((F.rank().over(inside) - 1) / -(-most // 2)).cast("bigint")
    sliced = spark.read.schema(cut.schema).parquet(path).withColumn(SLICE, F.col(PART).cast("bigint") * 2**32 + nth).drop(PART)
    even = join_on_key(bucketed, names, key, "left_anti", large, ["date", *values])
    return even.withColumn(SLICE, F.lit(0).cast("bigint")).select(*sliced.columns).unionByName(sliced)


def series_facts(bucketed: DataFrame, features: Sequence[str] = (), ranged: Column | None = None) -> DataFrame:
    """Per symbol, bucket and slice: ``offset`` (bars before them), ``n`` (bars of the
    symbol) and ``min_<f>``, ``max_<f>`` over the whole series, or over its bars
    for which ``ranged`` holds.

    Only this table, whose size is symbols times buckets, is windowed by symbol.
    """
    ranges = [
        f(F.col(name) if ranged is None else F.when(ranged, F.col(name))).alias(f"{tag}_{name}")
        for name in features
        for tag, f in (("min", F.min), ("max", F.max))
    ]
    place = place_keys(bucketed)
    per_bucket = bucketed.groupBy(*place).agg(F.count(F.lit(1)).alias("_bars"), *ranges)
    series = Window.partitionBy("symbol")
    before = series.orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    whole = [
        f(f"{tag}_{name}").over(series).alias(f"{tag}_{name}")
        for name in features
        for tag, f in (("min", F.min), ("max", F.max))
    ]
    return per_bucket.select(
        *place,
        F.coalesce(F.sum("_bars").over(before), F.lit(0)).cast("bigint").alias("offset"),
        F.sum("_bars").over(series).cast("bigint").alias("n"),
        *whole,
    )


def number_bars(bars: DataFrame, features: Sequence[str] = (), keep_bucket: bool = False, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Bars with ``i``, ``n`` and, for the named features, the ranges of the symbol.

    Bars are ordered by date; equal dates by their values, so that a rerun of a
    lost task numbers them alike. The bars are shuffled and sorted once, and
    stay partitioned by symbol, bucket and slice; ``keep_bucket`` keeps these
    columns for a further join.
    """
    bucketed = with_bucket(bars, bucket_bars)
    place = place_keys(bucketed)
    inside = Window.partitionBy(*place).orderBy("date", *[c for c in FEATURES if c in bars.columns])
    # Stated, since bars that come partitioned by symbol alone would otherwise stay so.
    spread = bucketed.repartition(*place)
    placed = spread.withColumn("_place", F.row_number().over(inside))
    # Numbering first leaves the bars partitioned and sorted as the merge join wants them.
    joined = placed.join(series_facts(bucketed, features).hint("merge"), place)
    position = (F.col("offset") + F.col("_place") - 1).cast("bigint")
    extra = [f"{tag}_{name}" for name in features for tag in ("min", "max")]
    kept = place[1:] if keep_bucket else []
    return joined.select(*bars.columns, position.alias("i"), "n", *extra, *kept)


def join_facts(bucketed: DataFrame, facts: DataFrame) -> DataFrame:
    """Bars with the facts of their series.

    A shuffled hash join on symbol, bucket and slice: no sort of the bars, a hash
    table of one row per symbol and bucket of the same partition, and no key that
    holds more bars than a bucket.
    """
    return bucketed.join(facts.hint("shuffle_hash"), place_keys(bucketed))


def index_bars(bars: DataFrame, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Bars with their position ``i`` (from 0, by date) and the series length ``n``.

    Intraday buckets of more than ``bucket_bars`` are numbered in slices.
    """
    return number_bars(bars, bucket_bars=bucket_bars)


def split_columns(indexed: DataFrame, ratio: float = TRAIN_RATIO) -> DataFrame:
    """Adds ``split``, ``part`` and ``j``, the position inside the part, to indexed bars."""
    in_train = F.col("i") < F.col("split")
    return (
        indexed.withColumn("split", split_position(F.col("n"), ratio))
        .withColumn("part", F.when(in_train, F.lit("train")).otherwise(F.lit("test")))
        .withColumn("j", F.when(in_train, F.col("i")).otherwise(F.col("i") - F.col("split")))
    )


def chronological_split(bars: DataFrame, ratio: float = TRAIN_RATIO) -> DataFrame:
    """Bars with ``i``, ``n``, ``split``, ``part`` (train or test) and ``j``."""
    return split_columns(index_bars(bars), ratio)
