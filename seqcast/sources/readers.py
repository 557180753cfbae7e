"""Bars and symbol lists from files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seqcast.operators.prep import cast_bars, select_symbols
from seqcast.schema import BAR_COLUMNS

# Positions of a per-symbol file: the close of a bar is the adjusted one.
SYMBOL_FILE_COLUMNS = ("date", "open", "high", "low", "unadjusted_close", "volume", "close")


def read_bars_csv(spark: SparkSession, path: str | list[str], on_bad: str = "drop", date_type: str = "date") -> DataFrame:
    """Bars of many symbols from CSV with the header names symbol, date, open, close, low, high, volume.

    Columns are matched by header name, whatever their order. The files of one
    path must have one header: a file with another ends the job. The paths of a
    list may differ. Everything is read as text first, so there is no schema
    inference over the data.
    """

    def one(place: str) -> DataFrame:
        names = spark.read.csv(place, header=True, inferSchema=False).columns
        text = T.StructType([T.StructField(name, T.StringType()) for name in names])
        # Without enforceSchema every file's header is held against these names.
        return spark.read.schema(text).csv(place, header=True, enforceSchema=False).select(*BAR_COLUMNS)

    raw = reduce(DataFrame.unionByName, [one(place) for place in ([path] if isinstance(path, str) else path)])
    return cast_bars(raw, on_bad, date_type)


def read_symbol_files(
    spark: SparkSession,
    directory: str,
    symbols: Iterable[str] | DataFrame | None = None,
    on_bad: str = "drop",
    date_type: str = "date",
) -> DataFrame:
    """Bars from one CSV file per symbol, the file name being the symbol.

    One scan covers all files. A list of names reads only these files and fails
    on a missing one. A table of names, however long, is joined with the table
    of files (:func:`symbol_files`), and only the files of both are opened; names
    without a file give no bars. The driver holds the paths of the files that
    are read, as it does for every scan.
    """
    text = T.StructType([T.StructField(name, T.StringType()) for name in SYMBOL_FILE_COLUMNS])
    base = directory.rstrip("/")
    listed = symbols is not None and not isinstance(symbols, DataFrame)
    paths = [f"{base}/{name}.csv" for name in symbols] if listed else f"{base}/*.csv"
    if isinstance(symbols, DataFrame):
        # In one job: an iterator over the partitions would run one for each few files.
        paths = select_symbols(symbol_files(spark, directory), symbols).select("path").toArrow().column(0).to_pylist()
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    raw = _listed_csv(spark, text, paths) if paths else spark.createDataFrame([], text)
    named = raw.withColumn("symbol", symbol if paths else F.lit(""))
    return cast_bars(named, on_bad, date_type)


def _listed_csv(spark: SparkSession, text: T.StructType, paths: str | list[str]) -> DataFrame:
    """A scan of these files, which a few tasks for each core look up; left to itself, Spark takes a task for each path."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(text).csv(paths, header=True)
    finally:
        spark.conf.set(name, before)


def symbol_files(spark: SparkSession, directory: str) -> DataFrame:
    """``symbol, path, length`` of the files named by symbol; none of them is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
    return files.select(F.regexp_extract("path", r"([^/]*)\.csv$", 1).alias("symbol"), "path", "length")


def read_symbol_folders(
    spark: SparkSession, directory: str, symbols: DataFrame | None = None, on_bad: str = "drop", date_type: str = "date"
) -> DataFrame:
    """Bars from folders ``symbol=<name>`` of CSV files in the positions of a per-symbol file.

    The symbol is a partition column: a join with a table of wanted symbols
    prunes folders at run time, however long the table.
    """
    text = T.StructType([T.StructField(name, T.StringType()) for name in (*SYMBOL_FILE_COLUMNS, "symbol")])
    raw = spark.read.schema(text).csv(directory, header=True)
    if symbols is not None:
        raw = raw.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return cast_bars(raw, on_bad, date_type)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbol list from text, one symbol per line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("symbol")).where(F.col("symbol") != "").distinct()
