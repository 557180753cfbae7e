"""Typing, projecting, filtering and combining bar tables."""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from seqcast.operators.series import index_bars
from seqcast.operators.skew import join_on_symbol
from seqcast.schema import BAR_COLUMNS, FEATURES

ON_BAD = ("drop", "null", "fail")
# Names of a list that are broadcast; more are joined, with the bars of hot symbols split.
BROADCAST_SYMBOLS = 200_000


def _typed(name: str, type_name: str, on_bad: str) -> Column:
    parsed = F.col(name).try_cast(type_name)
    if type_name == "double":  # NaN and infinities are no prices
        parsed = F.when(F.abs(parsed) < F.lit(float("inf")), parsed)
    if on_bad == "fail":
        message = F.concat(F.lit(f"cannot read {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL")))
        parsed = F.coalesce(parsed, F.raise_error(message).cast(type_name))
    return parsed.alias(name)


def cast_bars(df: DataFrame, on_bad: str = "drop", date_type: str = "date") -> DataFrame:
    """Text columns to typed bars, in the order symbol, date, open, close, low, high, volume.

    ``on_bad`` says what happens to a row with an unreadable field: it is
    dropped, kept with NULL, or ends the job. Numbers that aren't finite are
    unreadable. A bar belongs to a symbol: a row without one is dropped, or
    ends the job, but is never kept. ``date_type`` is ``date`` or ``timestamp``
    for intraday bars.
    """
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    typed = df.select(
        _typed("symbol", "string", on_bad),
        _typed("date", date_type, on_bad),
        *[_typed(name, "double", on_bad) for name in FEATURES],
    )
    return typed.dropna(subset=list(BAR_COLUMNS) if on_bad == "drop" else ["symbol"])


def select_symbols(bars: DataFrame, symbols: str | Iterable[str] | DataFrame) -> DataFrame:
    """Bars of the wanted symbols: one name, a few names, or a table with a ``symbol`` column.

    A table becomes a left semi join, whose list is broadcast if it is counted
    as short; else the bars of every symbol are counted too, and hot ones split.
    """
    if isinstance(symbols, DataFrame):
        listed = symbols.select("symbol").distinct()
        if listed.limit(BROADCAST_SYMBOLS + 1).count() <= BROADCAST_SYMBOLS:
            return bars.join(F.broadcast(listed), "symbol", "left_semi")
        return join_on_symbol(bars, listed, "left_semi").select(*bars.columns)
    if isinstance(symbols, str):
        return bars.where(F.col("symbol") == symbols)
    return bars.where(F.col("symbol").isin(list(symbols)))


def missing_symbols(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """Listed symbols without a single bar."""
    return symbols.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def drop_last_bars(bars: DataFrame, k: int = 0) -> DataFrame:
    """Bars without the newest ``k`` of every symbol."""
    if k < 0:
        raise ValueError("k must not be negative")
    if k == 0:
        return bars
    return index_bars(bars).where(F.col("i") < F.col("n") - k).select(*bars.columns)


def union_bars(*tables: DataFrame) -> DataFrame:
    """Several bar tables as one."""
    return reduce(DataFrame.unionByName, tables)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows by symbol and date, as a top-k query."""
    return df.orderBy("symbol", "date").limit(rows)
