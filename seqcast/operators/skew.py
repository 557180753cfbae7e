"""Joins with a table of one row per key that stay even when one key holds much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: A key is hot from this share of all rows on (one in ``HOT``); so there are at most ``HOT`` hot keys, whatever the data.
HOT = 1024
SALTS = "_salts"


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """``*keys, _salts`` of the hot keys of a table with the rows ``n`` of every key.

    ``_salts`` says into how many keys a hot key must be cut to leave at most
    one in ``HOT`` of all rows in each. The table has at most ``HOT`` rows, and
    its salts add up to at most twice as many.
    """
    total = counts.agg(F.sum(n)).scalar()
    salts = F.ceil(F.col(n) * HOT / total).cast("int")
    return counts.where(F.col(n) * HOT > total).select(*keys, salts.alias(SALTS))


def join_on_key(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Joins ``rows`` with a table that has few rows per key, on the columns ``keys``.

    Hot keys alone are cut into salted keys, by the values of ``spread_by``, and
    only their rows of the table are repeated; all other keys join as they are.
    ``counts`` (``*keys, n``) are the rows of each key where the caller has them,
    else one aggregate with map-side combine counts them. The list of hot keys
    is broadcast, as its size has a bound; if Spark finds the table small enough
    to broadcast, it does that too, and nothing is shuffled. The join is an
    inner, left, left semi or left anti join.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    taken = {c.lower() for c in (*rows.columns, *table.columns)}
    salt, many = (next(name for k in range(len(taken) + 1) if (name := stem + "_" * k) not in taken) for stem in ("_salt", SALTS))
    hot = F.broadcast(hot_keys(counts, keys).withColumnRenamed(SALTS, many))
    salts = F.coalesce(many, F.lit(1))
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in spread_by or keys)), salts).cast("int")
    salted = rows.join(hot, list(keys), "left").withColumn(salt, spread).drop(many)
    each = F.explode(F.sequence(F.lit(0), salts - 1))
    repeated = table.join(hot, list(keys), "left").withColumn(salt, each).drop(many)
    return salted.join(repeated, [*keys, salt], how).drop(salt)


def join_on_symbol(rows: DataFrame, table: DataFrame, how: str = "inner", spread_by: str = "date", counts: DataFrame | None = None) -> DataFrame:
    """Joins ``rows`` with a table of one row per symbol; ``counts`` (``symbol, n``) if the caller has them."""
    return join_on_key(rows, table, ["symbol"], how, counts, [spread_by])
