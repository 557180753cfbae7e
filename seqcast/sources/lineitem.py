"""Bars derived from the order tables, one per supplier or brand and ship day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqcast.schema import BAR_COLUMNS


def bars_from_lineitem(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """A line's price is a trade and its order key the time of day.

    Open and close are the prices of the least and the greatest (order key,
    price) of the day. The two are packed into one decimal, order key in front
    and price behind with four decimals: decimals can be updated in place, so
    the aggregate is a hash aggregate with map-side combine. A struct as the
    ordering would make it sort its whole input first.
    """
    if by not in ("supplier", "brand"):
        raise ValueError("by must be supplier or brand")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if by == "brand":
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        owner, symbol = F.col("p_brand"), F.col("owner")
    else:
        owner, symbol = F.col("l_suppkey"), F.concat(F.lit("S"), F.col("owner"))
    price = F.col("l_extendedprice")
    trade = F.expr("cast(l_orderkey as decimal(19, 0)) * 1000000000000000BD + cast(l_extendedprice as decimal(15, 4))")
    return (
        lines.select(
            owner.alias("owner"),
            F.to_date("l_shipdate").alias("date"),
            trade.alias("trade"),
            price.alias("price"),
            F.col("l_quantity").alias("quantity"),
        )
        .groupBy("owner", "date")
        .agg(
            F.min_by("price", "trade").alias("open"),
            F.max_by("price", "trade").alias("close"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
            F.sum("quantity").alias("volume"),
        )
        .withColumn("symbol", symbol)
        .select(*BAR_COLUMNS)
    )
