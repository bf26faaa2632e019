"""The driver's tables as domain objects: monthly bars by supplier, holdings by customer and quarter, ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(c):
    """Missing is null here: NaN and infinities become null when read."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, ticker, o, h, l, c, v, vw): one bar for each supplier and month with a shipment."""
    li = table(spark, sf_dir, "lineitem")
    price, at = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return li.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("t"), F.col("l_suppkey").alias("ticker")).agg(
        F.min_by(price, at).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, at).alias("c"),
        F.sum("l_quantity").alias("v"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vw"),
    )


def panel(bars: DataFrame) -> DataFrame:
    """Bars with ``bar_idx``, the place of their time in the calendar of all bars. The calendar is a small table of its
    own, so no row of the panel goes through a global sort."""
    calendar = bars.select("t").distinct().withColumn("bar_idx", (F.row_number().over(Window.orderBy("t")) - 1).cast("int"))
    return bars.join(calendar, "t")


def dense(bars: DataFrame) -> DataFrame:
    """Every ticker on every bar of the calendar; nulls where it has none."""
    calendar = bars.select("t", "bar_idx").distinct()
    tickers = bars.select("ticker").distinct()
    return tickers.crossJoin(calendar).join(bars, ["ticker", "t", "bar_idx"], "left")  # tickers x calendar is the result


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quarter, cik, ticker, shares, value_usd): customers hold part brands, by quarter of the order."""
    o, li, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    quarter = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    return joined.groupBy(quarter.alias("quarter"), F.col("o_custkey").alias("cik"), F.col("p_brand").alias("ticker")).agg(F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("value_usd"))
