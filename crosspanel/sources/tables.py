"""Panels and companion tables from transaction, order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.stats import history

#: Added to the market value below turnover; in units of market value, not a negligible number.
MV_EPS = 1e8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(trades: DataFrame, stock: str, dt, price, volume, amount, order: list[str]) -> DataFrame:
    """Open, high, low, close, volume and amount by stock and date, in one aggregation with map-side combine."""
    rows = trades.select(F.col(stock).alias("stock"), dt.alias("dt"), price.alias("px"), volume.alias("qty"), amount.alias("amt"), F.struct(*order).alias("at"))
    return rows.groupBy("stock", "dt").agg(
        F.min_by("px", "at").alias("open_price"),
        F.max("px").alias("high_price"),
        F.min("px").alias("low_price"),
        F.max_by("px", "at").alias("close_price"),
        F.sum("qty").alias("volume"),
        F.round(F.sum("amt"), 2).alias("amount"),
    )


def trade_bars(spark: SparkSession, sf_dir: str, grain: str = "month", since: str | None = None, until: str | None = None, dealt: bool = False) -> DataFrame:
    """Bars of each supplier from its line items; of ship dates from ``since`` on and before ``until``, which reaches the scan.

    ``dealt`` deals the line items by supplier first, so steps by stock that follow need no exchange of their own.  Where a bar
    has few rows, as those of short periods, these are smaller than what map-side combine would make of them.
    """
    dt = F.to_date(F.date_trunc(grain, F.to_date("l_shipdate")))
    items = table(spark, sf_dir, "lineitem")
    if since:
        items = items.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp"))
    if until:
        items = items.where(F.col("l_shipdate") < F.lit(until).cast("timestamp"))
    if dealt:
        items = items.select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey").repartition("l_suppkey")
    return bars(items, "l_suppkey", dt, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user from the values of its events."""
    return bars(table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), F.col("value"), F.lit(1.0), F.col("value"), ["ts", "event_id"])


def market_index(panel: DataFrame) -> DataFrame:
    """``(dt, index_close, market_return)``: volume-weighted price of all stocks, and its change."""
    level = panel.groupBy("dt").agg((F.sum("amount") / F.sum("volume")).alias("index_close"))
    # one row a date: small whatever the number of stocks
    before = F.lag("index_close").over(history(F.lit(1)))
    return level.withColumn("market_return", F.try_divide(F.col("index_close"), before) - 1)


def market_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stock"), ((F.abs("s_acctbal") + 1000) * 1000).alias("total_mv"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stock, in_date, out_date)`` stints: open ones, closed ones and some that come back."""
    first = trade_bars(spark, sf_dir).groupBy("stock").agg(F.min("dt").alias("in_date"))
    out = F.when(F.col("stock") % 5 == 0, F.lit("1999-12-01").cast("date"))
    again = first.where(F.col("stock") % 10 == 0).select("stock", F.lit("2000-12-01").cast("date").alias("in_date"), F.lit(None).cast("date").alias("out_date"))
    return first.select("stock", "in_date", out.alias("out_date")).unionByName(again)


def prices(spark: SparkSession, sf_dir: str, grain: str = "month", dealt: bool = False) -> DataFrame:
    """The panel that factors are made of: repaired prices with market value and turnover, one row a stock and date."""
    from crosspanel.operators.preprocess import enrich, repaired, with_returns

    raw = trade_bars(spark, sf_dir, grain, dealt=dealt).withColumn("close_adj", 100 + F.ln("close_price")).withColumn("vwap", F.lit(None).cast("double"))
    return with_returns(enrich(repaired(raw), market_value(spark, sf_dir)))
