"""Repair of prices, returns, joins of companion tables and the turnover rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.stats import cross_section, history
from crosspanel.sources.tables import MV_EPS


def repaired(raw: DataFrame) -> DataFrame:
    """``close_adj`` and ``vwap`` where they are missing, by their fallbacks."""
    return raw.withColumns(
        {
            "close_adj": F.coalesce("close_adj", "close_price"),
            "vwap": F.coalesce(F.col("vwap"), F.try_divide(F.col("amount"), F.col("volume") + 1e-10), F.col("close_price")),
        }
    )


def enrich(panel: DataFrame, market_value: DataFrame, mv_eps: float = MV_EPS) -> DataFrame:
    """Market value by stock, and turnover = amount / (market value + ``mv_eps``); 0 without market value, 0.05 without amount."""
    joined = panel.join(market_value, "stock", "left")
    rate = F.when(F.col("total_mv").isNull(), F.lit(0.0)).when(F.col("amount").isNull(), F.lit(0.05)).otherwise(F.col("amount") / (F.col("total_mv") + mv_eps))
    return joined.withColumn("turnover", rate)


def with_market(panel: DataFrame, index: DataFrame) -> DataFrame:
    return panel.join(index, "dt", "left")


def with_returns(panel: DataFrame, close: str = "close_adj") -> DataFrame:
    """``ret`` over the last known close before, and ``log_ret`` over the row before."""
    before = history().rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(close, ignorenulls=True).over(before)
    now = F.last(close, ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0))
    ratio = F.try_divide(F.col(close), F.lag(close).over(history()))
    return panel.withColumns({"ret": F.try_divide(now, held) - 1, "log_ret": F.ln(ratio)})


def mean_return(panel: DataFrame) -> DataFrame:
    """``xs_ret``: the mean return of the date, for where no market return is known."""
    return panel.withColumn("xs_ret", F.avg("ret").over(cross_section()))
