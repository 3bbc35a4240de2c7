"""Point-in-time membership from stints ``(stock, in_date, out_date)``; both ends belong to a stint, NULL is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(dt: Column) -> Column:
    return (F.col("in_date") <= dt) & (F.col("out_date").isNull() | (F.col("out_date") >= dt))


def members_asof(stints: DataFrame, date: str) -> DataFrame:
    return stints.where(within(F.lit(date).cast("date"))).select("stock").distinct()


def member_mask(stocks: DataFrame, stints: DataFrame, date: str) -> DataFrame:
    """``(stock, is_member)`` for each of ``stocks``."""
    inside = members_asof(stints, date).withColumn("in", F.lit(True))
    return stocks.select("stock").distinct().join(inside, "stock", "left").select("stock", F.col("in").isNotNull().alias("is_member"))


def members_both_ends(stints: DataFrame, start: str, end: str) -> DataFrame:
    """Stocks with a stint that covers both dates."""
    return stints.where(within(F.lit(start).cast("date")) & within(F.lit(end).cast("date"))).select("stock").distinct()


def members_overlap(stints: DataFrame, start: str, end: str) -> DataFrame:
    """Stocks with a stint on any date of the range."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return stints.where((F.col("in_date") <= b) & (F.col("out_date").isNull() | (F.col("out_date") >= a))).select("stock").distinct()


def filter_members(panel: DataFrame, stints: DataFrame) -> DataFrame:
    """Rows of members on their date.  The key is the stock, the dates are a residual condition, so it is a hash join."""
    m = stints.select(F.col("stock").alias("m_stock"), "in_date", "out_date")
    return panel.join(m, (F.col("stock") == F.col("m_stock")) & within(F.col("dt")), "left_semi")


def member_matrix(stints: DataFrame, calendar: DataFrame) -> DataFrame:
    """``(stock, dt, is_member)`` for each stock that ever was a member and each date of ``calendar``.

    The grid is the result itself, so it is made by giving each stock the list of dates (one row a date).
    """
    dates = calendar.select("dt").distinct().agg(F.sort_array(F.collect_list("dt")).alias("dates"))
    held = stints.groupBy("stock").agg(F.collect_list(F.struct("in_date", "out_date")).alias("stints"))
    grid = held.join(F.broadcast(dates)).select("stock", F.explode("dates").alias("dt"), "stints")
    inside = F.exists("stints", lambda s: (s["in_date"] <= F.col("dt")) & (s["out_date"].isNull() | (s["out_date"] >= F.col("dt"))))
    return grid.select("stock", "dt", inside.alias("is_member"))


def mask_nonmembers(panel: DataFrame, stints: DataFrame, *values: str) -> DataFrame:
    """Values of stocks that aren't members on the date become NULL."""
    inside = filter_members(panel.select("stock", "dt"), stints).distinct().withColumn("in", F.lit(True))
    return panel.join(inside, ["stock", "dt"], "left").withColumns({v: F.when(F.col("in"), F.col(v)) for v in values}).drop("in")


def universe(stints: DataFrame, end: str) -> DataFrame:
    """Stocks that ever were a member and entered up to ``end``."""
    return stints.where(F.col("in_date") <= F.lit(end).cast("date")).select("stock").distinct()
