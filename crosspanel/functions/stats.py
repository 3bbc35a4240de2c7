"""Column expressions for panels of ``stock`` (entity) and ``dt`` (date).

Missing values are NULL.  A rolling window counts the entity's own rows, is NULL until it is full, and is NULL if a
value in it is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-8


def history(partition: str = "stock", order: str = "dt") -> WindowSpec:
    return Window.partitionBy(partition).orderBy(order)


def trailing(n: int) -> WindowSpec:
    """The entity's last ``n`` rows, the current one included."""
    return history().rowsBetween(1 - n, 0)


def cross_section(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "dt")


def roll(agg: Callable[[Column], Column], x: Column | str, n: int, at_least: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows where at least ``at_least`` (all, by default) hold a value."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(trailing(n)) >= (n if at_least is None else at_least), agg(x).over(trailing(n)))


def with_long_mean(panel: DataFrame, x: str, n: int, name: str, at_least: int = 1) -> DataFrame:
    """``panel`` with the mean of the last ``n`` rows' known values, from ``at_least`` of them on.

    A long window is the difference of two running sums, which cost one step a row instead of ``n``.
    """
    upto = history().rowsBetween(Window.unboundedPreceding, 0)
    df = panel.withColumns({"_s": F.coalesce(F.sum(x).over(upto), F.lit(0.0)), "_c": F.count(x).over(upto)})
    inside = {c: F.col(c) - F.coalesce(F.lag(c, n).over(history()), F.lit(0)) for c in ("_s", "_c")}
    return df.withColumns(inside).withColumn(name, F.when(F.col("_c") >= max(1, at_least), F.col("_s") / F.col("_c"))).drop("_s", "_c")


def deviation(x: Column | str, n: int) -> Column:
    """Relative distance of a value from its rolling mean."""
    x = F.col(x) if isinstance(x, str) else x
    mean = roll(F.avg, x, n)
    return (x - mean) / (mean + EPS)


def zscore(x: Column | str, over: WindowSpec, spread: Callable = F.stddev_samp) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return (x - F.avg(x).over(over)) / (spread(x).over(over) + EPS)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate; NULL without variance.  Rows where one side is missing don't count."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


def concordance(x: Column | str, y: Column | str) -> Column:
    """Lin's concordance correlation, population form."""
    return F.try_divide(2 * F.covar_pop(x, y), F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2))


def sample_skew(x: Column | str) -> Column:
    """Bias-adjusted skewness; NULL for fewer than three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def average_rank(x: Column | str, *by: str) -> Column:
    """Rank from 1 among the rows of ``by``, ties sharing their mean rank."""
    x = F.col(x) if isinstance(x, str) else x
    first = F.rank().over(Window.partitionBy(*by).orderBy(x)).cast("double")
    return first + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)).cast("double") - 1) / 2
