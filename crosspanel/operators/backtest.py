"""Strategies on signals ``(signal, stock, dt, value)``: selection, net asset values, metrics, benchmarks, out of sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.evaluate import YEAR, calendar, held_return, layer_members, turnover_of
from crosspanel.sources.shared import written

PCTS = (0.05, 0.1, 0.2)


def top_pct(signals: DataFrame, pcts: tuple[float, ...] = (0.1,)) -> DataFrame:
    """``(signal, pct, dt, stock, weight)``: the best max(1, floor(N * pct)) names, ties to the smaller stock, equal weights."""
    by = Window.partitionBy("signal", "dt")
    ranked = signals.where(F.col("value").isNotNull()).select("signal", "dt", "stock", F.count(F.lit(1)).over(by).alias("n"), F.row_number().over(by.orderBy(F.col("value").desc(), "stock")).alias("k"))
    each = ranked.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in pcts])))
    size = F.greatest(F.lit(1), F.floor(F.col("n") * F.col("pct")).cast("int"))
    return each.withColumn("size", size).where(F.col("k") <= F.col("size")).select("signal", "pct", "dt", "stock", (1 / F.col("size")).alias("weight"))


def strategy_nav(weights: DataFrame, returns: DataFrame, days: DataFrame, *series: str, freq: int = 1, cost: float = 0.002) -> DataFrame:
    """``(series, dt, turnover, nav)`` from ``weights(series, dt, stock, weight)``.

    The value is 1.0 on the first date.  Every date earns the return of the weights held before it; then, on each
    ``freq``-th date, the weights change at ``cost`` for each unit of change.  Weights don't drift; a missing return is 0.
    """
    at = written(weights.join(F.broadcast(days), "dt").where(F.col("i") % freq == 0).select(*series, "i", "stock", "weight"), "weights")
    earned, change = held_return(at, returns, days, *series, delay=1), turnover_of(at, *series).where("i > 0")
    grid = at.select(*series).distinct().join(F.broadcast(days))
    line = grid.join(earned, [*series, "i"], "left").join(change, [*series, "i"], "left").fillna(0.0, ["r", "turnover"])
    growth = (1 + F.col("r")) * (1 - F.lit(cost) * F.col("turnover"))
    nav = F.product(growth).over(Window.partitionBy(*series).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return line.select(*series, "dt", "turnover", nav.alias("nav"))


def long_only(signals: DataFrame, returns: DataFrame, pcts: tuple[float, ...] = (0.1,), freq: int = 1, cost: float = 0.002) -> DataFrame:
    """All signals and percentages in one job."""
    return strategy_nav(top_pct(signals, pcts), returns, calendar(signals), "signal", "pct", freq=freq, cost=cost)


def layer5(signals: DataFrame, returns: DataFrame, freq: int = 1, cost: float = 0.002) -> DataFrame:
    """The top fifth, its lower bound included."""
    members = layer_members(signals.withColumnRenamed("signal", "factor"), 5).where("layer = 4")
    weights = members.select(F.col("factor").alias("signal"), "dt", "stock", "weight")
    return strategy_nav(weights, returns, calendar(signals), "signal", freq=freq, cost=cost)


def drawdown(nav: DataFrame, *series: str) -> DataFrame:
    """``(series, max_drawdown, duration)``: the deepest fall from a peak and the rows from the peak's first date to its bottom."""
    by = Window.partitionBy(*series).orderBy("dt")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    line = nav.select(*series, "dt", "nav", F.row_number().over(by).alias("k"), F.max("nav").over(upto).alias("peak"))
    line = line.withColumn("fall", F.col("nav") / F.col("peak") - 1).withColumn("since", F.min("k").over(Window.partitionBy(*series, "peak")))
    worst = line.groupBy(*series).agg(F.min_by(F.struct("fall", "k", "since"), F.struct("fall", "k")).alias("w"))
    return worst.select(*series, (-F.col("w.fall")).alias("max_drawdown"), (F.col("w.k") - F.col("w.since")).alias("duration"))


def with_change(nav: DataFrame, *series: str) -> DataFrame:
    return nav.withColumn("r", F.try_divide(F.col("nav"), F.lag("nav").over(Window.partitionBy(*series).orderBy("dt"))) - 1)


def metrics(nav: DataFrame, *series: str, less: int = 0, population: bool = False) -> DataFrame:
    """Per series, in percent: total, yearly return, volatility, Sharpe, drawdown, Calmar, yearly turnover, share of gains.

    ``less`` is subtracted from the number of dates that a year is scaled by (1 for the older convention).
    """
    spread = F.stddev_pop if population else F.stddev_samp
    years = (F.count(F.lit(1)) - less) / F.lit(float(YEAR))
    first, last = F.min_by("nav", "dt"), F.max_by("nav", "dt")
    got = with_change(nav, *series).groupBy(*series).agg(
        (100 * (last / first - 1)).alias("total"), (100 * (F.pow(last / first, 1 / years) - 1)).alias("annual"), (100 * spread("r") * YEAR**0.5).alias("volatility"), (F.sum("turnover") / years).alias("turnover"), (100 * F.avg((F.col("r") > 0).cast("double"))).alias("win_rate")
    )
    got = got.join(drawdown(nav, *series), list(series))
    return got.select(
        *series, "total", "annual", "volatility", F.try_divide("annual", "volatility").alias("sharpe"), (100 * F.col("max_drawdown")).alias("max_drawdown"), "duration", F.try_divide(F.col("annual"), 100 * F.col("max_drawdown")).alias("calmar"), "turnover", "win_rate"
    )


def benchmark_nav(index: DataFrame) -> DataFrame:
    """``(dt, nav)`` of an index from its returns; 1.0 on its first date."""
    by = Window.partitionBy(F.lit(1)).orderBy("dt")
    growth = F.when(F.row_number().over(by) == 1, 1.0).otherwise(1 + F.coalesce("market_return", F.lit(0.0)))
    return index.select("dt", growth.alias("g")).select("dt", F.product("g").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))


def equal_weight_nav(returns: DataFrame, stints: DataFrame | None = None) -> DataFrame:
    """``(dt, nav)`` of all members in equal weights."""
    from crosspanel.operators.membership import filter_members

    rows = filter_members(returns, stints) if stints is not None else returns
    daily = rows.groupBy("dt").agg(F.avg("ret").alias("market_return"))
    by = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("dt", F.product(1 + F.coalesce("market_return", F.lit(0.0))).over(by).alias("nav"))


def excess_metrics(nav: DataFrame, benchmark: DataFrame, *series: str) -> DataFrame:
    """Per series: yearly excess return, tracking error, information ratio, drawdown of the compounded excess, monthly win rate."""
    base = benchmark.select("dt", F.col("nav").alias("base"))
    by = Window.partitionBy(*series).orderBy("dt")
    line = nav.join(F.broadcast(base), "dt").select(*series, "dt", (F.try_divide(F.col("nav"), F.lag("nav").over(by)) - F.try_divide(F.col("base"), F.lag("base").over(by))).alias("x")).where(F.col("x").isNotNull())
    line = line.withColumn("nav", F.product(1 + F.col("x")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min_by("nav", "dt"), F.max_by("nav", "dt")
    got = line.groupBy(*series).agg((100 * (F.pow(last / first, YEAR / F.count(F.lit(1))) - 1)).alias("excess_annual"), (100 * F.stddev_samp("x") * YEAR**0.5).alias("tracking_error"))
    return got.join(drawdown(line, *series), list(series)).join(monthly_win_rate(line, *series), list(series)).select(*series, "excess_annual", "tracking_error", F.try_divide("excess_annual", "tracking_error").alias("information_ratio"), (100 * F.col("max_drawdown")).alias("excess_drawdown"), "monthly_win_rate")


def monthly_win_rate(excess: DataFrame, *series: str, grain: str = "month") -> DataFrame:
    """Share of months (in percent) whose compounded ``x`` is above zero."""
    per = excess.groupBy(*series, F.date_trunc(grain, "dt").alias("m")).agg((F.product(1 + F.col("x")) - 1).alias("g"))
    return per.groupBy(*series).agg((100 * F.avg((F.col("g") > 0).cast("double"))).alias("monthly_win_rate"))


def period_returns(nav: DataFrame, *series: str, grain: str = "month") -> DataFrame:
    """``(series, period, r)``: change of the last value of each period; the first one is left out."""
    last = nav.groupBy(*series, F.date_trunc(grain, "dt").cast("date").alias("period")).agg(F.max_by("nav", "dt").alias("nav"))
    change = F.col("nav") / F.lag("nav").over(Window.partitionBy(*series).orderBy("period")) - 1
    return last.select(*series, "period", change.alias("r")).where(F.col("r").isNotNull())


def optimal_pct(table: DataFrame, by: str = "sharpe") -> DataFrame:
    """``(signal, pct)`` of the greatest ``by``; equal to 8 places the smaller percentage, NULL and NaN never win."""
    good = table.where(F.col(by).isNotNull() & ~F.isnan(by))
    return good.groupBy("signal").agg(F.max_by("pct", F.struct(F.round(by, 8), -F.col("pct"))).alias("pct"))


def split_dates(days: DataFrame, share: float = 0.8) -> DataFrame:
    """``(dt, i, is_train)``: the first ``share`` of the dates are for training."""
    total = days.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("cut"))
    return days.join(F.broadcast(total)).select("dt", "i", (F.col("i") < F.col("cut")).alias("is_train"))


def out_of_sample(signals: DataFrame, returns: DataFrame, pcts: tuple[float, ...] = PCTS, share: float = 0.8, cost: float = 0.002) -> DataFrame:
    """``(signal, pct, dt, turnover, nav)`` over the last dates, from 1.0, with the percentage that was best before them."""
    parts = split_dates(calendar(signals), share)
    train = written(long_only(signals, returns, pcts, cost=cost).join(F.broadcast(parts.where("is_train").select("dt")), "dt", "left_semi"), "train")
    best = written(optimal_pct(metrics(train, "signal", "pct")), "best")
    rest = parts.where("not is_train").select("dt", (F.col("i") - F.min("i").over(Window.partitionBy(F.lit(1)))).alias("i"))
    later = top_pct(signals.join(F.broadcast(rest.select("dt")), "dt", "left_semi"), pcts).join(F.broadcast(best), ["signal", "pct"], "left_semi")
    return strategy_nav(later, returns, rest, "signal", "pct", cost=cost)
