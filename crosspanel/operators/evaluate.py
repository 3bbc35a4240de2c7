"""What a factor is worth: information coefficients, layers, monotonicity, long-short and correlation between factors.

Factors come tidy, ``(factor, stock, dt, value)``, returns as ``(stock, dt, ret)``; all factors go through one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.stats import EPS, average_rank, correlation, sample_skew
from crosspanel.sources.shared import written

YEAR = 252


def calendar(panel: DataFrame) -> DataFrame:
    """``(dt, i)``: the distinct dates, numbered from 0.  One row a date, so it is small whatever the number of stocks."""
    return panel.select("dt").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dt")) - 1)


def align(*panels: DataFrame) -> DataFrame:
    """``(stock, dt)`` of the stocks and the dates that all panels have."""
    stocks, dates = panels[0].select("stock").distinct(), panels[0].select("dt").distinct()
    for p in panels[1:]:
        stocks, dates = stocks.intersect(p.select("stock")), dates.intersect(p.select("dt"))
    return panels[0].select("stock", "dt").distinct().join(dates, "dt", "left_semi").join(stocks, "stock", "left_semi")


def forward_return(returns: DataFrame, k: int = 1, cumulative: bool = False) -> DataFrame:
    """``(stock, dt, fwd)``: the return of the ``k``-th next date, or with ``cumulative`` all of the next ``k`` compounded."""
    known = returns.where(F.col("ret").isNotNull()).select("stock", "dt", "ret")
    days = calendar(known)
    later = known.join(days, "dt")
    if not cumulative:
        at = later.select("stock", (F.col("i") - k).alias("i"), F.col("ret").alias("fwd"))
        return at.join(days, "i").select("stock", "dt", "fwd")
    steps = later.select("stock", F.explode(F.sequence(F.col("i") - k, F.col("i") - 1)).alias("i"), "ret")
    whole = steps.groupBy("stock", "i").agg(F.product(1 + F.col("ret")).alias("g"), F.count("ret").alias("n")).where(F.col("n") == k)
    return whole.join(days, "i").select("stock", "dt", (F.col("g") - 1).alias("fwd"))


def _paired(factors: DataFrame, returns: DataFrame, k: int) -> DataFrame:
    return factors.where(F.col("value").isNotNull()).join(forward_return(returns, k), ["stock", "dt"])


def ic(factors: DataFrame, returns: DataFrame, k: int = 1, least: int = 10) -> DataFrame:
    """``(factor, dt, n, ic)``: correlation of factor and later return, for dates with enough names and variance."""
    per = _paired(factors, returns, k).groupBy("factor", "dt").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"), correlation("value", "fwd").alias("ic"))
    return per.where((F.col("n") >= least) & (F.col("sd") > EPS) & F.col("ic").isNotNull()).select("factor", "dt", "n", "ic")


def rank_ic(factors: DataFrame, returns: DataFrame, k: int = 1, least: int = 10) -> DataFrame:
    """The same of ranks, ties sharing their mean rank."""
    ranked = _paired(factors, returns, k).select("factor", "dt", average_rank("value", "factor", "dt").alias("a"), average_rank("fwd", "factor", "dt").alias("b"))
    per = ranked.groupBy("factor", "dt").agg(F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("rank_ic"))
    return per.where((F.col("n") >= least) & F.col("rank_ic").isNotNull())


def ir_summary(series: DataFrame, column: str = "ic") -> DataFrame:
    """Per factor: mean, deviation, ratio, share above zero, skewness and number of the coefficients."""
    mean, sd = F.avg(column), F.stddev_samp(column)
    return series.groupBy("factor").agg(
        mean.alias(f"{column}_mean"), sd.alias(f"{column}_std"), (mean / (sd + EPS)).alias("ir"), F.avg((F.col(column) > 0).cast("double")).alias("positive"), sample_skew(column).alias("skew"), F.count(column).alias("n")
    )


def layer_members(factors: DataFrame, layers: int = 5) -> DataFrame:
    """``(factor, dt, layer, stock, weight)``: equal weights within quantile layers.

    Both ends of a layer belong to it, so names on a boundary are in two.  The rule is that of linear quantiles in
    integer arithmetic: with a and b the least and greatest 0-based rank of a value among N, layer j of L holds it if
    b * L >= (N - 1) * j and a * L <= (N - 1) * (j + 1).  Dates with fewer than L names have no layers.
    """
    by = Window.partitionBy("factor", "dt")
    a = F.rank().over(by.orderBy("value")) - 1
    held = factors.where(F.col("value").isNotNull()).select("factor", "dt", "stock", "value", F.count(F.lit(1)).over(by).alias("n"), a.alias("a"))
    held = held.withColumn("b", F.col("a") + F.count(F.lit(1)).over(Window.partitionBy("factor", "dt", "value")) - 1).where(F.col("n") >= layers)
    each = held.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    inside = each.where((F.col("b") * layers >= (F.col("n") - 1) * F.col("layer")) & (F.col("a") * layers <= (F.col("n") - 1) * (F.col("layer") + 1)))
    return inside.select("factor", "dt", "layer", "stock", (1 / F.count(F.lit(1)).over(Window.partitionBy("factor", "dt", "layer"))).alias("weight"))


def layer_weights(factors: DataFrame, layers: int = 5, freq: int = 5, lag: int | None = None) -> DataFrame:
    """``(factor, i, layer, stock, weight)`` at every ``freq``-th date, from the factor ``lag`` (``freq``) dates before."""
    lag = freq if lag is None else lag
    days = calendar(factors)
    used = factors.join(F.broadcast(days), "dt").where((F.col("i") % freq == (freq - lag) % freq) & (F.col("i") + lag >= freq))
    members = layer_members(used.select("factor", "dt", "stock", "value"), layers).join(F.broadcast(days), "dt")
    last = days.agg(F.max("i").alias("last"))
    return members.withColumn("i", F.col("i") + lag).join(F.broadcast(last)).where(F.col("i") <= F.col("last")).select("factor", "i", "layer", "stock", "weight")


def turnover_of(weights: DataFrame, *series: str) -> DataFrame:
    """``(series, i, turnover)``: the summed absolute change of weights at each rebalancing, names that are new or gone included."""
    marks = weights.select(*series, "i").distinct()
    after = marks.withColumn("next", F.lead("i").over(Window.partitionBy(*series).orderBy("i")))
    gone = weights.join(after.where(F.col("next").isNotNull()), [*series, "i"]).select(*series, F.col("next").alias("i"), "stock", (-F.col("weight")).alias("weight"))
    change = weights.select(*series, "i", "stock", "weight").unionByName(gone).groupBy(*series, "i", "stock").agg(F.sum("weight").alias("d"))
    return change.groupBy(*series, "i").agg(F.sum(F.abs("d")).alias("turnover"))


def held_return(weights: DataFrame, returns: DataFrame, days: DataFrame, *series: str, delay: int = 0) -> DataFrame:
    """``(series, i, r)``: return on each date of the weights of the last rebalancing up to ``delay`` dates before it."""
    marks = weights.select(*series, "i").distinct().withColumn("until", F.lead("i").over(Window.partitionBy(*series).orderBy("i")))
    last = days.agg(F.max("i").alias("last"))
    upto = F.least(F.greatest(F.col("i") + delay, F.coalesce(F.col("until") - 1 + delay, F.col("last"))), F.col("last"))
    spans = marks.join(F.broadcast(last)).select(*series, F.col("i").alias("mark"), (F.col("i") + delay).alias("since"), upto.alias("upto")).where("since <= upto")
    # a date's returns go to the marks that any series holds on it (one, if all turn over together); weights aren't copied to dates
    held_on = spans.groupBy("mark").agg(F.min("since").alias("since"), F.max("upto").alias("upto")).select("mark", F.explode(F.sequence("since", "upto")).alias("i"))
    daily = returns.where(F.col("ret").isNotNull()).join(F.broadcast(days), "dt").join(held_on, "i").select("stock", "mark", "i", "ret")
    held = weights.withColumnRenamed("i", "mark").join(spans, [*series, "mark"])
    earned = held.join(daily, ["stock", "mark"]).where("i BETWEEN since AND upto").groupBy(*series, "i").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    grid = spans.select(*series, F.explode(F.sequence("since", "upto")).alias("i"))
    return grid.join(earned, [*series, "i"], "left").fillna(0.0, ["r"])


def layer_nav(factors: DataFrame, returns: DataFrame, layers: int = 5, freq: int = 5, fee: float = 0.001, lag: int | None = None) -> DataFrame:
    """``(factor, layer, dt, turnover, nav)``: value of each layer from 1.0 on, flat before the first rebalancing.

    On a rebalancing date the cost comes first and the new weights earn the same day's return; weights don't drift.
    """
    days = calendar(factors)
    w = written(layer_weights(factors, layers, freq, lag), "weights")
    cost, earned = turnover_of(w, "factor", "layer"), held_return(w, returns, days, "factor", "layer")
    grid = factors.select("factor").distinct().withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).join(F.broadcast(days))
    at = grid.join(earned, ["factor", "layer", "i"], "left").join(cost, ["factor", "layer", "i"], "left").fillna(0.0, ["r", "turnover"])
    growth = (1 - F.lit(fee) * F.col("turnover")) * (1 + F.col("r"))
    nav = F.product(growth).over(Window.partitionBy("factor", "layer").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return at.select("factor", "layer", "dt", "turnover", nav.alias("nav"))


def monotonicity(nav: DataFrame, chosen: tuple[int, ...] = (0, 2, 4)) -> DataFrame:
    """``(factor, is_monotone, direction)`` from the final values of the chosen layers; flat counts as rising."""
    final = nav.groupBy("factor", "layer").agg(F.max_by("nav", "dt").alias("v")).where(F.col("layer").isin(*chosen))
    got = final.groupBy("factor").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "v"))), lambda x: x["v"]).alias("v"))
    up = F.lit(True)
    down = F.lit(True)
    for k in range(1, len(chosen)):
        up, down = up & (F.col("v")[k] >= F.col("v")[k - 1]), down & (F.col("v")[k] <= F.col("v")[k - 1])
    return got.select("factor", (up | down).alias("is_monotone"), F.when(up, "positive").when(down, "negative").alias("direction"))


def long_short(nav: DataFrame, high: int = 4, low: int = 0) -> DataFrame:
    """Per factor: total and yearly return and Sharpe ratio of the series (long - short) / 2 + 1."""
    legs = nav.groupBy("factor", "dt").agg(F.max(F.when(F.col("layer") == high, F.col("nav"))).alias("l"), F.max(F.when(F.col("layer") == low, F.col("nav"))).alias("s"))
    by = Window.partitionBy("factor").orderBy("dt")
    line = legs.select("factor", "dt", ((F.col("l") - F.col("s")) / 2 + 1).alias("v"))
    line = line.withColumn("r", F.try_divide(F.col("v"), F.lag("v").over(by)) - 1)
    first, last, n = F.min_by("v", "dt"), F.max_by("v", "dt"), F.count(F.lit(1))
    return line.groupBy("factor").agg(
        (last / first - 1).alias("total"), (F.pow(last / first, YEAR / n) - 1).alias("annual"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * YEAR**0.5).alias("sharpe")
    )


def abs_retry(factors: DataFrame, returns: DataFrame, layers: int = 5, freq: int = 5, fee: float = 0.001) -> DataFrame:
    """``(factor, use_abs, direction)``: factors that aren't monotone but whose absolute values are, are used so."""
    both = factors.withColumn("kind", F.lit("plain")).unionByName(factors.withColumn("value", F.abs("value")).withColumn("kind", F.lit("abs")))
    tagged = both.select(F.concat_ws("|", "kind", "factor").alias("factor"), "stock", "dt", "value")
    kind, name = (F.regexp_extract("factor", r"(?s)^(plain|abs)\|(.*)$", k) for k in (1, 2))
    found = monotonicity(layer_nav(tagged, returns, layers, freq, fee)).select(kind.alias("kind"), name.alias("factor"), "is_monotone", "direction")
    plain = found.where("kind = 'plain'").select("factor", F.col("is_monotone").alias("m"), F.col("direction").alias("d"))
    other = found.where("kind = 'abs'").select("factor", F.col("is_monotone").alias("ma"), F.col("direction").alias("da"))
    use = ~F.col("m") & F.col("ma")
    return plain.join(other, "factor").select("factor", use.alias("use_abs"), F.when(use, F.col("da")).otherwise(F.coalesce("d", F.lit("positive"))).alias("direction"))


def factor_corr(panel: DataFrame, names: list[str]) -> DataFrame:
    """``(a, b, n, corr)`` of each pair of factor columns over rows that have both, in one aggregation without a join."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    aggs = []
    for a, b in pairs:
        aggs += [correlation(a, b).alias(f"c|{a}|{b}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n|{a}|{b}")]
    row = panel.agg(*aggs)
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`n|{a}|{b}`").alias("n"), F.col(f"`c|{a}|{b}`").alias("corr")) for a, b in pairs])
    return row.select(F.inline(each))


def signal_analysis(signals: DataFrame, returns: DataFrame, corr: DataFrame, others: int = 3, freq: int = 1, fee: float = 0.002) -> DataFrame:
    """Per signal: coefficients of values and ranks, layers changed on each ``freq``-th date, and ``corr``, a map of its correlations with up to ``others`` more.

    ``signals`` are tidy with ``signal``, ``corr`` is the result of ``factor_corr`` over them.
    """
    tidy = signals.withColumnRenamed("signal", "factor")
    nav = written(layer_nav(tidy, returns, 5, freq, fee), "nav")
    plain = ir_summary(ic(tidy, returns)).select("factor", "ic_mean", "ic_std", "ir", F.col("positive").alias("ic_win_rate"))
    ranks = ir_summary(rank_ic(tidy, returns), "rank_ic").select("factor", "rank_ic_mean", F.col("ir").alias("rank_ir"))
    both = corr.select("a", "b", "corr").unionByName(corr.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    near = both.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("k") <= others)
    near = near.groupBy(F.col("a").alias("factor")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "corr")))).alias("corr"))
    got = plain.join(ranks, "factor", "left").join(monotonicity(nav), "factor").join(long_short(nav), "factor").join(near, "factor", "left")
    return got.withColumnRenamed("factor", "signal").withColumn("direction", F.coalesce("direction", F.lit("positive")))


def high_corr_pairs(corr: DataFrame, least: float = 0.7) -> DataFrame:
    return corr.where(F.abs("corr") >= least)


def pruned(corr: DataFrame, least: float = 0.7) -> tuple[list[str], list[str]]:
    """Factors to keep and to drop: of the closest pairs first, the first name stays.  A list of factor pairs is small."""
    keep: list[str] = []
    drop: list[str] = []
    for r in high_corr_pairs(corr, least).orderBy(F.abs("corr").desc(), "a", "b").collect():
        if r["a"] not in drop and r["a"] not in keep:
            keep.append(r["a"])
        if r["b"] not in keep and r["b"] not in drop:
            drop.append(r["b"])
    return keep, drop


def top(summary: DataFrame, column: str, k: int = 5) -> DataFrame:
    return summary.orderBy(F.col(column).desc_nulls_last(), "factor").limit(k)


def composite(summary: DataFrame, ir: str = "ir", spread: str = "total") -> DataFrame:
    """``(factor, score)``: 0.6 of the scaled ratio and 0.4 of the scaled long-short return; a flat column counts 0."""
    whole = summary.agg(*[f(F.coalesce(c, F.lit(0.0))).alias(f"{n}_{c}") for c in (ir, spread) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0.0)) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) for c in (ir, spread)}
    return summary.join(F.broadcast(whole)).select("factor", (0.6 * scaled[ir] + 0.4 * scaled[spread]).alias("score"))
