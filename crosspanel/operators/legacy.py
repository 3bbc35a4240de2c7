"""The older layer backtest: a lag of one date, weights that drift between rebalancings, and limits on trading.

A name that isn't traded, or that is locked at its upper (lower) price limit, can't be bought (sold) on that date and
keeps its drifted weight; the others share what is left of the target.  That needs the weights of the period before.
A series of up to ``IN_TASK`` names is gone through by one task, which holds one date's rows at a time; if any series has
more, all series go from one rebalancing to the next together, each step being a join and sums over written tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.evaluate import calendar, layer_weights
from crosspanel.sources.shared import new_folder, written

#: Names of a series whose rows of one date may meet in one task: some 100 bytes each.
IN_TASK = 1_000_000


def gen_layers(factors: DataFrame, layers: int = 5, freq: int = 1) -> DataFrame:
    """Layers of the factor of the date before; zero counts as missing."""
    return layer_weights(factors.withColumn("value", F.when(F.col("value") != 0, F.col("value"))), layers, freq, lag=1)


def gen_base(factors: DataFrame) -> DataFrame:
    """``(factor, dt, stock, weight)``: all names with a value, in equal weights."""
    rows = factors.where(F.col("value").isNotNull())
    return rows.select("factor", "dt", "stock", (1 / F.count(F.lit(1)).over(Window.partitionBy("factor", "dt"))).alias("weight"))


def trading_state(panel: DataFrame, limit: float = 0.1, price: str = "close_adj") -> DataFrame:
    """``(stock, dt, price, can_buy, can_sell)``: not without volume, not at the price limit of that side.

    ``price`` is the column that trades are priced by; where it is missing or zero, as an average price without trades is,
    the last adjusted close before that date takes its place.
    """
    traded, ret = F.coalesce(F.col("volume") > 0, F.lit(False)), F.coalesce("ret", F.lit(0.0))
    known = F.col(price)
    if price != "close_adj":
        known = F.coalesce(F.when(known != 0, known), F.lag("close_adj").over(Window.partitionBy("stock").orderBy("dt")))
    return panel.select("stock", "dt", known.alias("price"), (traded & (ret < limit)).alias("can_buy"), (traded & (ret > -limit)).alias("can_sell"))


def _filled(state: DataFrame, days: DataFrame) -> DataFrame:
    """The state on every date: last price where there is none, no trading then, and ``gone`` after a stock's last row."""
    spans = state.groupBy("stock").agg(F.max("dt").alias("last"))
    grid = spans.join(F.broadcast(days.agg(F.collect_list(F.struct("dt", "i")).alias("d")))).select("stock", "last", F.inline("d"))
    upto = Window.partitionBy("stock").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    both = grid.join(state, ["stock", "dt"], "left")
    no = F.lit(False)
    return both.select("stock", "i", F.last("price", ignorenulls=True).over(upto).alias("price"), F.coalesce("can_buy", no).alias("can_buy"), F.coalesce("can_sell", no).alias("can_sell"), (F.col("dt") > F.col("last")).alias("gone"))


def real_weights(weights: DataFrame, daily: DataFrame, *series: str, in_task: int = IN_TASK) -> DataFrame:
    """``(series, i, stock, weight, turnover)``: what is really held after each rebalancing, and how much was traded for it.

    ``in_task`` chooses between the two ways of the module's docstring; the result is the same.
    """
    names = weights.select(*series, "stock").distinct()
    most = names.groupBy(*series).count().agg(F.max("count")).first()[0] or 0
    by = Window.partitionBy(*series).orderBy("i")
    marks = weights.select(*series, "i").distinct().withColumns({"until": F.lead("i").over(by), "k": F.row_number().over(by)})
    rows = names.join(marks, list(series)).join(weights.select(*series, "i", "stock", F.col("weight").alias("target")), [*series, "i", "stock"], "left")
    later = daily.select("stock", F.col("i").alias("until"), F.col("price").alias("end"))
    rows = rows.join(daily, ["stock", "i"]).join(later, ["stock", "until"], "left").fillna(0.0, ["target"])
    return _by_task(rows, *series) if most <= in_task else _by_steps(rows, *series)


def _by_steps(rows: DataFrame, *series: str) -> DataFrame:
    """``real_weights`` by one step for the k-th rebalancing of all series: stocks are dealt to tasks, only a series' sums meet."""
    spark, keys = rows.sparkSession, [*series, "stock"]
    dealt, out = new_folder(spark, "rebalancings"), new_folder(spark, "held")
    rows.write.partitionBy("k").parquet(dealt)
    steps = spark.read.schema(rows.schema).parquet(dealt)
    state = None
    for k in range(1, (steps.agg(F.max("k")).first()[0] or 0) + 1):  # a job for each rebalancing, whatever the number of series
        day = steps.where(F.col("k") == k)
        if state is None:
            day = day.withColumn("old", F.lit(0.0))
        else:
            total = state.groupBy(*series).agg(F.sum("grown").alias("g"), F.sum("weight").alias("w"))
            drifted = F.when(F.col("w") > 0, F.col("grown") / (F.col("g") + 1 - F.col("w"))).otherwise(F.col("grown"))
            day = day.join(state.join(total, list(series)).select(*keys, drifted.alias("old")), keys)
        want, old = F.col("target"), F.col("old")
        kept = ((want < old) & ~F.col("can_sell") & ~F.col("gone")) | ((want >= old) & ~F.col("can_buy") & ((want > 0) | (old > 0)))
        day = day.withColumn("kept", kept)
        sums = day.groupBy(*series).agg((F.sum(want) - F.coalesce(F.sum(F.when(F.col("kept"), old)), F.lit(0.0))).alias("left"), F.sum(F.when(~F.col("kept"), want)).alias("free"))
        share = F.when(F.col("free") > 0, want * F.greatest(F.col("left"), F.lit(0.0)) / F.col("free")).otherwise(0.0)
        now = day.join(sums, list(series)).withColumn("weight", F.when(F.col("kept"), old).otherwise(share))
        grown = F.col("weight") * F.coalesce(F.try_divide("end", "price"), F.lit(1.0))
        now = now.select(*keys, "i", "weight", F.abs(F.col("weight") - old).alias("moved"), grown.alias("grown"))
        now.write.parquet(f"{out}/k={k}")
        state = spark.read.schema(now.schema).parquet(f"{out}/k={k}")
    if state is None:
        return rows.select(*series, "i", "stock", F.col("target").alias("weight"), F.col("target").alias("turnover"))
    held = spark.read.schema(state.schema).parquet(out)
    cost = held.groupBy(*series, "i").agg(F.sum("moved").alias("turnover"))
    return held.where("weight > 0").join(cost, [*series, "i"]).select(*series, "i", "stock", "weight", "turnover")


def _by_task(rows: DataFrame, *series: str) -> DataFrame:
    """``real_weights`` with all names of a series on a date in one task."""
    types = dict(rows.dtypes)

    def traded(day: pd.DataFrame, old: np.ndarray | None) -> tuple[pd.DataFrame, np.ndarray]:
        """What is held after one date's trades, and what that has drifted to when the next ones are due."""
        want, price, end = (day[c].to_numpy(float) for c in ("target", "price", "end"))
        buy, sell, gone = (day[c].to_numpy(bool) for c in ("can_buy", "can_sell", "gone"))
        old = np.zeros(len(day)) if old is None else old
        kept = ((want < old) & ~sell & ~gone) | ((want >= old) & ~buy & ((want > 0) | (old > 0)))
        free = np.where(kept, 0.0, want)
        left = want.sum() - old[kept].sum()
        now = np.where(kept, old, free * max(left, 0.0) / free.sum() if free.sum() > 0 else 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            growth = end / price
        grown = now * np.where(np.isfinite(growth), growth, 1.0)
        out = day[[*series, "i", "stock"]].assign(weight=now, turnover=np.abs(now - old).sum())[now > 0]
        return out, grown / (grown.sum() + 1 - now.sum()) if now.sum() > 0 else grown

    def held(batches):
        key, parts, old = None, [], None
        for pdf in batches:
            for k, part in pdf.groupby([*series, "i"], sort=False):
                if k != key:
                    if parts:
                        out, old = traded(pd.concat(parts), old)
                        yield out
                    if key is None or k[:-1] != key[:-1]:
                        old = None
                    key, parts = k, []
                parts.append(part)
        if parts:
            yield traded(pd.concat(parts), old)[0]

    dealt = rows.repartition(*series).sortWithinPartitions(*series, "i", "stock")  # all names of a series on each of its dates
    return dealt.mapInPandas(held, ", ".join(f"`{c}` {types[c]}" for c in (*series, "i", "stock")) + ", weight double, turnover double")


def drift_nav(weights: DataFrame, state: DataFrame, *series: str, fee: float = 0.002, in_task: int = IN_TASK) -> DataFrame:
    """``(series, dt, turnover, nav)`` from targets ``(series, i, stock, weight)`` and ``trading_state``.

    Within a period the value is 1 + sum of w * (p / p_buy - 1); at its end the next period starts from there, less the
    cost of what is traded.  A name without a price keeps its last one.
    """
    days = calendar(state)
    daily = written(_filled(state, days), "daily")
    real = written(real_weights(written(weights, "weights"), daily, *series, in_task=in_task), "real")
    last = days.agg(F.max("i").alias("last"))
    marks = real.groupBy(*series, "i").agg(F.first("turnover").alias("turnover")).withColumn("until", F.lead("i").over(Window.partitionBy(*series).orderBy("i")))
    spans = marks.join(F.broadcast(last)).select(*series, F.col("i").alias("mark"), F.explode(F.sequence("i", F.coalesce("until", "last"))).alias("i"))
    bought = real.join(daily.select("stock", "i", F.col("price").alias("buy")), ["stock", "i"]).select(*series, F.col("i").alias("mark"), "stock", "weight", "buy")
    inside = bought.join(spans, [*series, "mark"]).join(daily.select("stock", "i", "price"), ["stock", "i"]).groupBy(*series, "mark", "i").agg((1 + F.sum(F.col("weight") * (F.col("price") / F.col("buy") - 1))).alias("v"))
    ends = inside.groupBy(*series, "mark").agg(F.max_by("v", "i").alias("end")).join(marks.select(*series, F.col("i").alias("mark"), "turnover"), [*series, "mark"])
    by = Window.partitionBy(*series).orderBy("mark")
    start = F.coalesce(F.product("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    paid = F.product(1 - F.lit(fee) * F.col("turnover")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    line = inside.join(ends.select(*series, "mark", "turnover", (start * paid).alias("base")), [*series, "mark"])
    # the last date of a period is also the first of the next: the later period's value counts
    whole = line.groupBy(*series, "i").agg(F.max_by(F.struct((F.col("v") * F.col("base")).alias("nav"), F.when(F.col("i") == F.col("mark"), F.col("turnover")).otherwise(0.0).alias("turnover")), "mark").alias("x"))
    return whole.join(F.broadcast(days), "i").select(*series, "dt", "x.turnover", "x.nav")


def month_table(nav: DataFrame, *series: str) -> DataFrame:
    """``(series, year, month, r)``: the months' returns as a table of years."""
    from crosspanel.operators.backtest import period_returns

    return period_returns(nav, *series).select(*series, F.year("period").alias("year"), F.month("period").alias("month"), "r")
