"""Samples for models: labels, sequences, robust scaling, splits by date and walk-forward windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.stats import concordance, correlation, history, trailing
from crosspanel.operators import selection
from crosspanel.operators.evaluate import calendar, forward_return

#: Fields of a step of a sequence, in order.
STEPS = ("high_price", "open_price", "low_price", "close_price", "volume", "vwap")


def agreement(panel: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Per group: ``n``, Pearson's r, its variant scaled by (n - 1) / n, and the concordance correlation."""
    both = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1))
    return both.groupBy(*by).agg(n.alias("n"), correlation(x, y).alias("r"), (correlation(x, y) * (n - 1) / n).alias("r_scaled"), concordance(x, y).alias("ccc"))


def standardize(panel: DataFrame, x: str) -> DataFrame:
    """``z`` by the column's mean and population deviation, and ``weight``, the share of its size in the sum of sizes."""
    stats = panel.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    z = panel.join(F.broadcast(stats)).withColumn("z", F.try_divide(F.col(x) - F.col("m"), F.when(F.col("s") > 0, F.col("s")))).drop("m", "s")
    total = z.agg(F.sum(F.abs("z")).alias("t"))
    return z.join(F.broadcast(total)).withColumn("weight", F.try_divide(F.abs("z"), F.col("t"))).drop("t")


def monthly_returns(panel: DataFrame, grain: str = "month") -> DataFrame:
    """``(stock, dt, ret)`` on the period's last date: compounded, NULL if any of its dates is missing; periods of one date are left out."""
    days = panel.select("dt").distinct().withColumn("period", F.date_trunc(grain, "dt"))
    whole = days.groupBy("period").agg(F.count(F.lit(1)).alias("days"), F.max("dt").alias("end")).where("days > 1")
    per = panel.withColumn("period", F.date_trunc(grain, "dt")).groupBy("stock", "period").agg(F.product(1 + F.col("ret")).alias("g"), F.count("ret").alias("n"))
    return per.join(F.broadcast(whole), "period").select("stock", F.col("end").alias("dt"), F.when(F.col("n") == F.col("days"), F.col("g") - 1).alias("ret"))


def sequences(panel: DataFrame, length: int = 40, step: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(stock, dt, x array<array<float>>)``: the last ``length`` rows, each field relative to its last value; and the columns ``keep``.

    Every ``step``-th row of a stock from the first full one on; not if a value is missing or the last one is zero.
    """
    row = F.array(*[F.col(c).cast("double") for c in STEPS])
    whole = F.lit(True)
    for c in STEPS:
        whole = whole & F.col(c).isNotNull()
    rows = panel.select("stock", "dt", *keep, F.row_number().over(history()).alias("k"), F.when(whole, row).alias("row"))
    rows = rows.select("stock", "dt", *keep, "k", F.collect_list("row").over(trailing(length)).alias("x")).where((F.col("k") >= length) & ((F.col("k") - length) % step == 0))
    last = F.element_at("x", -1)
    good = rows.where((F.size("x") == length) & ~F.exists(last, lambda v: v == 0))
    return good.select("stock", "dt", *keep, F.transform("x", lambda r: F.zip_with(r, F.element_at("x", -1), lambda a, b: (a / (b + 1e-8)).cast("float"))).alias("x"))


def robust_stats(samples: DataFrame) -> DataFrame:
    """``(k, s, med, mad)`` of each step and field of the samples' sequences: exact medians by repeated histograms."""
    cells = samples.select(F.posexplode("x").alias("k", "row")).select("k", F.posexplode("row").alias("s", "x"))
    med = selection.median(cells, ["k", "s"]).withColumnRenamed("median", "med")
    away = cells.join(F.broadcast(med), ["k", "s"]).select("k", "s", F.abs(F.col("x").cast("double") - F.col("med")).alias("x"))
    return med.join(selection.median(away, ["k", "s"]), ["k", "s"]).select("k", "s", "med", (F.col("median") + 1e-8).alias("mad"))


def robust_scaled(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """``x`` less the median, by the absolute deviation; ``stats`` has a row for each cell of a sequence."""
    cell = stats.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s", "med", "mad"))).alias("c"))
    table = cell.agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("t"))
    scaled = F.zip_with("x", F.transform("t", lambda r: r["c"]), lambda row, c: F.zip_with(row, c, lambda v, p: (v - p["med"]) / p["mad"]))
    return samples.join(F.broadcast(table)).withColumn("x", scaled).drop("t")


def labels(panel: DataFrame, grain: str = "month") -> DataFrame:
    """``(stock, dt, daily, monthly)``: the next date's return, and the next known return of a later period's end."""
    daily = forward_return(panel).withColumnRenamed("fwd", "daily")
    ends = monthly_returns(panel, grain).where(F.col("ret").isNotNull()).select("stock", F.date_trunc(grain, "dt").alias("p"), F.col("ret").alias("m"))
    rows = panel.select("stock", "dt", F.date_trunc(grain, "dt").alias("p"))
    ahead = F.first("m", ignorenulls=True).over(Window.partitionBy("stock").orderBy("p").rowsBetween(1, Window.unboundedFollowing))
    later = rows.select("stock", "p").distinct().join(ends, ["stock", "p"], "left").select("stock", "p", ahead.alias("monthly"))
    return rows.join(later, ["stock", "p"]).join(daily, ["stock", "dt"], "left").select("stock", "dt", "daily", "monthly")


def date_split(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """``(dt, is_train)``: the first ``share`` of the distinct dates are for training."""
    days = calendar(panel)
    n = days.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("cut"))
    return days.join(F.broadcast(n)).select("dt", (F.col("i") < F.col("cut")).alias("is_train"))


def walk_forward(panel: DataFrame, every: int, trailing_days: int, gap: int) -> DataFrame:
    """``(model, role, dt)``: a model for every ``every``-th date, the trailing dates it learns from, the dates it is the latest for."""
    days = calendar(panel)
    starts = days.where((F.col("i") % every == 0) & (F.col("i") > gap)).select(F.col("i").alias("m"), F.col("dt").alias("model"))
    train = starts.select("model", F.lit("train").alias("role"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("m") - gap - trailing_days), F.col("m") - gap - 1)).alias("i"))
    use = starts.select("model", F.lit("use").alias("role"), F.explode(F.sequence("m", F.col("m") + every - 1)).alias("i"))
    return train.unionByName(use).join(F.broadcast(days), "i").select("model", "role", "dt")
