"""From factors to signals: training panel, factor scores and selection, the equal-weight composite, regressors, ensemble."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import networks
from crosspanel.functions.stats import EPS, cross_section, zscore
from crosspanel.operators import linear, training, trees
from crosspanel.operators.evaluate import calendar, forward_return, ic, ir_summary
from crosspanel.operators.features import walk_forward
from crosspanel.operators.training import Plan
from crosspanel.operators.trees import Growth
from crosspanel.sources.shared import written

#: Names that mark a factor as made by a model rather than from prices.
MODEL_NAMES = ("gru", "transformer", "lightgbm", "svm", "rf")


def filled(panel: DataFrame, factors: list[str]) -> DataFrame:
    """``(stock, dt, factors)``: missing factors take the date's mean, else 0."""
    return panel.select("stock", "dt", *[F.coalesce(F.col(f), F.avg(f).over(cross_section()), F.lit(0.0)).alias(f) for f in factors])


def training_panel(panel: DataFrame, factors: list[str], k: int = 1) -> DataFrame:
    """``(stock, dt, factors, fwd)``: missing factors take the date's mean, else 0; rows without a later return are left out."""
    return filled(panel, factors).join(forward_return(panel, k), ["stock", "dt"])


def factor_direction(series: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(factor, direction)``: what an analysis has found, else the sign of the mean coefficient."""
    sign = series.groupBy("factor").agg(F.when(F.avg("ic") >= 0, "positive").otherwise("negative").alias("sign"))
    if known is None:
        return sign.select("factor", F.col("sign").alias("direction"))
    return sign.join(known.select("factor", "direction"), "factor", "left").select("factor", F.coalesce("direction", "sign").alias("direction"))


def factor_class(factors: DataFrame) -> DataFrame:
    return factors.select("factor", F.when(F.lower("factor").rlike("|".join(MODEL_NAMES)), "model").otherwise("price").alias("class"))


def train_ic(factors: DataFrame, returns: DataFrame, share: float = 0.8, least: int = 10) -> DataFrame:
    """Mean and ratio of the coefficients of the first ``share`` of the dates."""
    days = calendar(factors)
    cut = days.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("cut"))
    early = days.join(F.broadcast(cut)).where("i < cut").select("dt")
    series = ic(factors, returns, least=least).join(F.broadcast(early), "dt", "left_semi")
    return ir_summary(series).select("factor", "ic_mean", F.when(F.col("ic_std") > EPS, F.col("ir")).otherwise(0.0).alias("ir"))


def factor_score(summary: DataFrame) -> DataFrame:
    """0.3 of the coefficient, 0.3 of its ratio, 0.2 for monotone layers, and up to 0.1 each for return and Sharpe ratio."""
    gain, sharpe = (F.greatest(F.lit(0.0), F.least(F.coalesce(c, F.lit(0.0)), F.lit(0.1))) for c in (F.col("annual"), F.col("sharpe") / 2))
    base = 0.3 * F.abs("ic_mean") + 0.3 * F.abs("ir") + 0.2 * F.coalesce(F.col("is_monotone").cast("double"), F.lit(0.0))
    return summary.withColumn("score", base + gain + sharpe)


def select_factors(scored: DataFrame, corr: DataFrame, least: int, most: int, least_ic: float = 0.02, close: float = 0.7) -> list[str]:
    """Names by score, without weak ones and ones close to a better one; the best by score alone if too few are left.

    A few dozen factors and their pairs are all that the driver sees.
    """
    rows = scored.select("factor", "score", "ic_mean").orderBy(F.col("score").desc(), "factor").collect()
    near = {frozenset((r["a"], r["b"])) for r in corr.where(F.abs("corr") > close).collect()}
    kept: list[str] = []
    for r in rows:
        if abs(r["ic_mean"] or 0) >= least_ic and not any(frozenset((r["factor"], k)) in near for k in kept):
            kept.append(r["factor"])
    if len(kept) < least:
        kept = [r["factor"] for r in rows[:least]]
    return kept[:most]


def select_by_category(scored: DataFrame, corr: DataFrame, categories: dict[str, str], least: int = 1, most: int = 2, least_ic: float = 0.02, close: float = 0.7, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``(category, rank, factor, score)``: ``select_factors`` in every category by itself; names without one are "other".

    ``limits`` has least and most for a category where they differ.  A category with too few left has its best by score.
    """
    kind = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.lit(None).cast("map<string,string>")
    named = written(scored.withColumn("category", F.coalesce(F.try_element_at(kind, F.col("factor")), F.lit("other"))), "scored")
    rows = []
    for r in named.select("category").distinct().orderBy("category").collect():  # a row a category
        low, high = (limits or {}).get(r["category"], (least, most))
        names = select_factors(named.where(F.col("category") == r["category"]), corr, low, high, least_ic, close)
        rows += [(r["category"], k, f) for k, f in enumerate(names, 1)]
    chosen = named.sparkSession.createDataFrame(rows, "category string, rank int, factor string")
    return chosen.join(named.select("category", "factor", "score"), ["category", "factor"]).select("category", "rank", "factor", "score")


def model1_signal(panel: DataFrame, directions: dict[str, int]) -> DataFrame:
    """``(stock, dt, value)``: mean score of the chosen factors, negative ones turned, for rows that have at least 0.3 of them."""
    names = sorted(directions)
    known = sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0))
    rows = panel.where(known >= max(1, int(0.3 * len(names)))).select("stock", "dt", *[(F.col(f) * directions[f]).alias(f) for f in names])
    filled = rows.select("stock", "dt", *[F.coalesce(F.col(f), F.avg(f).over(cross_section())).alias(f) for f in names])
    scores = filled.select("stock", "dt", *[F.coalesce(zscore(f, cross_section(), F.stddev_pop), F.lit(0.0)).alias(f) for f in names])
    return scores.select("stock", "dt", (sum((F.col(f) for f in names), F.lit(0.0)) / len(names)).alias("value"))


def standard_scale(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` scaled by mean and population deviation of ``train``; a constant column is only centred."""
    stats = train.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"{c}__m")) / F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0) for c in columns}
    return rows.join(F.broadcast(stats)).withColumns(scaled).select(*rows.columns)


def scales(rows: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Means and population deviations, two numbers a column; 1 for a deviation that is zero or unknown."""
    s = rows.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: s[f"{c}_m"] or 0.0 for c in columns}, {c: s[f"{c}_s"] or 1.0 for c in columns}


def _by_date(panel: DataFrame, shares: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    days = calendar(panel)
    n = days.agg(F.count(F.lit(1)).alias("n"))
    part = days.join(F.broadcast(n)).withColumn("x", F.col("i") / F.col("n"))
    return tuple(panel.join(F.broadcast(part.where((F.col("x") >= a) & (F.col("x") < b)).select("dt")), "dt", "left_semi") for a, b in ((0.0, shares[0]), (shares[0], shares[1])))


def boosted_signal(panel: DataFrame, factors: list[str], how: Growth = Growth()) -> DataFrame:
    """``(stock, dt, value)``: regularised boosted trees.

    Fitted on the first 64 % of dates, the next 16 % deciding after how many trees to stop; then that many are fitted on both.
    """
    fit, valid = _by_date(written(training_panel(panel, factors), "training"), (0.64, 0.8))
    x = F.array(*factors).alias("x")
    rows = [part.select(F.lit(later).alias("is_valid"), F.xxhash64("stock", "dt").alias("tie"), x, F.col("fwd").alias("y")) for later, part in ((False, fit), (True, valid))]
    model = trees.fit(rows[0].unionByName(rows[1]), len(factors), how)
    return trees.predicted(filled(panel, factors).select("stock", "dt", x), model)


def forest_signal(panel: DataFrame, factors: list[str], count: int = 100, depth: int = 10) -> DataFrame:
    """``(stock, dt, value)``: a random forest fitted on the first 80 % of dates."""
    train, _ = _by_date(training_panel(panel, factors), (0.8, 1.0))
    put = VectorAssembler(inputCols=factors, outputCol="features")
    model = RandomForestRegressor(labelCol="fwd", numTrees=count, maxDepth=depth, seed=1).fit(put.transform(train))
    return model.transform(put.transform(filled(panel, factors))).select("stock", "dt", F.col("prediction").alias("value"))


#: The network of the second model: batches of 256 rows, one less the concordance as its loss.
NETWORK = Plan(networks.ccc_loss, batch=256, epochs=100, rate=0.001, patience=10, single=True)


def network_signal(panel: DataFrame, factors: list[str], plan: Plan = NETWORK, widths: tuple[int, ...] = (128, 64, 32), rate: float = 0.3) -> DataFrame:
    """``(stock, dt, value)``: a network of dense layers with batch norm and dropout.

    Trained on the first 60 % of dates, the next 20 % deciding when to stop.  Factors and returns are scaled by the training
    rows, and every row of the panel is predicted.
    """
    train, valid = _by_date(written(training_panel(panel, factors), "training"), (0.6, 0.8))
    mean, sd = scales(train, [*factors, "fwd"])
    x = F.array(*[(F.col(c) - mean[c]) / sd[c] for c in factors]).alias("x")
    samples = [part.select(F.lit(name).alias("part"), "stock", "dt", x, ((F.col("fwd") - mean["fwd"]) / sd["fwd"]).alias("y")) for name, part in (("train", train), ("valid", valid))]
    lanes = training.packed(samples[0].unionByName(samples[1]), F.struct("stock", "dt"), ["stock", "dt"], plan)
    net = networks.mlp(len(factors), widths, rate)
    return training.predicted(filled(panel, factors).select("stock", "dt", x), net, training.fit(lanes, net, plan), sd["fwd"], mean["fwd"], plan.single)


def walk_forward_sums(panel: DataFrame, factors: list[str]) -> DataFrame:
    """``(dt, gram)``: sums of products of a one, the factors and the return scaled within its date."""
    rows = training_panel(panel, factors)
    return linear.gram_sums(rows.withColumn("fwd", F.coalesce(zscore("fwd", cross_section()), F.lit(0.0))), [*factors, "fwd"])


def walk_forward_signal(panel: DataFrame, factors: list[str], every: int = 12, trailing: int = 24, gap: int = 3, strength: float = 0.01) -> DataFrame:
    """``(model, stock, dt, value)``: a linear model for every ``every``-th date, fitted on the trailing dates.

    Returns are scaled within each date before fitting, and each date is predicted by the latest model up to it.  All
    models come from one aggregation: rows are summed up once a date, and a model adds the sums of its dates.
    """
    plan = written(walk_forward(panel, every, trailing, gap), "walk")
    fits = linear.trailing_fits(walk_forward_sums(panel, factors), plan, len(factors), strength)
    use = plan.where("role = 'use'").join(fits, "model").select("model", "dt", "weights")  # a row a date
    x = F.array(F.lit(1.0), *factors)
    value = F.aggregate(F.zip_with(x, "weights", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return filled(panel, factors).join(F.broadcast(use), "dt").select("model", "stock", "dt", value.alias("value"))


def linear_signal(panel: DataFrame, factors: list[str], cost: float = 1.0, margin: float = 0.1) -> DataFrame:
    """``(stock, dt, value)``: linear support vector regression with the squared loss beyond ``margin``, on all rows of the first 80 % of dates.

    Factors and returns are scaled by the training rows; values are those of scaled returns.
    """
    train, _ = _by_date(written(training_panel(panel, factors), "training"), (0.8, 1.0))
    mean, sd = scales(train, [*factors, "fwd"])
    x = F.array(*[(F.col(c) - mean[c]) / sd[c] for c in factors]).alias("x")
    w = linear.support_vector(train.select(x, ((F.col("fwd") - mean["fwd"]) / sd["fwd"]).alias("y")), len(factors), cost, margin)
    return linear.predicted(filled(panel, factors).select("stock", "dt", x), w)


def ensemble(*signals: DataFrame) -> DataFrame:
    """Plain mean of signals over the rows that all have."""
    whole = signals[0].select("stock", "dt", F.col("value").alias("v0"))
    for k, s in enumerate(signals[1:], 1):
        whole = whole.join(s.select("stock", "dt", F.col("value").alias(f"v{k}")), ["stock", "dt"])
    return whole.select("stock", "dt", (sum((F.col(f"v{k}") for k in range(len(signals))), F.lit(0.0)) / len(signals)).alias("value"))

