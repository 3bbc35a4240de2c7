"""From the analysis of factors to saved predictions: choice, directions, three models, their mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import combine, evaluate, factors
from crosspanel.sources.stages import Stages


def analysis(panel: DataFrame, names: list[str], share: float = 0.8) -> DataFrame:
    """``(factor, score, ic_mean, direction)`` of the first ``share`` of dates: what is needed to choose factors and turn them."""
    days = evaluate.calendar(panel)
    cut = days.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("cut"))
    early = panel.join(F.broadcast(days.join(F.broadcast(cut)).where("i < cut").select("dt")), "dt", "left_semi")
    tidy, returns = factors.tidy(early, *names), early.select("stock", "dt", "ret")
    series = evaluate.ic(tidy, returns)
    nav = evaluate.layer_nav(tidy, returns)
    summary = evaluate.ir_summary(series).join(evaluate.long_short(nav), "factor", "left").join(evaluate.monotonicity(nav), "factor", "left")
    return combine.factor_score(summary).select("factor", "score", "ic_mean").join(combine.factor_direction(series), "factor")


def predictions(panel: DataFrame, names: list[str], stages: Stages, limits: dict[str, tuple[int, int]] | None = None, least_ic: float = 0.02) -> dict[str, DataFrame]:
    """The tables ``chosen``, ``model1``, ``model2``, ``model3`` and ``final`` from ``panel(stock, dt, ret, names)``, each one a stage.

    Factors are chosen by category (made by a model or from prices) within ``limits`` and turned as their analysis says; the
    mean is that of the three saved tables.  Stages that are finished are read, not made again.
    """
    found = stages.table("analysis", lambda: analysis(panel, names))
    kinds = {r["factor"]: r["class"] for r in combine.factor_class(found.select("factor")).collect()}  # a row a factor, as below

    def chosen() -> DataFrame:
        corr = evaluate.factor_corr(panel, names)
        picked = combine.select_by_category(found, corr, kinds, least_ic=least_ic, limits=limits or {"model": (3, 5), "price": (5, 10)})
        return picked.join(found.select("factor", "direction"), "factor")

    own = stages.table("chosen", chosen)
    turned = {r["factor"]: 1 if r["direction"] == "positive" else -1 for r in own.collect()}
    models = {
        "model1": stages.table("model1", lambda: combine.model1_signal(panel, turned)),
        "model2": stages.table("model2", lambda: combine.network_signal(panel, names)),
        "model3": stages.table("model3", lambda: combine.boosted_signal(panel, names)),
    }
    return {"chosen": own, **models, "final": stages.table("final", lambda: combine.ensemble(*models.values()))}
