"""Time-series and cross-sectional factors over a panel ``(stock, dt, open/high/low/close_price, close_adj, volume, amount, turnover, ret)``.

A factor is NULL while its window isn't full.  Windows over the same stock share one exchange and one sort, whatever
their lengths; only the cross-sectional steps (``tcc``, ``ubl``) deal the rows out again, by date.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.stats import EPS, cross_section, deviation, history, roll, with_long_mean, zscore
from crosspanel.sources.shared import partitions, written, written_by

#: Outputs of ``all_factors`` that need a stock's own history only.
OWN = ("bias", "turnover_bias", "apb", "new_high_ratio", "id_vol", "id_vol_decorr", "turn20", "cgo", "rcgo", "sue")
SHADOWS = tuple(f"{kind}_{side}_{stat}" for kind in ("candle", "williams") for side in ("above", "below") for stat in ("mean", "std"))

TABLE = (*OWN, *SHADOWS, "ubl", "tcc", "scc", "arc", "vrc", "src", "krc")


def bias(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn("bias", deviation("close_price", n))


def turnover_bias(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn("turnover_bias", deviation("turnover", n))


def apb(panel: DataFrame, n: int = 20) -> DataFrame:
    """Log of the mean close over the volume-weighted mean close."""
    weighted = F.try_divide(roll(F.sum, F.col("close_price") * F.col("volume"), n), roll(F.sum, "volume", n))
    ratio = F.try_divide(roll(F.avg, "close_price", n), weighted + EPS)
    return panel.withColumn("apb", F.ln(ratio))


def new_high_ratio(panel: DataFrame, n: int = 20, lookback: int = 20) -> DataFrame:
    """Share of rows whose high is the highest of their ``n``; rows before a full window count as no."""
    high = F.coalesce((F.col("high_price") >= roll(F.max, "high_price", n)).cast("int"), F.lit(0))
    return panel.withColumn("is_new_high", high).withColumn("new_high_ratio", roll(F.sum, "is_new_high", lookback) / lookback).drop("is_new_high")


def id_vol(panel: DataFrame, n: int = 20) -> DataFrame:
    """Yearly volatility of returns, under both its names."""
    vol = roll(F.stddev_samp, "ret", n) * math.sqrt(252)
    return panel.withColumns({"id_vol": vol, "id_vol_decorr": vol})


def turn20(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn("turn20", roll(F.avg, "turnover", n))


def cgo(panel: DataFrame, n: int = 252) -> DataFrame:
    """Distance of the close from the mean of the last ``n`` known closes, from row ``n`` + 1 on; under both its names."""
    df = with_long_mean(panel, "close_adj", n, "_mean")
    gain = F.when(F.row_number().over(history()) > n, (F.col("close_adj") - F.col("_mean")) / (F.col("_mean") + EPS))
    return df.withColumns({"cgo": gain, "rcgo": gain}).drop("_mean")


def sue(panel: DataFrame) -> DataFrame:
    """A place for earnings surprises, for which there is no input: always NULL."""
    return panel.withColumn("sue", F.lit(None).cast("double"))


def _shadows(panel: DataFrame, kind: str, up, low, n: int, norm: int) -> DataFrame:
    df = panel.withColumns({"_up": up, "_low": low})
    df = df.withColumns({c: F.col(c) / (roll(F.avg, c, norm) + EPS) for c in ("_up", "_low")})
    out = {}
    for side, c in (("above", "_up"), ("below", "_low")):
        out[f"{kind}_{side}_mean"], out[f"{kind}_{side}_std"] = roll(F.avg, c, n), roll(F.stddev_samp, c, n)
    return df.withColumns(out).drop("_up", "_low")


def candle_shadow(panel: DataFrame, n: int = 20, norm: int = 5) -> DataFrame:
    """Means and deviations of the shadows above and below a candle's body; the lower one is signed, zero or less."""
    return _shadows(panel, "candle", F.abs(F.greatest("open_price", "close_price") - F.col("high_price")), F.col("low_price") - F.least("open_price", "close_price"), n, norm)


def williams_shadow(panel: DataFrame, n: int = 20, norm: int = 5) -> DataFrame:
    return _shadows(panel, "williams", F.abs(F.col("close_price") - F.col("high_price")), F.col("close_price") - F.col("low_price"), n, norm)


def ubl(panel: DataFrame) -> DataFrame:
    """Mean of two cross-sectional scores of shadows, over stocks that have both factors."""
    both = F.col("candle_above_std").isNotNull() & F.col("williams_below_mean").isNotNull()
    df = panel.withColumns({"_a": F.when(both, F.col("candle_above_std")), "_b": F.when(both, F.col("williams_below_mean"))})
    return df.withColumn("ubl", (zscore("_a", cross_section()) + zscore("_b", cross_section())) / 2).drop("_a", "_b")


def tcc(panel: DataFrame, n: int = 252, at_least: int = 60) -> DataFrame:
    """Inverse of the mean squared cross-sectional score of returns."""
    df = with_long_mean(panel.withColumn("_z2", F.pow(zscore("ret", cross_section()), 2)), "_z2", n, "_mean", at_least)
    return df.withColumn("tcc", 1 / (F.col("_mean") + EPS)).drop("_z2", "_mean")


#: Windows that are correlated at once: at most so many rows of one pattern of gaps, rows of several, and patterns.
PIECE, CHUNK, PIECES = 8192, 8192, 128


class _Pieces:
    """Some windows of one date, dealt to pieces that miss the same dates: values (0 where missing), bounds and masks of the pieces."""

    def __init__(self, r: np.ndarray, rows: np.ndarray, cuts: np.ndarray, masks: np.ndarray):
        self.r, self.rows, self.cuts, self.masks = r, rows, cuts, masks

    def slices(self):
        return [slice(x, y) for x, y in zip(self.cuts[:-1], self.cuts[1:], strict=True)]


def _pieces(r: np.ndarray, known: np.ndarray, rows: np.ndarray) -> list[_Pieces]:
    """``rows`` of the windows ``r`` in chunks of pieces; windows without a value are left out."""
    rows = rows[known[rows].any(1)]
    code = np.zeros(len(rows), np.int64)
    for k in range(0, r.shape[1], 32):
        part = known[rows, k : k + 32].astype(np.int64)
        word = np.unique(part @ (1 << np.arange(part.shape[1])), return_inverse=True)[1]
        code = np.unique(code * (len(rows) + 1) + word, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(rows) else np.zeros(1, int)
    starts = [k for x, y in zip(first[:-1], first[1:], strict=True) for k in range(x, y, PIECE)]
    found, at = [], 0
    while at < len(starts):
        to = at + 1
        while to < len(starts) and to - at < PIECES and (starts[to + 1] if to + 1 < len(starts) else len(rows)) - starts[at] <= CHUNK:
            to += 1
        cuts = np.array([*starts[at:to], starts[to] if to < len(starts) else len(rows)])
        own = rows[cuts[0] : cuts[-1]]
        found.append(_Pieces(r[own], own, cuts - cuts[0], known[rows[cuts[:-1]]].astype(float)))
        at = to
    return found


def _towards(x: _Pieces, masks: np.ndarray, least: int) -> tuple:
    """Of every piece of ``x`` over the dates that it shares with each of ``masks``: a row's inverse deviations (0 where it doesn't
    count), then the sums of the rows' scores by date and their number."""
    inverse, sums, number = [], np.zeros((len(x.masks), len(masks), masks.shape[1])), np.zeros((len(x.masks), len(masks)))
    for j, rows in enumerate(x.slices()):
        r, common = x.r[rows], masks * x.masks[j]
        k = common.sum(1)
        mean = r @ masks.T / np.maximum(k, 1)
        var = (r * r) @ masks.T / np.maximum(k, 1) - mean * mean
        ok = (var > EPS) & (k >= least)
        w = ok / np.sqrt(np.where(ok, var, 1))
        sums[j], number[j] = (w.T @ r - (w * mean).sum(0)[:, None]) * common, ok.sum(0)
        inverse.append(w)
    return inverse, sums, number


def _correlated(x: _Pieces, y: _Pieces, inverse: list, sums: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of ``x`` the sum and the number of its correlations with all rows of ``y``, whose ``sums`` and ``number`` these are."""
    total, pairs = np.zeros(len(x.r)), np.zeros(len(x.r))
    for j, rows in enumerate(x.slices()):
        k = np.maximum(y.masks @ x.masks[j], 1)
        total[rows] = (x.r[rows] @ sums[:, j].T * inverse[j]) @ (1 / k)
        pairs[rows] = (inverse[j] > 0) @ number[:, j]
    return total, pairs


def _correlation_sums(r: np.ndarray, own: np.ndarray, a: int, b: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of ``r`` (NaN where missing) the sum and number of its correlations with the rows of the other block (with the others, if ``a`` is ``b``)."""
    known = ~np.isnan(r)
    r = np.where(known, r, 0.0)
    total, pairs = np.zeros(len(r)), np.zeros(len(r))
    one = _pieces(r, known, np.flatnonzero(own == a))
    two = one if a == b else _pieces(r, known, np.flatnonzero(own == b))
    for i, x in enumerate(one):
        for y in two[i:] if a == b else two:
            of_x = _towards(x, y.masks, least)
            of_y = of_x if x is y else _towards(y, x.masks, least)
            for p, q, to, of in ((x, y, of_x, of_y),) if x is y else ((x, y, of_x, of_y), (y, x, of_y, of_x)):
                t, n = _correlated(p, q, to[0], of[1], of[2])
                total[p.rows] += t
                pairs[p.rows] += n
    if a == b:  # less each row's correlation with itself
        k = known.sum(1)
        var = (r * r).sum(1) / np.maximum(k, 1) - (r.sum(1) / np.maximum(k, 1)) ** 2
        itself = (own == a) & (k >= least) & (var > EPS)
        total, pairs = total - itself, pairs - itself
    return total, pairs


def scc(panel: DataFrame, n: int = 20, at_least: int | None = None, block: int = 100_000) -> DataFrame:
    """``(stock, dt, scc)``: mean correlation of a stock's returns with all others over the last ``n`` dates."""
    found = scc_sums(panel, n, at_least, block).groupBy("stock", "dt").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return found.select("stock", "dt", (F.col("total") / F.col("pairs")).alias("scc"))


def scc_sums(panel: DataFrame, n: int = 20, at_least: int | None = None, block: int = 100_000) -> DataFrame:
    """``(stock, dt, total, pairs)``: sum and number of a stock's correlations with the others, a row for each block that they are in.

    A pair counts with at least ``n // 2`` common dates and variance on both sides.  Stocks are dealt to blocks of about
    ``block``, dates to spans of ``n // 2``; two blocks meet in one task with a span and the ``n - 1`` dates before it, and a
    stock's sums over blocks are added up.  Windows that miss the same dates are one group: a group's scores over the dates
    that it shares with another are summed by date once, and a row's sum of correlations with the whole group is one product
    with them.  So the cost is that of rows times patterns of gaps, not of all pairs, unless each window has its own gaps.
    """
    least = n // 2 if at_least is None else at_least
    span = max(1, n // 2)
    one = Window.partitionBy(F.lit(1))  # a row a date
    dates = panel.where("dt IS NOT NULL").groupBy("dt").agg(F.count("*").alias("width"))
    calendar = dates.select("dt", (F.row_number().over(one.orderBy("dt")) - 1).alias("i"), F.ceil(F.max("width").over(one) / block).cast("int").alias("blocks"), (F.count("*").over(one) - 1).alias("last"))
    rows = panel.where("ret IS NOT NULL AND NOT isnan(ret)").select("stock", "dt", "ret").join(F.broadcast(calendar), "dt").where("i > 0").drop("dt")
    first, final = F.greatest(F.lit(0), F.ceil((F.col("i") - n - span + 1) / span)), F.floor((F.col("i") - 1) / span)
    cells = rows.repartition("stock").withColumn("span", F.explode(F.sequence(first.cast("int"), final.cast("int")))).where(F.col("span") * span + n <= F.col("last"))
    held = cells.groupBy("stock", "span", "blocks").agg(F.collect_list(F.struct("i", "ret")).alias("c"))
    held = held.select("stock", "span", "blocks", F.pmod(F.xxhash64("stock"), F.col("blocks")).cast("int").alias("own"), F.col("c.i").alias("i"), F.col("c.ret").alias("ret"))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})

    def sums(key: tuple, part: pa.Table) -> pa.Table:
        start, a, b = (k.as_py() for k in key)
        part = part.combine_chunks()
        at, ret, own = part.column("i").chunk(0), part.column("ret").chunk(0), part.column("own").to_numpy()
        wide = np.full((part.num_rows, n + span - 1), np.nan)
        wide[np.repeat(np.arange(part.num_rows), np.asarray(at.value_lengths())), np.asarray(at.flatten()) - start * span - 1] = np.asarray(ret.flatten())
        found = []
        for k in range(span):
            total, pairs = _correlation_sums(wide[:, k : k + n], own, a, b, least)
            good = np.flatnonzero(pairs)
            found.append(pa.table({"stock": part.column("stock").take(pa.array(good)), "i": pa.array(np.full(len(good), start * span + n + k, np.int32)), "total": total[good], "pairs": pairs[good].astype(np.int64)}))
        return pa.concat_tables(found)

    kind = panel.schema["stock"].dataType.simpleString()
    found = spread.select("stock", "own", "i", "ret", "span", "a", "b").groupBy("span", "a", "b").applyInArrow(sums, f"stock {kind}, i int, total double, pairs long")
    return found.join(F.broadcast(calendar), "i").select("stock", "dt", "total", "pairs")


def relative_cost(panel: DataFrame, n: int = 252) -> DataFrame:
    """``(stock, dt, arc, vrc, src, krc)``: moments of the price over past prices, weighted by the share that still holds them.

    From row ``n`` + 1 of a stock on.  A stock's history goes to one task: one row a date.
    """
    kind = panel.schema["stock"].dataType.simpleString()

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        p, t = pdf["close_adj"].to_numpy(float), np.nan_to_num(pdf["turnover"].to_numpy(float), nan=0.05)
        names = ["stock", "dt", "arc", "vrc", "src", "krc"]
        if len(p) <= n:
            return pdf.iloc[:0].reindex(columns=names)
        past = np.lib.stride_tricks.sliding_window_view(p, n)[1:]
        turn = np.lib.stride_tricks.sliding_window_view(t, n)[1:]
        now = past[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            rr = np.where(past[:, :-1] > 0, now / past[:, :-1] - 1, np.nan)
        rr = np.concatenate([np.zeros((len(rr), 1)), rr], 1)
        age = np.arange(n - 1, -1, -1)
        w = turn * (1 - np.cumsum(turn, 1) / np.arange(1, n + 1)) ** age
        total = w.sum(1, keepdims=True)
        w = np.where(total > 1e-10, w / np.where(total > 1e-10, total, 1), 1 / n)
        valid = ~np.isnan(rr)
        w = np.where(valid & (w > 0), w, 0)
        sums = w.sum(1, keepdims=True)
        w = w / np.where(sums > 0, sums, 1)
        rr = np.nan_to_num(rr)
        mean = (w * rr).sum(1)
        d = rr - mean[:, None]
        var = (w * d**2).sum(1)
        flat = var <= EPS
        safe = np.where(flat, 1, var)
        out = pdf.iloc[n:][["stock", "dt"]].assign(arc=mean, vrc=var, src=np.where(flat, 0, (w * d**3).sum(1) / safe**1.5), krc=np.where(flat, 0, (w * d**4).sum(1) / safe**2 - 3))
        return out[(valid.sum(1) >= 10)][names]

    return panel.select("stock", "dt", "close_adj", "turnover").groupBy("stock").applyInPandas(moments, f"stock {kind}, dt date, arc double, vrc double, src double, krc double")


def _own(panel: DataFrame, n: int, long: int) -> DataFrame:
    """The factors that need a stock's own history only."""
    df = bias(panel, n)
    for step in (turnover_bias, apb, id_vol, turn20):
        df = step(df, n)
    return candle_shadow(williams_shadow(new_high_ratio(cgo(sue(df), long), n, n), n), n)


def all_factors(panel: DataFrame, n: int = 20, long: int = 252) -> DataFrame:
    """All factors as columns; ``scc`` and ``relative_cost`` make rows of their own and are joined by the caller."""
    return ubl(tcc(_own(panel, n, long), long, min(long, 60)))


#: What the factors are made of.
INPUTS = ("open_price", "high_price", "low_price", "close_price", "volume", "close_adj", "turnover", "ret")


def factor_table(panel: DataFrame, stints: DataFrame | None = None, n: int = 20, long: int = 252) -> DataFrame:
    """All 25 factors as columns (``TABLE``), one row a stock and date; with ``stints`` NULL for dates outside them.

    The panel is written once, dealt by stock, and the wide rows don't move again: cross-sections are means and deviations of
    dates (a row a date, broadcast), and what ``scc`` and ``relative_cost`` give is dealt by stock and put to the panel's rows.
    """
    spark = panel.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # rows dealt by stock meet by stock and date as they lie
    base = written_by(panel.select("stock", "dt", *INPUTS), "panel", "stock")
    both = F.col("candle_above_std").isNotNull() & F.col("williams_below_mean").isNotNull()
    crossed = {"ret": F.col("ret"), "a": F.when(both, F.col("candle_above_std")), "b": F.when(both, F.col("williams_below_mean"))}
    days = candle_shadow(williams_shadow(base, n), n).groupBy("dt").agg(*[f(c).alias(f"{k}_{s}") for k, c in crossed.items() for s, f in (("m", F.avg), ("s", F.stddev_samp))])
    days = written(days, "days").withColumnRenamed("dt", "day")
    found = scc_sums(base, n).repartition(partitions(spark), "stock").groupBy("stock", "dt").agg((F.sum("total") / F.sum("pairs")).alias("scc"))
    cost = relative_cost(base, long).repartition(partitions(spark), "stock")
    whole = base.join(found, ["stock", "dt"], "left").join(cost, ["stock", "dt"], "left")
    if stints is not None:
        per = stints.groupBy("stock").agg(F.collect_list(F.struct("in_date", "out_date")).alias("stints"))
        inside = F.exists("stints", lambda s: (s["in_date"] <= F.col("dt")) & (s["out_date"].isNull() | (s["out_date"] >= F.col("dt"))))
        whole = whole.join(per, "stock", "left").withColumn("inside", inside).drop("stints")
    z = {k: (c - F.col(f"{k}_m")) / (F.col(f"{k}_s") + EPS) for k, c in crossed.items()}
    df = _own(whole, n, long).join(F.broadcast(days), F.col("dt").eqNullSafe(F.col("day")), "left")
    df = with_long_mean(df.withColumns({"_z2": F.pow(z["ret"], 2), "ubl": (z["a"] + z["b"]) / 2}), "_z2", long, "_mean", min(long, 60)).withColumn("tcc", 1 / (F.col("_mean") + EPS))
    return df.select("stock", "dt", *[F.col(f) if stints is None else F.when(F.col("inside"), F.col(f)).alias(f) for f in TABLE])


def tidy(panel: DataFrame, *factors: str) -> DataFrame:
    """``(factor, stock, dt, value)`` of factor columns."""
    return panel.select("stock", "dt", *factors).unpivot(["stock", "dt"], list(factors), "factor", "value")
