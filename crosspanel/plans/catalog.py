"""Every query by name: what runs on Spark, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.stats import cross_section
from crosspanel.operators import asof, backtest, combine, evaluate, factors, features, legacy, membership, preprocess, sequence_factors, strategy, trees
from crosspanel.plans import sql
from crosspanel.sources import files, tables
from crosspanel.sources.shared import new_folder, written
from crosspanel.sources.stages import Stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *parts: str):
    """Register a function as a query, with its SQL if ``parts`` are given."""

    def put(f):
        QUERIES[name] = f
        if parts:
            ORACLES[name] = sql.query(*parts)
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The factors that the evaluation queries share, tidy and rounded, and the returns."""
    wide = study_wide(spark, sf_dir)
    return factors.tidy(wide, *sql.FACTORS), wide.select("stock", "dt", "ret")


def study_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same factors as columns, written once: a row a stock and date, however many transactions there are."""
    panel = tables.prices(spark, sf_dir)
    df = factors.new_high_ratio(factors.turnover_bias(factors.turn20(factors.id_vol(factors.apb(factors.bias(panel))))))
    return written(rounded(df.select("stock", "dt", "ret", *sql.FACTORS), *sql.FACTORS), "study")


def signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tidy, returns = study(spark, sf_dir)
    return tidy.where(F.col("factor").isin(*sql.SIGNALS)).withColumnRenamed("factor", "signal"), returns


PANEL, WEEK, STUDY, MEMBERS = sql.panel(), sql.panel("week"), sql.STUDY, sql.MEMBERS
D = "CAST('{}' AS DATE)".format
EARLY, LATE = "1996-01-01", "2000-06-01"

# ---- sources, repair, joins -------------------------------------------------------------------------------------


@query("bars", PANEL, "SELECT stock, dt, open_price, high_price, low_price, close_price, volume, amount FROM bar")
def _(spark, d):
    return tables.trade_bars(spark, d)


@query("bars_week", WEEK, "SELECT stock, dt, open_price, high_price, low_price, close_price, volume, amount FROM bar")
def _(spark, d):
    return tables.trade_bars(spark, d, "week")


EVENT_SQL = """e AS (SELECT user_id AS stock, CAST(ts AS DATE) AS dt, value, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rd FROM events)"""
EVENT_BARS = "SELECT stock, dt, MAX(CASE WHEN rn=1 THEN value END) AS open_price, MAX(value) AS high_price, MIN(value) AS low_price, MAX(CASE WHEN rd=1 THEN value END) AS close_price, CAST(COUNT(*) AS DOUBLE) AS volume, ROUND(SUM(value), 2) AS amount FROM e GROUP BY stock, dt"


@query("event_bars", EVENT_SQL, EVENT_BARS)
def _(spark, d):
    return tables.event_bars(spark, d)


@query("panel", PANEL, sql.rounded("close_adj, vwap, turnover", "px", "stock, dt, close_price, volume, amount"))
def _(spark, d):
    return rounded(tables.prices(spark, d).select("stock", "dt", "close_price", "volume", "amount", "close_adj", "vwap", "turnover"), "close_adj", "vwap", "turnover")


@query("returns", PANEL, sql.rounded("ret", "rt", "stock, dt", "ret IS NOT NULL"))
def _(spark, d):
    return rounded(tables.prices(spark, d).select("stock", "dt", "ret").where("ret is not null"), "ret")


@query("log_returns", PANEL, sql.rounded("log_ret", "rt", "stock, dt", "log_ret IS NOT NULL"))
def _(spark, d):
    return rounded(tables.prices(spark, d).select("stock", "dt", "log_ret").where("log_ret is not null"), "log_ret")


@query("market_return", PANEL, sql.INDEX, sql.rounded("index_close, market_return", "ix", "dt"))
def _(spark, d):
    return rounded(tables.market_index(tables.trade_bars(spark, d)), "index_close", "market_return")


@query("turnover_rate", PANEL, sql.rounded("turnover", "px", "stock, dt"))
def _(spark, d):
    return rounded(tables.prices(spark, d).select("stock", "dt", "turnover"), "turnover")


@query("enrich_left_joins", PANEL, sql.INDEX, "SELECT stock, px.dt, total_mv, ROUND(turnover, 8) AS turnover, ROUND(market_return, 8) AS market_return FROM px LEFT JOIN ix ON ix.dt = px.dt")
def _(spark, d):
    raw = tables.trade_bars(spark, d)
    got = preprocess.with_market(preprocess.enrich(raw, tables.market_value(spark, d)), tables.market_index(raw))
    return rounded(got.select("stock", "dt", "total_mv", "turnover", "market_return"), "turnover", "market_return")


@query("xs_mean_return", PANEL, "SELECT dt, ROUND(AVG(ret), 8) AS xs_ret FROM rt GROUP BY dt HAVING AVG(ret) IS NOT NULL")
def _(spark, d):
    return rounded(preprocess.mean_return(tables.prices(spark, d)).groupBy("dt").agg(F.first("xs_ret").alias("xs_ret")).where("xs_ret is not null"), "xs_ret")


@query("scan_membership", PANEL, MEMBERS, "SELECT stock, in_date, out_date FROM stints")
def _(spark, d):
    return tables.membership(spark, d)


@query("scan_prices_semi", PANEL, MEMBERS, f"SELECT stock, dt, close_price, volume FROM bar WHERE dt >= DATE '{EARLY}' AND dt <= DATE '{LATE}' AND EXISTS (SELECT 1 FROM stints s WHERE s.stock = bar.stock)")
def _(spark, d):
    wanted = tables.membership(spark, d).select("stock")
    bars = tables.trade_bars(spark, d, since=EARLY, until="2000-07-01")  # the whole month of LATE
    return bars.join(wanted, "stock", "left_semi").select("stock", "dt", "close_price", "volume")


@query("like_semi", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type LIKE '%A%' AND p_brand NOT LIKE '%1' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def _(spark, d):
    sold = tables.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    part = tables.table(spark, d, "part").where(F.col("p_type").like("%A%") & ~F.col("p_brand").like("%1"))
    return part.join(sold, "p_partkey", "left_semi").select("p_partkey", "p_name", "p_retailprice")


ORACLES["like_semi"] = ORACLES["like_semi"].removeprefix("WITH \n")


#: The months of the given tables.
CALENDAR = [f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in range(1, 13)]
WIDE = [f"m{day[:7].replace('-', '_')}" for day in CALENDAR]


@query("long_to_wide", PANEL, "SELECT stock, " + ", ".join(f"MAX(CASE WHEN dt = DATE '{day}' THEN close_price END) AS {m}" for day, m in zip(CALENDAR, WIDE, strict=True)) + " FROM bar GROUP BY stock")
def _(spark, d):
    bars = tables.trade_bars(spark, d).withColumn("dt", F.col("dt").cast("string"))
    return files.long_to_wide(bars, "close_price", CALENDAR).toDF("stock", *WIDE)


@query("wide_to_long", PANEL, "SELECT stock, dt, close_price AS value FROM bar WHERE close_price IS NOT NULL")
def _(spark, d):
    bars = tables.trade_bars(spark, d).withColumn("dt", F.col("dt").cast("string"))
    return files.wide_to_long(files.long_to_wide(bars, "close_price", CALENDAR))


@query("factor_summary", PANEL, STUDY, "SELECT factor, COUNT(DISTINCT stock) AS n_stocks, COUNT(DISTINCT dt) AS n_dates, COUNT(value) AS n_values, ROUND(100 * (1 - COUNT(value) / CAST(COUNT(DISTINCT stock) * COUNT(DISTINCT dt) AS DOUBLE)), 6) AS missing_pct FROM tidy GROUP BY factor")
def _(spark, d):
    return files.factor_summary(study(spark, d)[0])


# ---- membership -------------------------------------------------------------------------------------------------

INSIDE = "in_date <= {0} AND (out_date IS NULL OR out_date >= {0})".format


@query("members_asof", PANEL, MEMBERS, f"SELECT DISTINCT stock FROM stints WHERE {INSIDE(D(LATE))}")
def _(spark, d):
    return membership.members_asof(tables.membership(spark, d), LATE)


@query("member_mask", PANEL, MEMBERS, f"SELECT s.stock, EXISTS (SELECT 1 FROM stints m WHERE m.stock = s.stock AND {INSIDE(D(LATE))}) AS is_member FROM (SELECT DISTINCT stock FROM bar) s")
def _(spark, d):
    return membership.member_mask(tables.trade_bars(spark, d), tables.membership(spark, d), LATE)


@query("members_both_ends", PANEL, MEMBERS, f"SELECT DISTINCT stock FROM stints WHERE {INSIDE(D(EARLY))} AND {INSIDE(D(LATE))}")
def _(spark, d):
    return membership.members_both_ends(tables.membership(spark, d), EARLY, LATE)


@query("members_overlap", PANEL, MEMBERS, f"SELECT DISTINCT stock FROM stints WHERE in_date <= {D(LATE)} AND (out_date IS NULL OR out_date >= {D('2000-01-01')})")
def _(spark, d):
    return membership.members_overlap(tables.membership(spark, d), "2000-01-01", LATE)


@query("filter_members", PANEL, MEMBERS, f"SELECT stock, dt, close_price FROM bar WHERE EXISTS (SELECT 1 FROM stints m WHERE m.stock = bar.stock AND {INSIDE('bar.dt')})")
def _(spark, d):
    return membership.filter_members(tables.trade_bars(spark, d), tables.membership(spark, d)).select("stock", "dt", "close_price")


@query("member_matrix", PANEL, MEMBERS, f"SELECT s.stock, c.dt, EXISTS (SELECT 1 FROM stints m WHERE m.stock = s.stock AND {INSIDE('c.dt')}) AS is_member FROM (SELECT DISTINCT stock FROM stints) s CROSS JOIN (SELECT DISTINCT dt FROM bar) c")
def _(spark, d):
    return membership.member_matrix(tables.membership(spark, d), tables.trade_bars(spark, d).select("dt"))


@query("mask_nonmembers", PANEL, STUDY, MEMBERS, f"SELECT factor, stock, dt, CASE WHEN EXISTS (SELECT 1 FROM stints m WHERE m.stock = tidy.stock AND {INSIDE('tidy.dt')}) THEN value END AS value FROM tidy")
def _(spark, d):
    return membership.mask_nonmembers(study(spark, d)[0], tables.membership(spark, d), "value")


@query("universe", PANEL, MEMBERS, f"SELECT DISTINCT stock FROM stints WHERE in_date <= {D(LATE)}")
def _(spark, d):
    return membership.universe(tables.membership(spark, d), LATE)


@query("align_intersect", PANEL, STUDY, "SELECT DISTINCT stock, dt FROM ft WHERE dt IN (SELECT dt FROM ft WHERE bias IS NOT NULL INTERSECT SELECT dt FROM ft WHERE id_vol IS NOT NULL) AND stock IN (SELECT stock FROM ft WHERE bias IS NOT NULL INTERSECT SELECT stock FROM ft WHERE id_vol IS NOT NULL) AND bias IS NOT NULL")
def _(spark, d):
    wide = study_wide(spark, d)
    return evaluate.align(wide.where("bias is not null"), wide.where("id_vol is not null"))


# ---- factors ----------------------------------------------------------------------------------------------------


def _factor(name: str, columns: tuple[str, ...], f, ctes: list[str], exprs: list[str], source: str, grain: str = "month"):
    where = " OR ".join(f"{c} IS NOT NULL" for c in columns)
    inner = ", ".join(f"{e} AS {c}" for e, c in zip(exprs, columns, strict=True))
    text = f"SELECT stock, dt, {', '.join(f'ROUND({c}, 8) AS {c}' for c in columns)} FROM (SELECT stock, dt, {inner} FROM {source}) q WHERE {where}"

    @query(name, sql.panel(grain), *ctes, text)
    def _(spark, d):
        got = f(tables.prices(spark, d, grain)).select("stock", "dt", *columns)
        return rounded(got.where(" or ".join(f"{c} is not null" for c in columns)), *columns)


_factor("bias", ("bias",), factors.bias, [STUDY], ["bias"], "ft")
_factor("apb", ("apb",), factors.apb, [STUDY], ["apb"], "ft")
_factor("turnover_bias", ("turnover_bias",), factors.turnover_bias, [STUDY], ["turnover_bias"], "ft")
_factor("new_high_ratio", ("new_high_ratio",), factors.new_high_ratio, [STUDY], ["new_high_ratio"], "ft")
_factor("id_vol", ("id_vol", "id_vol_decorr"), factors.id_vol, [STUDY], ["id_vol", "id_vol"], "ft")
_factor("turn20", ("turn20",), factors.turn20, [STUDY], ["turn20"], "ft")
CGO = "CASE WHEN ROW_NUMBER() OVER (PARTITION BY stock ORDER BY dt) > 252 THEN (close_adj - AVG(close_adj) OVER {0}) / (AVG(close_adj) OVER {0} + 1e-8) END".format(sql.over(252))
_factor("cgo", ("cgo", "rcgo"), factors.cgo, [], [CGO, CGO], "rt", "week")
TCC = ["zx AS (SELECT stock, dt, POWER((ret - AVG(ret) OVER (PARTITION BY dt)) / (STDDEV_SAMP(ret) OVER (PARTITION BY dt) + 1e-8), 2) AS z2 FROM rt)"]
_factor("tcc", ("tcc",), factors.tcc, TCC, [f"1 / ({sql.roll('AVG', 'z2', 252, 60)} + 1e-8)"], "zx", "week")
SHADOW = [
    "sh0 AS (SELECT *, ABS(GREATEST(open_price, close_price) - high_price) AS cu, low_price - LEAST(open_price, close_price) AS cl, ABS(close_price - high_price) AS wu, close_price - low_price AS wl FROM rt)",
    "sh1 AS (SELECT stock, dt, " + ", ".join(f"{c} / ({sql.roll('AVG', c, 5)} + 1e-8) AS {c}" for c in ("cu", "cl", "wu", "wl")) + " FROM sh0)",
]
for _kind, _f, _u, _l in (("candle", factors.candle_shadow, "cu", "cl"), ("williams", factors.williams_shadow, "wu", "wl")):
    _factor(f"{_kind}_shadow", tuple(f"{_kind}_{s}_{t}" for s in ("above", "below") for t in ("mean", "std")), _f, SHADOW, [sql.roll("AVG", _u, 20), sql.roll("STDDEV_SAMP", _u, 20), sql.roll("AVG", _l, 20), sql.roll("STDDEV_SAMP", _l, 20)], "sh1")
UBL = [
    *SHADOW,
    f"ub0 AS (SELECT stock, dt, {sql.roll('STDDEV_SAMP', 'cu', 20)} AS a, {sql.roll('AVG', 'wl', 20)} AS b FROM sh1)",
    "ub1 AS (SELECT * FROM ub0 WHERE a IS NOT NULL AND b IS NOT NULL)",
]
_factor("ubl", ("ubl",), lambda p: factors.ubl(factors.williams_shadow(factors.candle_shadow(p))), UBL, ["((a - AVG(a) OVER (PARTITION BY dt)) / (STDDEV_SAMP(a) OVER (PARTITION BY dt) + 1e-8) + (b - AVG(b) OVER (PARTITION BY dt)) / (STDDEV_SAMP(b) OVER (PARTITION BY dt) + 1e-8)) / 2"], "ub1")


@query("sue", PANEL, "SELECT stock, dt, CAST(NULL AS DOUBLE) AS sue FROM bar")
def _(spark, d):
    return factors.sue(tables.trade_bars(spark, d)).select("stock", "dt", "sue")


SCC = [
    "sd0 AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM rt) q)",
    "sr AS (SELECT stock, i, ret FROM rt JOIN sd0 ON sd0.dt = rt.dt WHERE ret IS NOT NULL)",
    "sx AS (SELECT d.i AS anchor, r.stock, r.i, r.ret FROM sr r JOIN sd0 d ON r.i > d.i - 20 AND r.i <= d.i WHERE d.i >= 20)",
    f"sp AS (SELECT a.anchor, a.stock, {sql.corr('a.ret', 'b.ret')} AS c FROM sx a JOIN sx b ON a.anchor = b.anchor AND a.i = b.i AND a.stock <> b.stock GROUP BY a.anchor, a.stock, b.stock HAVING COUNT(*) >= 10 AND VAR_POP(a.ret) > 1e-8 AND VAR_POP(b.ret) > 1e-8)",
]


@query("scc", PANEL, *SCC, "SELECT stock, dt, ROUND(AVG(c), 8) AS scc FROM sp JOIN sd0 ON sd0.i = sp.anchor GROUP BY stock, dt")
def _(spark, d):
    return rounded(factors.scc(written(tables.prices(spark, d).select("stock", "dt", "ret"), "panel")), "scc")


def _cost(n: int) -> list[str]:
    return [
        f"rc0 AS (SELECT stock, dt, close_adj, ROW_NUMBER() OVER (PARTITION BY stock ORDER BY dt) AS k, LIST(close_adj) OVER {sql.over(n)} AS p, LIST(turnover) OVER {sql.over(n)} AS t FROM rt)",
        f"rc1 AS (SELECT stock, dt, close_adj, p, t, UNNEST(RANGE(1, {n + 1})) AS j FROM rc0 WHERE k > {n})",
        "rc2 AS (SELECT stock, dt, j, t[j] AS tj, SUM(t[j]) OVER (PARTITION BY stock, dt ORDER BY j) / j AS tm, CASE WHEN j = 1 THEN 0 ELSE close_adj / p[j - 1] - 1 END AS rr FROM rc1)",
        f"rc3 AS (SELECT stock, dt, rr, tj * POWER(1 - tm, {n} - j) AS w FROM rc2)",
        "rc4 AS (SELECT stock, dt, rr, w / SUM(w) OVER (PARTITION BY stock, dt) AS w FROM rc3)",
        "rc5 AS (SELECT *, SUM(w * rr) OVER (PARTITION BY stock, dt) AS m FROM rc4)",
        "rc6 AS (SELECT stock, dt, m AS arc, SUM(w * POWER(rr - m, 2)) AS vrc, SUM(w * POWER(rr - m, 3)) AS m3, SUM(w * POWER(rr - m, 4)) AS m4 FROM rc5 GROUP BY stock, dt, m)",
    ]


MOMENTS = "ROUND(arc, 8) AS arc, ROUND(vrc, 8) AS vrc, ROUND(CASE WHEN vrc > 1e-8 THEN m3 / POWER(vrc, 1.5) ELSE 0 END, 6) AS src, ROUND(CASE WHEN vrc > 1e-8 THEN m4 / (vrc * vrc) - 3 ELSE 0 END, 6) AS krc"


@query("relative_cost", PANEL, *_cost(20), f"SELECT stock, dt, {MOMENTS} FROM rc6")
def _(spark, d):
    return rounded(rounded(factors.relative_cost(tables.prices(spark, d), 20), "arc", "vrc"), "src", "krc", digits=6)


@query("relative_cost_year", WEEK, *_cost(252), f"SELECT stock, dt, {MOMENTS} FROM rc6")
def _(spark, d):
    return rounded(rounded(factors.relative_cost(tables.prices(spark, d, "week")), "arc", "vrc"), "src", "krc", digits=6)


TABLE = [
    WEEK, MEMBERS, STUDY, *UBL, *TCC, *SCC, *_cost(252),
    f"t1 AS (SELECT stock, dt, {CGO} AS cgo FROM rt)",
    f"t2 AS (SELECT stock, dt, 1 / ({sql.roll('AVG', 'z2', 252, 60)} + 1e-8) AS tcc FROM zx)",
    "t3 AS (SELECT stock, dt, " + ", ".join(f"{sql.roll(agg, c, 20)} AS {kind}_{side}_{stat}" for kind, side, c in (("candle", "above", "cu"), ("candle", "below", "cl"), ("williams", "above", "wu"), ("williams", "below", "wl")) for stat, agg in (("mean", "AVG"), ("std", "STDDEV_SAMP"))) + " FROM sh1)",
    "t4 AS (SELECT stock, dt, ((a - AVG(a) OVER (PARTITION BY dt)) / (STDDEV_SAMP(a) OVER (PARTITION BY dt) + 1e-8) + (b - AVG(b) OVER (PARTITION BY dt)) / (STDDEV_SAMP(b) OVER (PARTITION BY dt) + 1e-8)) / 2 AS ubl FROM ub1)",
    "t5 AS (SELECT stock, dt, AVG(c) AS scc FROM sp JOIN sd0 ON sd0.i = sp.anchor GROUP BY stock, dt)",
    f"t6 AS (SELECT stock, dt, {MOMENTS} FROM rc6)",
    f"inside AS (SELECT DISTINCT bar.stock, bar.dt FROM bar JOIN stints m ON m.stock = bar.stock AND {INSIDE('bar.dt')})",
]
FROM_TABLE = {"id_vol_decorr": "ROUND(ft.id_vol, 8)", "cgo": "ROUND(t1.cgo, 8)", "rcgo": "ROUND(t1.cgo, 8)", "sue": "CAST(NULL AS DOUBLE)", **{f: f"ROUND(t6.{f}, {k})" for f, k in (("arc", 8), ("vrc", 8), ("src", 6), ("krc", 6))}}


@query(
    "factor_table", *TABLE,
    "SELECT ft.stock, ft.dt, " + ", ".join(f"CASE WHEN inside.stock IS NOT NULL THEN {FROM_TABLE.get(f, f'ROUND({f}, 8)')} END AS {f}" for f in factors.TABLE)
    + " FROM ft" + "".join(f" LEFT JOIN {t} ON {t}.stock = ft.stock AND {t}.dt = ft.dt" for t in ("t1", "t2", "t3", "t4", "t5", "t6", "inside")),
)
def _(spark, d):
    got = factors.factor_table(tables.prices(spark, d, "week", dealt=True), tables.membership(spark, d))
    return rounded(rounded(got, *[f for f in factors.TABLE if f not in ("sue", "src", "krc")]), "src", "krc", digits=6)


ALL = [STUDY, *SHADOW, *UBL[2:], "al AS (SELECT ft.*, c.a, c.b FROM ft LEFT JOIN ub0 c ON c.stock = ft.stock AND c.dt = ft.dt)"]


@query("all_factors", PANEL, *ALL, "SELECT stock, dt, " + ", ".join(f"ROUND({f}, 8) AS {f}" for f in sql.FACTORS) + ", ROUND(a, 8) AS candle_above_std, ROUND(b, 8) AS williams_below_mean FROM al")
def _(spark, d):
    names = (*sql.FACTORS, "candle_above_std", "williams_below_mean")
    return rounded(factors.all_factors(tables.prices(spark, d)).select("stock", "dt", *names), *names)


# ---- evaluation -------------------------------------------------------------------------------------------------


@query("forward_return", PANEL, sql.FORWARD, sql.rounded("fwd", "fwd", "stock, dt"))
def _(spark, d):
    return rounded(evaluate.forward_return(tables.prices(spark, d)), "fwd")


CUMULATIVE = [
    "fw3 AS (SELECT r.stock, c.dt, PRODUCT(1 + r.ret) - 1 AS fwd, COUNT(*) AS n FROM rt r JOIN cal b ON b.dt = r.dt JOIN cal c ON b.i > c.i AND b.i <= c.i + 3 WHERE r.ret IS NOT NULL GROUP BY r.stock, c.dt)",
]


@query("forward_return_cumulative", PANEL, sql.FORWARD, *CUMULATIVE, sql.rounded("fwd", "fw3", "stock, dt", "n = 3"))
def _(spark, d):
    returns = written(tables.prices(spark, d).select("stock", "dt", "ret"), "returns")
    return rounded(evaluate.forward_return(returns, 3, cumulative=True), "fwd")


@query("ic", PANEL, STUDY, sql.FORWARD, sql.IC, sql.rounded("ic", "ics", "factor, dt, n"))
def _(spark, d):
    return rounded(evaluate.ic(*study(spark, d)), "ic")


RANKS = [
    "pr AS (SELECT factor, t.dt, value, fwd FROM tidy t JOIN fwd ON fwd.stock = t.stock AND fwd.dt = t.dt WHERE value IS NOT NULL)",
    "rr AS (SELECT factor, dt, RANK() OVER (PARTITION BY factor, dt ORDER BY value) + (COUNT(*) OVER (PARTITION BY factor, dt, value) - 1) / 2.0 AS a, RANK() OVER (PARTITION BY factor, dt ORDER BY fwd) + (COUNT(*) OVER (PARTITION BY factor, dt, fwd) - 1) / 2.0 AS b FROM pr)",
]


@query("rank_ic", PANEL, STUDY, sql.FORWARD, *RANKS, f"SELECT factor, dt, COUNT(*) AS n, ROUND({sql.corr('a', 'b')}, 8) AS rank_ic FROM rr GROUP BY factor, dt HAVING COUNT(*) >= 10 AND {sql.corr('a', 'b')} IS NOT NULL")
def _(spark, d):
    return rounded(evaluate.rank_ic(*study(spark, d)), "rank_ic")


@query("ir_summary", PANEL, STUDY, sql.FORWARD, sql.IC, sql.rounded("ic_mean, ic_std, ir, positive, skew", "irs", "factor, n"))
def _(spark, d):
    return rounded(evaluate.ir_summary(evaluate.ic(*study(spark, d))), "ic_mean", "ic_std", "ir", "positive", "skew")


@query("layer_weights", PANEL, STUDY, sql.layers(), "SELECT factor, CAST(i AS INTEGER) AS i, layer, stock, ROUND(weight, 8) AS weight FROM lw")
def _(spark, d):
    return rounded(evaluate.layer_weights(study(spark, d)[0]), "weight")


@query("layer_nav", PANEL, STUDY, sql.layers(), sql.rounded("turnover, nav", "nav", "factor, layer, dt"))
def _(spark, d):
    return rounded(evaluate.layer_nav(*study(spark, d)), "turnover", "nav")


@query("monotonicity", PANEL, STUDY, sql.layers(), sql.MONOTONE, "SELECT factor, is_monotone, direction FROM mono")
def _(spark, d):
    return evaluate.monotonicity(evaluate.layer_nav(*study(spark, d)))


@query("long_short", PANEL, STUDY, sql.layers(), sql.SPREAD, sql.rounded("total, annual, sharpe", "ls", "factor"))
def _(spark, d):
    return rounded(evaluate.long_short(evaluate.layer_nav(*study(spark, d))), "total", "annual", "sharpe")


RETRY = "both_ AS (SELECT 'p|' || factor AS factor, stock, dt, value FROM tidy UNION ALL SELECT 'a|' || factor, stock, dt, ABS(value) FROM tidy)"


@query(
    "abs_retry", PANEL, STUDY, RETRY, sql.layers("both_"), sql.MONOTONE,
    "SELECT SUBSTR(p.factor, 3) AS factor, NOT p.is_monotone AND a.is_monotone AS use_abs, CASE WHEN NOT p.is_monotone AND a.is_monotone THEN a.direction ELSE COALESCE(p.direction, 'positive') END AS direction FROM mono p JOIN mono a ON SUBSTR(a.factor, 3) = SUBSTR(p.factor, 3) AND p.factor LIKE 'p|%' AND a.factor LIKE 'a|%'",
)
def _(spark, d):
    return evaluate.abs_retry(*study(spark, d))


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, COUNT(*) AS n, {sql.corr(a, b)} AS corr FROM (SELECT ROUND({a}, 8) AS {a}, ROUND({b}, 8) AS {b} FROM ft WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q" for k, a in enumerate(sql.FACTORS) for b in sql.FACTORS[k + 1 :])
CORR = f"fcr AS ({PAIRS})"


@query("factor_corr", PANEL, STUDY, CORR, sql.rounded("corr", "fcr", "a, b, n"))
def _(spark, d):
    return rounded(evaluate.factor_corr(study_wide(spark, d), list(sql.FACTORS)), "corr")


@query("high_corr_pairs", PANEL, STUDY, CORR, sql.rounded("corr", "fcr", "a, b, n", "ABS(corr) >= 0.05"))
def _(spark, d):
    return rounded(evaluate.high_corr_pairs(evaluate.factor_corr(study_wide(spark, d), list(sql.FACTORS)), 0.05), "corr")


PRUNED = [
    "pr AS (SELECT a, b, ROW_NUMBER() OVER (ORDER BY ABS(corr) DESC, a, b) AS k FROM fcr WHERE ABS(corr) >= 0.05)",
    "walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS keep, CAST([] AS VARCHAR[]) AS gone UNION ALL SELECT k, keep, CASE WHEN list_contains(keep, b) OR list_contains(gone, b) THEN gone ELSE list_append(gone, b) END FROM (SELECT p.k, CASE WHEN list_contains(w.gone, p.a) OR list_contains(w.keep, p.a) THEN w.keep ELSE list_append(w.keep, p.a) END AS keep, w.gone, p.b FROM walk w JOIN pr p ON p.k = w.k + 1) q)",
    "ended AS (SELECT ARG_MAX(keep, k) AS keep, ARG_MAX(gone, k) AS gone FROM walk)",
]


@query("pruned_factors", PANEL, STUDY, CORR, *PRUNED, "SELECT UNNEST(keep) AS factor, TRUE AS keep FROM ended UNION ALL SELECT UNNEST(gone), FALSE FROM ended")
def _(spark, d):
    keep, drop = evaluate.pruned(evaluate.factor_corr(study_wide(spark, d), list(sql.FACTORS)), 0.05)
    return spark.createDataFrame([(f, True) for f in keep] + [(f, False) for f in drop], "factor string, keep boolean")


@query("top5_ir", PANEL, STUDY, sql.FORWARD, sql.IC, "SELECT factor, ROUND(ir, 8) AS ir FROM irs ORDER BY ir DESC NULLS LAST, factor LIMIT 5")
def _(spark, d):
    return rounded(evaluate.top(evaluate.ir_summary(evaluate.ic(*study(spark, d))), "ir").select("factor", "ir"), "ir")


RANK_IC = f"rks AS (SELECT factor, dt, COUNT(*) AS n, {sql.corr('a', 'b')} AS rank_ic FROM rr GROUP BY factor, dt HAVING COUNT(*) >= 10 AND {sql.corr('a', 'b')} IS NOT NULL)"
RANK_IR = "rirs AS (SELECT factor, AVG(rank_ic) AS rank_ic_mean, STDDEV_SAMP(rank_ic) AS rank_ic_std, AVG(rank_ic) / (STDDEV_SAMP(rank_ic) + 1e-8) AS ir, AVG(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, SKEWNESS(rank_ic) AS skew, COUNT(rank_ic) AS n FROM rks GROUP BY factor)"


@query("rank_ir_summary", PANEL, STUDY, sql.FORWARD, *RANKS, RANK_IC.replace(sql.corr("a", "b") + " AS", f"ROUND({sql.corr('a', 'b')}, 8) AS"), RANK_IR, sql.rounded("rank_ic_mean, rank_ic_std, ir, positive, skew", "rirs", "factor, n"))
def _(spark, d):
    return rounded(evaluate.ir_summary(rounded(evaluate.rank_ic(*study(spark, d)), "rank_ic"), "rank_ic"), "rank_ic_mean", "rank_ic_std", "ir", "positive", "skew")  # so that a zero is a zero


@query("top5_ic", PANEL, STUDY, sql.FORWARD, sql.IC, "SELECT factor, ROUND(ic_mean, 8) AS ic_mean, ROUND(ic_std, 8) AS ic_std, ROUND(ir, 8) AS ir FROM irs WHERE ic_mean IS NOT NULL ORDER BY irs.ic_mean DESC, factor LIMIT 5")
def _(spark, d):
    known = evaluate.ir_summary(evaluate.ic(*study(spark, d))).where("ic_mean is not null")
    return rounded(evaluate.top(known, "ic_mean").select("factor", "ic_mean", "ic_std", "ir"), "ic_mean", "ic_std", "ir")


@query("top5_rank_ic", PANEL, STUDY, sql.FORWARD, *RANKS, RANK_IC, RANK_IR, "SELECT factor, ROUND(rank_ic_mean, 8) AS rank_ic_mean, ROUND(rank_ic_std, 8) AS rank_ic_std, ROUND(ir, 8) AS rank_ir FROM rirs WHERE rank_ic_mean IS NOT NULL ORDER BY rirs.rank_ic_mean DESC, factor LIMIT 5")
def _(spark, d):
    known = evaluate.ir_summary(evaluate.rank_ic(*study(spark, d)), "rank_ic").where("rank_ic_mean is not null").withColumnRenamed("ir", "rank_ir")
    return rounded(evaluate.top(known, "rank_ic_mean").select("factor", "rank_ic_mean", "rank_ic_std", "rank_ir"), "rank_ic_mean", "rank_ic_std", "rank_ir")


@query("top5_long_short", PANEL, STUDY, sql.layers(), sql.SPREAD, "SELECT factor, ROUND(total, 8) AS total, ROUND(annual, 8) AS annual, ROUND(sharpe, 8) AS sharpe FROM ls WHERE total IS NOT NULL ORDER BY ls.total DESC, factor LIMIT 5")
def _(spark, d):
    known = evaluate.long_short(evaluate.layer_nav(*study(spark, d))).where("total is not null")
    return rounded(evaluate.top(known, "total").select("factor", "total", "annual", "sharpe"), "total", "annual", "sharpe")


SUMMARY = [STUDY, sql.FORWARD, sql.IC, sql.layers(), sql.MONOTONE, sql.SPREAD]


def _summary(spark, d) -> DataFrame:
    tidy, returns = study(spark, d)
    nav = written(evaluate.layer_nav(tidy, returns), "nav")
    return evaluate.ir_summary(evaluate.ic(tidy, returns)).join(evaluate.long_short(nav), "factor").join(evaluate.monotonicity(nav), "factor")


@query("ic_summary_all", PANEL, *SUMMARY, "SELECT irs.factor, n, ROUND(ic_mean, 8) AS ic_mean, ROUND(ir, 8) AS ir, ROUND(total, 8) AS total, ROUND(sharpe, 8) AS sharpe, is_monotone, direction FROM irs JOIN ls ON ls.factor = irs.factor JOIN mono ON mono.factor = irs.factor")
def _(spark, d):
    return rounded(_summary(spark, d).select("factor", "n", "ic_mean", "ir", "total", "sharpe", "is_monotone", "direction"), "ic_mean", "ir", "total", "sharpe")


@query("composite_rank", PANEL, *SUMMARY, "SELECT irs.factor, ROUND(0.6 * COALESCE((COALESCE(ir, 0) - MIN(COALESCE(ir, 0)) OVER ()) / NULLIF(MAX(COALESCE(ir, 0)) OVER () - MIN(COALESCE(ir, 0)) OVER (), 0), 0) + 0.4 * COALESCE((COALESCE(total, 0) - MIN(COALESCE(total, 0)) OVER ()) / NULLIF(MAX(COALESCE(total, 0)) OVER () - MIN(COALESCE(total, 0)) OVER (), 0), 0), 8) AS score FROM irs JOIN ls ON ls.factor = irs.factor")
def _(spark, d):
    return rounded(evaluate.composite(_summary(spark, d)), "score")


# ---- features ---------------------------------------------------------------------------------------------------

AGREE = "ag AS (SELECT factor, t.dt, value AS x, fwd AS y FROM tidy t JOIN fwd ON fwd.stock = t.stock AND fwd.dt = t.dt WHERE value IS NOT NULL)"


@query("agreement", PANEL, STUDY, sql.FORWARD, AGREE, f"SELECT factor, dt, COUNT(*) AS n, ROUND({sql.corr('x', 'y')}, 8) AS r, ROUND({sql.corr('x', 'y')} * (COUNT(*) - 1) / COUNT(*), 8) AS r_scaled, ROUND(2 * COVAR_POP(x, y) / NULLIF(VAR_POP(x) + VAR_POP(y) + POWER(AVG(x) - AVG(y), 2), 0), 8) AS ccc FROM ag GROUP BY factor, dt")
def _(spark, d):
    tidy, returns = study(spark, d)
    both = tidy.join(evaluate.forward_return(returns), ["stock", "dt"])
    return rounded(features.agreement(both, "value", "fwd", "factor", "dt"), "r", "r_scaled", "ccc")


STANDARD = ["z0 AS (SELECT stock, dt, (ret - AVG(ret) OVER ()) / STDDEV_POP(ret) OVER () AS z FROM rt WHERE ret IS NOT NULL)"]


@query("standardize", PANEL, *STANDARD, "SELECT stock, dt, ROUND(z, 6) AS z, ROUND(ABS(z) / SUM(ABS(z)) OVER (), 10) AS weight FROM z0")
def _(spark, d):
    rows = tables.prices(spark, d).where("ret is not null").select("stock", "dt", "ret")
    return features.standardize(rows, "ret").select("stock", "dt", F.round("z", 6).alias("z"), F.round("weight", 10).alias("weight"))


MONTHS = [
    "md AS (SELECT date_trunc('year', dt) AS p, COUNT(DISTINCT dt) AS days, MAX(dt) AS e FROM rt GROUP BY 1 HAVING COUNT(DISTINCT dt) > 1)",
    "mr AS (SELECT stock, md.p, e AS dt, CASE WHEN COUNT(ret) = MAX(days) THEN PRODUCT(1 + ret) - 1 END AS ret FROM rt JOIN md ON date_trunc('year', rt.dt) = md.p GROUP BY stock, md.p, e)",
]


@query("period_compounded", PANEL, *MONTHS, "SELECT stock, dt, ROUND(ret, 8) AS ret FROM mr")
def _(spark, d):
    return rounded(features.monthly_returns(tables.prices(spark, d).select("stock", "dt", "ret"), "year"), "ret")


@query(
    "labels", PANEL, sql.FORWARD, *MONTHS,
    "SELECT rt.stock, rt.dt, ROUND(fwd, 8) AS daily, ROUND((SELECT ARG_MIN(m.ret, m.p) FROM mr m WHERE m.stock = rt.stock AND m.ret IS NOT NULL AND m.p > date_trunc('year', rt.dt)), 8) AS monthly FROM rt LEFT JOIN fwd ON fwd.stock = rt.stock AND fwd.dt = rt.dt",
)
def _(spark, d):
    return rounded(features.labels(tables.prices(spark, d).select("stock", "dt", "ret"), "year"), "daily", "monthly")


@query("date_split", PANEL, "SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 < FLOOR(COUNT(*) OVER () * CAST(0.8 AS DOUBLE)) AS is_train FROM (SELECT DISTINCT dt FROM bar) q")
def _(spark, d):
    return features.date_split(tables.trade_bars(spark, d).select("dt"))


WALK = ["wd AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM bar) q)", "ws AS (SELECT dt AS model, i AS m FROM wd WHERE i % 12 = 0 AND i > 3)"]


@query("walk_forward", PANEL, *WALK, "SELECT model, 'train' AS role, dt FROM ws JOIN wd ON i >= m - 27 AND i <= m - 4 UNION ALL SELECT model, 'use', dt FROM ws JOIN wd ON i >= m AND i < m + 12")
def _(spark, d):
    return features.walk_forward(tables.trade_bars(spark, d).select("dt"), 12, 24, 3)


STEP = ", ".join(f"{c} AS f{k}" for k, c in enumerate(features.STEPS))
CELLS = [
    f"sq AS (SELECT stock, dt, {STEP}, ROW_NUMBER() OVER (PARTITION BY stock ORDER BY dt) AS k FROM rt)",
    "sa AS (SELECT a.stock, a.dt, CAST(b.k - a.k + 39 AS INTEGER) AS k, a.s, CAST(b.v / (a.v + 1e-8) AS FLOAT) AS v FROM (SELECT stock, dt, k, UNNEST([0,1,2,3,4,5]) AS s, UNNEST([f0,f1,f2,f3,f4,f5]) AS v FROM sq) a JOIN (SELECT stock, k, UNNEST([0,1,2,3,4,5]) AS s, UNNEST([f0,f1,f2,f3,f4,f5]) AS v FROM sq) b ON a.stock = b.stock AND a.s = b.s AND b.k > a.k - 40 AND b.k <= a.k WHERE a.k >= 40 AND (a.k - 40) % 5 = 0)",
]
BY_CELL = "SELECT k, s, COUNT(*) AS n, ROUND(SUM(CAST(v AS DOUBLE)), 2) AS total FROM sa GROUP BY k, s"


@query("sequences", PANEL, *CELLS, BY_CELL)
def _(spark, d):
    cells = features.sequences(tables.prices(spark, d)).select(F.posexplode("x").alias("k", "row")).select("k", F.posexplode("row").alias("s", "v"))
    return cells.groupBy("k", "s").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 2).alias("total"))


@query("sequences_all", PANEL, CELLS[0], CELLS[1].replace(" AND (a.k - 40) % 5 = 0", ""), BY_CELL)
def _(spark, d):
    cells = features.sequences(tables.prices(spark, d), step=1).select(F.posexplode("x").alias("k", "row")).select("k", F.posexplode("row").alias("s", "v"))
    return cells.groupBy("k", "s").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 2).alias("total"))


MED = ["sm AS (SELECT k, s, MEDIAN(CAST(v AS DOUBLE)) AS med FROM sa GROUP BY k, s)"]


@query("med_mad", PANEL, *CELLS, *MED, "SELECT sa.k, sa.s, ROUND(MAX(med), 8) AS med, ROUND(MEDIAN(ABS(CAST(v AS DOUBLE) - med)) + 1e-8, 8) AS mad FROM sa JOIN sm ON sm.k = sa.k AND sm.s = sa.s GROUP BY sa.k, sa.s")
def _(spark, d):
    return rounded(features.robust_stats(features.sequences(tables.prices(spark, d))), "med", "mad")


FITTED = [
    "fd AS (SELECT dt FROM (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT dt FROM sa) q) w WHERE i < FLOOR(n * CAST(0.8 AS DOUBLE)))",
    "fm AS (SELECT k, s, MEDIAN(CAST(v AS DOUBLE)) AS med FROM sa WHERE dt IN (SELECT dt FROM fd) GROUP BY k, s)",
    "fa AS (SELECT sa.k, sa.s, MAX(med) AS med, MEDIAN(ABS(CAST(v AS DOUBLE) - med)) + 1e-8 AS mad FROM sa JOIN fm ON fm.k = sa.k AND fm.s = sa.s WHERE dt IN (SELECT dt FROM fd) GROUP BY sa.k, sa.s)",
]


@query("robust_norm", PANEL, *CELLS, *FITTED, "SELECT stock, dt, sa.k, sa.s, ROUND((CAST(v AS DOUBLE) - med) / mad, 3) AS v FROM sa JOIN fa ON fa.k = sa.k AND fa.s = sa.s")
def _(spark, d):
    x = written(features.sequences(tables.prices(spark, d)), "sequences")
    train = x.join(F.broadcast(features.date_split(x).where("is_train").select("dt")), "dt", "left_semi")
    scaled = features.robust_scaled(x, features.robust_stats(train))
    return scaled.select("stock", "dt", F.posexplode("x").alias("k", "row")).select("stock", "dt", "k", F.posexplode("row").alias("s", "v")).withColumn("v", F.round(F.col("v"), 3))


# ---- combination ------------------------------------------------------------------------------------------------

FILL = ", ".join(f"COALESCE(ROUND({f}, 8), AVG(ROUND({f}, 8)) OVER (PARTITION BY dt), 0) AS {f}" for f in sql.FACTORS)


@query("training_panel", PANEL, STUDY, sql.FORWARD, f"tp AS (SELECT stock, dt, {FILL} FROM ft)", "SELECT tp.stock, tp.dt, " + ", ".join(f"ROUND({f}, 8) AS {f}" for f in sql.FACTORS) + ", ROUND(fwd, 8) AS fwd FROM tp JOIN fwd ON fwd.stock = tp.stock AND fwd.dt = tp.dt")
def _(spark, d):
    return rounded(combine.training_panel(study_wide(spark, d), list(sql.FACTORS)), *sql.FACTORS, "fwd")


@query("factor_direction", PANEL, STUDY, sql.FORWARD, sql.IC, "SELECT factor, CASE WHEN ic_mean >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM irs")
def _(spark, d):
    return combine.factor_direction(evaluate.ic(*study(spark, d)))


@query("factor_class", PANEL, STUDY, "SELECT DISTINCT factor, CASE WHEN regexp_matches(lower(factor), 'gru|transformer|lightgbm|svm|rf') THEN 'model' ELSE 'price' END AS class FROM tidy")
def _(spark, d):
    return combine.factor_class(study(spark, d)[0].select("factor").distinct())


TRAIN = [
    "td AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 < FLOOR(COUNT(*) OVER () * CAST(0.8 AS DOUBLE)) AS early FROM (SELECT DISTINCT dt FROM tidy) q)",
    "ti AS (SELECT factor, AVG(ic) AS ic_mean, CASE WHEN STDDEV_SAMP(ic) > 1e-8 THEN AVG(ic) / (STDDEV_SAMP(ic) + 1e-8) ELSE 0 END AS ir FROM ics WHERE dt IN (SELECT dt FROM td WHERE early) GROUP BY factor)",
]


@query("train_ic", PANEL, STUDY, sql.FORWARD, sql.IC, *TRAIN, sql.rounded("ic_mean, ir", "ti", "factor"))
def _(spark, d):
    return rounded(combine.train_ic(*study(spark, d)), "ic_mean", "ir")


@query("factor_score", PANEL, *SUMMARY, "SELECT irs.factor, ROUND(0.3 * ABS(ic_mean) + 0.3 * ABS(ir) + 0.2 * CASE WHEN is_monotone THEN 1 ELSE 0 END + GREATEST(0, LEAST(COALESCE(annual, 0), 0.1)) + GREATEST(0, LEAST(COALESCE(sharpe / 2, 0), 0.1)), 8) AS score FROM irs JOIN ls ON ls.factor = irs.factor JOIN mono ON mono.factor = irs.factor")
def _(spark, d):
    return rounded(combine.factor_score(_summary(spark, d)).select("factor", "score"), "score")


SCORE = "0.3 * ABS(ic_mean) + 0.3 * ABS(ir) + 0.2 * CASE WHEN is_monotone THEN 1 ELSE 0 END + GREATEST(0, LEAST(COALESCE(annual, 0), 0.1)) + GREATEST(0, LEAST(COALESCE(sharpe / 2, 0), 0.1))"


def chosen(category: str, least_ic: float, least: int, most: int) -> list[str]:
    """Greedy choice by score within each category, as a walk down its ranking; ``picks(category, score list, names)``."""
    return [
        *SUMMARY,
        CORR,
        "near AS (SELECT f, LIST(g) AS near FROM (SELECT a AS f, b AS g FROM fcr WHERE ABS(corr) > 0.7 UNION ALL SELECT b, a FROM fcr WHERE ABS(corr) > 0.7) q GROUP BY f)",
        f"scores AS (SELECT irs.factor, {category} AS category, ic_mean, {SCORE} AS score FROM irs JOIN ls ON ls.factor = irs.factor JOIN mono ON mono.factor = irs.factor)",
        "ranking AS (SELECT scores.*, COALESCE(near, CAST([] AS VARCHAR[])) AS near, ROW_NUMBER() OVER (PARTITION BY category ORDER BY score DESC, factor) AS k FROM scores LEFT JOIN near ON near.f = scores.factor)",
        f"walk AS (SELECT DISTINCT category, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS kept FROM ranking UNION ALL SELECT w.category, r.k, CASE WHEN ABS(r.ic_mean) >= {least_ic} AND NOT list_has_any(w.kept, r.near) THEN list_append(w.kept, r.factor) ELSE w.kept END FROM walk w JOIN ranking r ON r.category = w.category AND r.k = w.k + 1)",
        f"few AS (SELECT category, LIST(factor ORDER BY k)[1:{least}] AS best FROM ranking GROUP BY category)",
        f"picks AS (SELECT few.category, CASE WHEN LEN(kept) < {least} THEN best ELSE kept END[1:{most}] AS names FROM (SELECT category, ARG_MAX(kept, k) AS kept FROM walk GROUP BY category) q JOIN few ON few.category = q.category)",
    ]


@query("select_factors", PANEL, *chosen("'all'", 0.02, 2, 4), "SELECT CAST(UNNEST(RANGE(LEN(names))) AS INTEGER) AS rank, UNNEST(names) AS factor FROM picks")
def _(spark, d):
    wide = study_wide(spark, d)
    names = combine.select_factors(combine.factor_score(_summary(spark, d)), evaluate.factor_corr(wide, list(sql.FACTORS)), 2, 4)
    return spark.createDataFrame(list(enumerate(names)), "rank int, factor string")


#: Direction of each factor in the composite queries.
TURNED = {"bias": -1, "id_vol": -1, "turn20": 1}
KNOWN = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in TURNED)
MODEL1 = [
    f"m0 AS (SELECT stock, dt, {', '.join(f'{s} * ROUND({f}, 8) AS {f}' for f, s in TURNED.items())} FROM ft WHERE {KNOWN} >= 1)",
    f"m1 AS (SELECT stock, dt, {', '.join(f'COALESCE({f}, AVG({f}) OVER (PARTITION BY dt)) AS {f}' for f in TURNED)} FROM m0)",
    f"m2 AS (SELECT stock, dt, ({' + '.join(f'COALESCE(({f} - AVG({f}) OVER (PARTITION BY dt)) / (STDDEV_POP({f}) OVER (PARTITION BY dt) + 1e-8), 0)' for f in TURNED)}) / 3 AS value FROM m1)",
]


@query("model1_signal", PANEL, STUDY, *MODEL1, sql.rounded("value", "m2", "stock, dt"))
def _(spark, d):
    return rounded(combine.model1_signal(study_wide(spark, d), TURNED), "value")


@query("model2_signal")
def _(spark, d):
    return combine.network_signal(study_wide(spark, d), list(sql.FACTORS))


@query("model3_signal")
def _(spark, d):
    return combine.boosted_signal(study_wide(spark, d), list(sql.FACTORS))


@query("linear_signal")
def _(spark, d):
    return combine.linear_signal(study_wide(spark, d), list(sql.FACTORS))


EARLY_STATS = "sc0 AS (SELECT " + ", ".join(f"AVG(ROUND({f}, 8)) AS m_{f}, STDDEV_POP(ROUND({f}, 8)) AS s_{f}" for f in sql.FACTORS) + " FROM ft WHERE dt < DATE '1998-01-01')"


@query("standard_scale", PANEL, STUDY, EARLY_STATS, "SELECT stock, dt, " + ", ".join(f"ROUND((ROUND({f}, 8) - m_{f}) / CASE WHEN s_{f} > 0 THEN s_{f} ELSE 1 END, 6) AS {f}" for f in sql.FACTORS) + " FROM ft, sc0")
def _(spark, d):
    rows = study_wide(spark, d).select("stock", "dt", *sql.FACTORS)
    return rounded(combine.standard_scale(rows.where("dt < date'1998-01-01'"), rows, list(sql.FACTORS)), *sql.FACTORS, digits=6)


@query("ensemble_mean", PANEL, STUDY, *MODEL1, "SELECT m2.stock, m2.dt, ROUND((value + ROUND(turn20, 8) + ROUND(apb, 8)) / 3, 8) AS value FROM m2 JOIN ft ON ft.stock = m2.stock AND ft.dt = m2.dt")
def _(spark, d):
    wide = study_wide(spark, d)
    others = [wide.select("stock", "dt", F.col(f).alias("value")) for f in ("turn20", "apb")]
    return rounded(combine.ensemble(combine.model1_signal(wide, TURNED), *others), "value")


@query("final_signal")
def _(spark, d):
    """From the analysis of the factors to the mean of the three models, read from their saved tables."""
    stages = Stages(spark, new_folder(spark, "signal"), [f"{d}/{t}.parquet" for t in ("lineitem", "orders")])
    return strategy.predictions(study_wide(spark, d), list(sql.FACTORS), stages)["final"]


def _model_factor(spark, d, *models: str, horizons: tuple[str, ...] = sequence_factors.HORIZONS) -> DataFrame:
    """The month panel has one return a month, so months are days here and years are months."""
    return sequence_factors.model_factors(written(tables.prices(spark, d), "panel"), models, horizons, grain="year")


@query("ml_factor")
def _(spark, d):
    return _model_factor(spark, d, "svm", "rf")


@query("lightgbm_factor")
def _(spark, d):
    return _model_factor(spark, d, "lightgbm", horizons=("daily",))


@query("gru_factor")
def _(spark, d):
    return _model_factor(spark, d, "gru")


@query("transformer_factor")
def _(spark, d):
    return _model_factor(spark, d, "transformer", horizons=("daily",))


GRAM = ("bias", "turn20", "fwd")
SCALED = f"sr AS (SELECT tp.stock, tp.dt, {', '.join(f'tp.{f}' for f in sql.FACTORS)}, COALESCE((fwd - AVG(fwd) OVER (PARTITION BY tp.dt)) / (STDDEV_SAMP(fwd) OVER (PARTITION BY tp.dt) + 1e-8), 0) AS fwd FROM tp JOIN fwd ON fwd.stock = tp.stock AND fwd.dt = tp.dt)"


@query("walk_forward_sums", PANEL, STUDY, sql.FORWARD, f"tp AS (SELECT stock, dt, {FILL} FROM ft)", SCALED, "SELECT dt, COUNT(*) AS n, " + ", ".join(f"ROUND(SUM({a} * {b}), 6) AS s_{a}_{b}" for k, a in enumerate(GRAM) for b in GRAM[k:]) + " FROM sr GROUP BY dt")
def _(spark, d):
    grams, names = combine.walk_forward_sums(study_wide(spark, d), list(sql.FACTORS)), ["one", *sql.FACTORS, "fwd"]
    at = lambda a, b: F.get("gram", F.lit(names.index(a) * len(names) + names.index(b)))
    return grams.select("dt", at("one", "one").cast("long").alias("n"), *[F.round(at(a, b), 6).alias(f"s_{a}_{b}") for k, a in enumerate(GRAM) for b in GRAM[k:]])


@query("walk_forward_signal")
def _(spark, d):
    return combine.walk_forward_signal(study_wide(spark, d), list(sql.FACTORS))


KINDS = {"bias": "price", "apb": "price", "new_high_ratio": "price", "id_vol": "risk", "turn20": "turnover", "turnover_bias": "turnover"}
KIND = "CASE irs.factor " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, k in KINDS.items()) + " ELSE 'other' END"


@query("select_by_category", PANEL, *chosen(KIND, 0.0, 1, 2), "SELECT p.category, CAST(p.rank AS INTEGER) AS rank, p.factor, ROUND(score, 8) AS score FROM (SELECT category, UNNEST(RANGE(1, LEN(names) + 1)) AS rank, UNNEST(names) AS factor FROM picks) p JOIN scores ON scores.factor = p.factor")
def _(spark, d):
    corr = evaluate.factor_corr(study_wide(spark, d), list(sql.FACTORS))
    return rounded(combine.select_by_category(combine.factor_score(_summary(spark, d)), corr, KINDS, least_ic=0.0), "score")


TREE_ROWS = [
    "ty AS (SELECT tp.*, fwd FROM tp JOIN fwd ON fwd.stock = tp.stock AND fwd.dt = tp.dt)",
    "tu AS (" + " UNION ALL ".join(f"SELECT {k} AS f, {f} AS x, (SELECT AVG(fwd) FROM ty) - fwd AS g FROM ty" for k, f in enumerate(sql.FACTORS)) + ")",
    "tc AS (SELECT DISTINCT f, x AS c FROM (SELECT f, x, ROW_NUMBER() OVER (PARTITION BY f ORDER BY x) - 1 AS p, COUNT(*) OVER (PARTITION BY f) AS n FROM tu) q WHERE p IN (SELECT UNNEST([LEAST(j * n // 256, n - 1) FOR j IN RANGE(1, 256)])))",
    "ts AS (SELECT f, c, SUM(g) FILTER (WHERE x < c) AS gl, COUNT(*) FILTER (WHERE x < c) AS hl, SUM(g) AS gt, COUNT(*) AS ht FROM tc JOIN tu USING (f) GROUP BY f, c)",
]
#: Gradients shrunk by 0.1, counts raised by 1, at least 3 rows on each side.
SHRUNK = "POWER(GREATEST(ABS({g}) - 0.1, 0), 2) / ({h} + 1)"
GAIN = f"{SHRUNK.format(g='gl', h='hl')} + {SHRUNK.format(g='(gt - gl)', h='(ht - hl)')} - {SHRUNK.format(g='gt', h='ht')}"
NAMES = "[" + ", ".join(f"'{f}'" for f in sql.FACTORS) + "]"


@query("first_split", PANEL, STUDY, sql.FORWARD, f"tp AS (SELECT stock, dt, {FILL} FROM ft)", *TREE_ROWS, f"SELECT {NAMES}[f + 1] AS feature, ROUND(c, 8) AS threshold, ROUND({GAIN}, 8) AS gain, hl AS n_left FROM ts WHERE hl >= 3 AND ht - hl >= 3 AND {GAIN} >= 0 ORDER BY ROUND({GAIN}, 12) DESC, f, c LIMIT 1")
def _(spark, d):
    """The first split of the boosted trees, with the bins that they use, on all rows of the training panel."""
    rows = combine.training_panel(study_wide(spark, d), list(sql.FACTORS))
    ready = rows.select(F.lit(False).alias("is_valid"), F.xxhash64("stock", "dt").alias("tie"), F.array(*sql.FACTORS).alias("x"), F.col("fwd").alias("y"))
    return rounded(trees.first_split(ready, list(sql.FACTORS), trees.Growth(gamma=0.0)), "threshold", "gain")


@query("asof_join", PANEL, "SELECT l.stock, l.dt, r.dt AS since, ROUND(r.ret, 8) AS jump FROM rt l ASOF LEFT JOIN (SELECT stock, dt, ret FROM rt WHERE ret > 0.1) r ON l.stock = r.stock AND l.dt >= r.dt")
def _(spark, d):
    """Of each stock and date the last large rise up to it."""
    panel = written(tables.prices(spark, d).select("stock", "dt", "ret"), "panel")
    jumps = panel.where("ret > 0.1").select("stock", "dt", F.col("dt").alias("since"), F.col("ret").alias("jump"))
    return rounded(asof.asof_join(panel.select("stock", "dt"), jumps, ["stock"], "dt", block=F.year("dt")), "jump")


# ---- backtest ---------------------------------------------------------------------------------------------------

BACK = [PANEL, STUDY, sql.SIGNAL]
SWEEP = [*BACK, sql.strategy(sql.TOP)]


def _sweep(spark, d) -> DataFrame:
    return written(backtest.long_only(*signals(spark, d), backtest.PCTS, freq=5), "nav")


DAILY = ["sgf AS (SELECT * FROM tidy WHERE factor IN ('bias', 'turn20', 'apb'))", sql.layers("sgf", 1, 1, 0.002)]
BETWEEN = ["fcr2 AS (SELECT a, b, corr FROM fcr UNION ALL SELECT b, a, corr FROM fcr)"]


@query(
    "signal_analysis", PANEL, STUDY, sql.FORWARD, sql.IC, *RANKS, RANK_IC, RANK_IR, *DAILY, sql.MONOTONE, sql.SPREAD, CORR, *BETWEEN,
    "SELECT irs.factor AS signal, ROUND(irs.ic_mean, 8) AS ic_mean, ROUND(irs.ic_std, 8) AS ic_std, ROUND(irs.ir, 8) AS ir, ROUND(irs.positive, 8) AS ic_win_rate, ROUND(rank_ic_mean, 8) AS rank_ic_mean, ROUND(rirs.ir, 8) AS rank_ir, is_monotone, COALESCE(direction, 'positive') AS direction, ROUND(total, 8) AS total, ROUND(annual, 8) AS annual, ROUND(sharpe, 8) AS sharpe, "
    + ", ".join(f"(SELECT ROUND(MAX(corr), 8) FROM fcr2 WHERE a = irs.factor AND b = '{f}') AS corr_{f}" for f in sql.SIGNALS)
    + " FROM irs JOIN rirs ON rirs.factor = irs.factor JOIN ls ON ls.factor = irs.factor JOIN mono ON mono.factor = irs.factor",
)
def _(spark, d):
    corr = evaluate.factor_corr(study_wide(spark, d), list(sql.SIGNALS))
    got = evaluate.signal_analysis(*signals(spark, d), corr)
    plain = ("ic_mean", "ic_std", "ir", "ic_win_rate", "rank_ic_mean", "rank_ir", "total", "annual", "sharpe")
    near = [F.try_element_at("corr", F.lit(f)).alias(f"corr_{f}") for f in sql.SIGNALS]
    return rounded(got.select("signal", *plain, "is_monotone", "direction", *near), *plain, *[f"corr_{f}" for f in sql.SIGNALS])


@query("top_pct_select", *BACK, sql.rounded("weight", f"({sql.TOP}) q2", "signal, pct, dt, stock"))
def _(spark, d):
    return rounded(backtest.top_pct(signals(spark, d)[0], backtest.PCTS), "weight")


@query("backtest_sweep", *SWEEP, sql.rounded("turnover, nav", "snav", "signal, pct, dt"))
def _(spark, d):
    return rounded(_sweep(spark, d), "turnover", "nav")


@query("long_only_nav", *SWEEP, sql.rounded("nav", "snav", "signal, dt", "pct = CAST(0.1 AS DOUBLE)"))
def _(spark, d):
    return rounded(backtest.long_only(*signals(spark, d), (0.1,), freq=5).select("signal", "dt", "nav"), "nav")


@query("turnover", *SWEEP, sql.rounded("turnover", "stn", "signal, pct, CAST(i AS INTEGER) AS i"))
def _(spark, d):
    sig, _returns = signals(spark, d)
    at = backtest.top_pct(sig, backtest.PCTS).join(F.broadcast(evaluate.calendar(sig)), "dt").where("i % 5 = 0").select("signal", "pct", "i", "stock", "weight")
    return rounded(evaluate.turnover_of(at, "signal", "pct").where("i > 0"), "turnover")


@query("layer5_nav", *BACK, sql.strategy(sql.FIFTH, "signal"), sql.rounded("turnover, nav", "snav", "signal, dt"))
def _(spark, d):
    return rounded(backtest.layer5(*signals(spark, d), freq=5), "turnover", "nav")


@query("perf_metrics", *SWEEP, sql.measures(), sql.rounded("total, annual, volatility, sharpe, max_drawdown, calmar, turnover, win_rate", "met", "signal, pct, CAST(duration AS INTEGER) AS duration"))
def _(spark, d):
    return rounded(backtest.metrics(_sweep(spark, d), "signal", "pct"), "total", "annual", "volatility", "sharpe", "max_drawdown", "calmar", "turnover", "win_rate")


@query("max_drawdown", *SWEEP, sql.measures(), "SELECT signal, pct, CAST(duration AS INTEGER) AS duration, ROUND(max_drawdown / 100, 8) AS max_drawdown FROM met")
def _(spark, d):
    return rounded(backtest.drawdown(_sweep(spark, d), "signal", "pct"), "max_drawdown")


BENCH = [sql.INDEX, "bn AS (SELECT dt, PRODUCT(CASE WHEN o = 1 THEN 1.0 ELSE 1 + COALESCE(market_return, 0) END) OVER (ORDER BY dt) AS base FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY dt) AS o FROM ix) q)"]
EXCESS = [
    "ex0 AS (SELECT signal, pct, s.dt, nav / LAG(nav) OVER (PARTITION BY signal, pct ORDER BY s.dt) - base / LAG(base) OVER (PARTITION BY signal, pct ORDER BY s.dt) AS x FROM snav s JOIN bn ON bn.dt = s.dt)",
    "ex AS (SELECT *, 0 AS turnover, PRODUCT(1 + x) OVER (PARTITION BY signal, pct ORDER BY dt) AS nav FROM ex0 WHERE x IS NOT NULL)",
    "xw AS (SELECT signal, pct, 100 * AVG(CASE WHEN g > 1 THEN 1.0 ELSE 0.0 END) AS monthly_win_rate FROM (SELECT signal, pct, date_trunc('month', dt) AS m, PRODUCT(1 + x) AS g FROM ex GROUP BY 1, 2, 3) q GROUP BY signal, pct)",
    "xg AS (SELECT signal, pct, 100 * (POWER(ARG_MAX(nav, dt) / ARG_MIN(nav, dt), CAST(252 AS DOUBLE) / COUNT(*)) - 1) AS excess_annual, 100 * STDDEV_SAMP(x) * SQRT(252) AS tracking_error FROM ex GROUP BY signal, pct)",
]


@query("benchmark_nav", PANEL, *BENCH, "SELECT dt, ROUND(base, 8) AS nav FROM bn")
def _(spark, d):
    return rounded(backtest.benchmark_nav(tables.market_index(tables.trade_bars(spark, d))), "nav")


@query("equal_weight_nav", PANEL, MEMBERS, f"ew AS (SELECT dt, AVG(ret) AS r FROM rt WHERE EXISTS (SELECT 1 FROM stints m WHERE m.stock = rt.stock AND {INSIDE('rt.dt')}) GROUP BY dt)", "SELECT dt, ROUND(PRODUCT(1 + COALESCE(r, 0)) OVER (ORDER BY dt), 8) AS nav FROM ew")
def _(spark, d):
    return rounded(backtest.equal_weight_nav(tables.prices(spark, d).select("stock", "dt", "ret"), tables.membership(spark, d)), "nav")


@query(
    "excess_metrics", *SWEEP, *BENCH, *EXCESS, sql.measures("ex", name="xm"),
    "SELECT xg.signal, xg.pct, ROUND(excess_annual, 6) AS excess_annual, ROUND(tracking_error, 6) AS tracking_error, ROUND(excess_annual / NULLIF(tracking_error, 0), 6) AS information_ratio, ROUND(max_drawdown, 6) AS excess_drawdown, ROUND(monthly_win_rate, 6) AS monthly_win_rate FROM xg JOIN xm ON xm.signal = xg.signal AND xm.pct = xg.pct JOIN xw ON xw.signal = xg.signal AND xw.pct = xg.pct",
)
def _(spark, d):
    got = backtest.excess_metrics(_sweep(spark, d), backtest.benchmark_nav(tables.market_index(tables.trade_bars(spark, d))), "signal", "pct")
    return rounded(got, "excess_annual", "tracking_error", "information_ratio", "excess_drawdown", "monthly_win_rate", digits=6)


@query("monthly_win_rate", *SWEEP, *BENCH, *EXCESS, sql.rounded("monthly_win_rate", "xw", "signal, pct"))
def _(spark, d):
    base = backtest.benchmark_nav(tables.market_index(tables.trade_bars(spark, d)))
    got = backtest.excess_metrics(_sweep(spark, d), base, "signal", "pct")
    return rounded(got.select("signal", "pct", "monthly_win_rate"), "monthly_win_rate")


@query("period_returns", *SWEEP, "yr AS (SELECT signal, pct, CAST(date_trunc('year', dt) AS DATE) AS period, ARG_MAX(nav, dt) AS v FROM snav GROUP BY 1, 2, 3)", "SELECT * FROM (SELECT signal, pct, period, ROUND(v / LAG(v) OVER (PARTITION BY signal, pct ORDER BY period) - 1, 8) AS r FROM yr) q WHERE r IS NOT NULL")
def _(spark, d):
    return rounded(backtest.period_returns(_sweep(spark, d), "signal", "pct", grain="year"), "r")


@query("optimal_pct", *SWEEP, sql.measures(), "SELECT signal, pct FROM (SELECT signal, pct, ROW_NUMBER() OVER (PARTITION BY signal ORDER BY ROUND(sharpe, 8) DESC, pct) AS o FROM met WHERE sharpe IS NOT NULL) q WHERE o = 1")
def _(spark, d):
    return backtest.optimal_pct(backtest.metrics(_sweep(spark, d), "signal", "pct"))


LATER = [
    sql.strategy(sql.TOP, freq=1),
    "cutoff AS (SELECT FLOOR(COUNT(*) * CAST(0.8 AS DOUBLE)) AS c FROM sd)",
    "trn AS (SELECT snav.* FROM snav JOIN sd ON sd.dt = snav.dt WHERE sd.i < (SELECT c FROM cutoff))",
    sql.measures("trn"),
    "best AS (SELECT signal, pct FROM (SELECT signal, pct, ROW_NUMBER() OVER (PARTITION BY signal ORDER BY ROUND(sharpe, 8) DESC, pct) AS o FROM met WHERE sharpe IS NOT NULL AND NOT ISNAN(sharpe)) q WHERE o = 1)",
    "sg2 AS (SELECT sg.* FROM sg JOIN sd ON sd.dt = sg.dt WHERE sd.i >= (SELECT c FROM cutoff))",
    sql.renamed(sql.strategy(f"SELECT q3.* FROM ({sql.TOP.replace('FROM sg,', 'FROM sg2,')}) q3 JOIN best ON best.signal = q3.signal AND best.pct = q3.pct", freq=1, source="sg2"), "2", "sd", "sel", "sw", "sn", "sc", "stn", "sh", "snav"),
]


@query("oos_backtest", *BACK, *LATER, sql.rounded("turnover, nav", "snav2", "signal, pct, dt"))
def _(spark, d):
    return rounded(backtest.out_of_sample(*signals(spark, d)), "turnover", "nav")


# ---- older conventions ------------------------------------------------------------------------------------------

NONZERO = "lg AS (SELECT factor, stock, dt, CASE WHEN value <> 0 THEN value END AS value FROM tidy)"


@query("legacy_layers", PANEL, STUDY, NONZERO, sql.layers("lg", 5, 1), "SELECT factor, CAST(i AS INTEGER) AS i, layer, stock, ROUND(weight, 8) AS weight FROM lw")
def _(spark, d):
    return rounded(legacy.gen_layers(study(spark, d)[0], freq=5), "weight")


@query("legacy_base", PANEL, STUDY, "SELECT factor, dt, stock, ROUND(CAST(1 AS DOUBLE) / COUNT(*) OVER (PARTITION BY factor, dt), 8) AS weight FROM tidy WHERE value IS NOT NULL")
def _(spark, d):
    return rounded(legacy.gen_base(study(spark, d)[0]), "weight")


def _drift(spark, d) -> DataFrame:
    w = legacy.gen_layers(study(spark, d)[0], freq=5)
    state = written(legacy.trading_state(tables.prices(spark, d)), "state")
    return legacy.drift_nav(w, state, "factor", "layer")


@query("drift_nav", PANEL, STUDY, NONZERO, sql.layers("lg", 5, 1), *sql.DRIFT, "SELECT factor, layer, dt, ROUND(turnover, 8) AS turnover, ROUND(nav, 8) AS nav FROM dnav")
def _(spark, d):
    return rounded(_drift(spark, d), "turnover", "nav")


@query("legacy_metrics", *SWEEP, sql.measures(name="lm", less=1, spread="STDDEV_POP"), sql.rounded("total, annual, volatility, sharpe", "lm", "signal, pct"))
def _(spark, d):
    got = backtest.metrics(_sweep(spark, d), "signal", "pct", less=1, population=True)
    return rounded(got.select("signal", "pct", "total", "annual", "volatility", "sharpe"), "total", "annual", "volatility", "sharpe")


@query(
    "month_table", PANEL, STUDY, NONZERO, sql.layers("lg", 5, 1), *sql.DRIFT,
    "mt AS (SELECT factor, layer, date_trunc('month', dt) AS period, ARG_MAX(nav, dt) AS v FROM dnav GROUP BY 1, 2, 3)",
    "SELECT factor, layer, CAST(EXTRACT(year FROM period) AS INTEGER) AS year, CAST(EXTRACT(month FROM period) AS INTEGER) AS month, ROUND(r, 8) AS r FROM (SELECT *, v / LAG(v) OVER (PARTITION BY factor, layer ORDER BY period) - 1 AS r FROM mt) q WHERE r IS NOT NULL",
)
def _(spark, d):
    return rounded(legacy.month_table(_drift(spark, d), "factor", "layer"), "r")


# ---- the flagship: month bars -> BIAS(20) -> next period's IC ----------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = tables.prices(spark, sf_dir)
    tidy = rounded(factors.tidy(factors.bias(panel), "bias"), "value")
    return rounded(evaluate.ic(tidy, panel.select("stock", "dt", "ret")), "ic")


@query("xs_score", PANEL, "SELECT stock, dt, ROUND((ret - AVG(ret) OVER (PARTITION BY dt)) / (STDDEV_SAMP(ret) OVER (PARTITION BY dt) + 1e-8), 6) AS z FROM rt WHERE ret IS NOT NULL")
def _(spark, d):
    from crosspanel.functions.stats import zscore

    return tables.prices(spark, d).where("ret is not null").select("stock", "dt", F.round(zscore("ret", cross_section()), 6).alias("z"))
