"""ANSI SQL twins of the queries: common table expressions that are put together for each of them."""

from __future__ import annotations

import re

FACTORS = ("bias", "apb", "id_vol", "turn20", "turnover_bias", "new_high_ratio")
SIGNALS = ("bias", "turn20", "apb")


def over(n: int) -> str:
    return f"(PARTITION BY stock ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, at_least: int | None = None) -> str:
    return f"CASE WHEN COUNT({x}) OVER {over(n)} >= {n if at_least is None else at_least} THEN {agg}({x}) OVER {over(n)} END"


def deviation(x: str, n: int) -> str:
    return f"({x} - {roll('AVG', x, n)}) / ({roll('AVG', x, n)} + 1e-8)"


def corr(x: str, y: str) -> str:
    return f"COVAR_POP({x}, {y}) / NULLIF(STDDEV_POP({x}) * STDDEV_POP({y}), 0)"


def panel(grain: str = "month") -> str:
    by = f"l_suppkey, date_trunc('{grain}', l_shipdate)"
    return f"""li AS (
  SELECT l_suppkey AS stock, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS dt, l_extendedprice/l_quantity AS px, l_quantity AS qty, l_extendedprice AS amt,
    ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn,
    ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rd
  FROM lineitem),
bar AS (
  SELECT stock, dt, MAX(CASE WHEN rn=1 THEN px END) AS open_price, MAX(px) AS high_price, MIN(px) AS low_price, MAX(CASE WHEN rd=1 THEN px END) AS close_price, SUM(qty) AS volume, ROUND(SUM(amt), 2) AS amount
  FROM li GROUP BY stock, dt),
mv AS (SELECT s_suppkey AS stock, (ABS(s_acctbal) + 1000) * 1000 AS total_mv FROM supplier),
px AS (
  SELECT bar.*, 100 + LN(close_price) AS close_adj, amount / (volume + 1e-10) AS vwap, total_mv, CASE WHEN total_mv IS NULL THEN 0 ELSE amount / (total_mv + 1e8) END AS turnover
  FROM bar LEFT JOIN mv ON mv.stock = bar.stock),
rt AS (
  SELECT *, close_adj / LAG(close_adj) OVER (PARTITION BY stock ORDER BY dt) - 1 AS ret, LN(close_adj / LAG(close_adj) OVER (PARTITION BY stock ORDER BY dt)) AS log_ret FROM px)"""


MEMBERS = """st0 AS (SELECT stock, MIN(dt) AS in_date FROM bar GROUP BY stock),
stints AS (
  SELECT stock, in_date, CASE WHEN stock % 5 = 0 THEN DATE '1999-12-01' END AS out_date FROM st0
  UNION ALL SELECT stock, DATE '2000-12-01', CAST(NULL AS DATE) FROM st0 WHERE stock % 10 = 0)"""
INDEX = """ix0 AS (SELECT dt, SUM(amount) / SUM(volume) AS index_close FROM bar GROUP BY dt),
ix AS (SELECT dt, index_close, index_close / LAG(index_close) OVER (ORDER BY dt) - 1 AS market_return FROM ix0)"""
STUDY = f"""hi AS (SELECT *, CASE WHEN COUNT(high_price) OVER {over(20)} >= 20 AND high_price >= MAX(high_price) OVER {over(20)} THEN 1 ELSE 0 END AS is_new FROM rt),
ft AS (
  SELECT stock, dt, ret, {deviation("close_price", 20)} AS bias,
    LN({roll("AVG", "close_price", 20)} / ({roll("SUM", "(close_price*volume)", 20)} / {roll("SUM", "volume", 20)} + 1e-8)) AS apb,
    {roll("STDDEV_SAMP", "ret", 20)} * SQRT(252) AS id_vol, {roll("AVG", "turnover", 20)} AS turn20, {deviation("turnover", 20)} AS turnover_bias, ({roll("SUM", "is_new", 20)}) / CAST(20 AS DOUBLE) AS new_high_ratio
  FROM hi),
tidy AS ({" UNION ALL ".join(f"SELECT '{f}' AS factor, stock, dt, ROUND({f}, 8) AS value FROM ft" for f in FACTORS)})"""
FORWARD = """cal AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM rt WHERE ret IS NOT NULL) q),
fwd AS (SELECT r.stock, a.dt, r.ret AS fwd FROM rt r JOIN cal b ON b.dt = r.dt JOIN cal a ON a.i = b.i - 1 WHERE r.ret IS NOT NULL)"""
IC = f"""ics AS (
  SELECT factor, t.dt, COUNT(*) AS n, {corr("value", "fwd")} AS ic FROM tidy t JOIN fwd ON fwd.stock = t.stock AND fwd.dt = t.dt WHERE value IS NOT NULL
  GROUP BY factor, t.dt HAVING COUNT(*) >= 10 AND STDDEV_SAMP(value) > 1e-8 AND {corr("value", "fwd")} IS NOT NULL),
irs AS (
  SELECT factor, AVG(ic) AS ic_mean, STDDEV_SAMP(ic) AS ic_std, AVG(ic) / (STDDEV_SAMP(ic) + 1e-8) AS ir, AVG(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, SKEWNESS(ic) AS skew, COUNT(ic) AS n FROM ics GROUP BY factor)"""


def layers(source: str = "tidy", freq: int = 5, lag: int = 5, fee: float = 0.001) -> str:
    """From ``source(factor, stock, dt, value)``: ``lw`` weights, ``tn`` turnover, ``nav``."""
    return f"""days AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM {source}) q),
lay AS (SELECT UNNEST([0, 1, 2, 3, 4]) AS layer),
u AS (SELECT factor, d.i + {lag} AS i, stock, value FROM {source} t JOIN days d ON d.dt = t.dt WHERE value IS NOT NULL AND d.i % {freq} = {(freq - lag) % freq} AND d.i + {lag} >= {freq} AND d.i + {lag} <= (SELECT MAX(i) FROM days)),
rk AS (SELECT *, COUNT(*) OVER (PARTITION BY factor, i) AS n, RANK() OVER (PARTITION BY factor, i ORDER BY value) - 1 AS a, COUNT(*) OVER (PARTITION BY factor, i, value) AS c FROM u),
lw AS (
  SELECT factor, i, layer, stock, CAST(1 AS DOUBLE) / COUNT(*) OVER (PARTITION BY factor, i, layer) AS weight
  FROM rk, lay WHERE n >= 5 AND (a + c - 1) * 5 >= (n - 1) * layer AND a * 5 <= (n - 1) * (layer + 1)),
nx AS (SELECT *, LEAD(i) OVER (PARTITION BY factor, layer ORDER BY i) AS nxt FROM (SELECT DISTINCT factor, layer, i FROM lw) q),
ch AS (
  SELECT factor, layer, i, stock, weight FROM lw
  UNION ALL SELECT w.factor, w.layer, n.nxt, w.stock, -w.weight FROM lw w JOIN nx n ON n.factor = w.factor AND n.layer = w.layer AND n.i = w.i WHERE n.nxt IS NOT NULL),
tn AS (SELECT factor, layer, i, SUM(ABS(d)) AS turnover FROM (SELECT factor, layer, i, stock, SUM(weight) AS d FROM ch GROUP BY factor, layer, i, stock) q GROUP BY factor, layer, i),
hr AS (
  SELECT w.factor, w.layer, d.i, SUM(w.weight * COALESCE(r.ret, 0)) AS r
  FROM lw w JOIN nx n ON n.factor = w.factor AND n.layer = w.layer AND n.i = w.i JOIN days d ON d.i >= n.i AND d.i < COALESCE(n.nxt, 1000000) LEFT JOIN rt r ON r.stock = w.stock AND r.dt = d.dt
  GROUP BY w.factor, w.layer, d.i),
nav AS (
  SELECT f.factor, lay.layer, d.dt, COALESCE(tn.turnover, 0) AS turnover,
    PRODUCT((1 - {fee} * COALESCE(tn.turnover, 0)) * (1 + COALESCE(hr.r, 0))) OVER (PARTITION BY f.factor, lay.layer ORDER BY d.i) AS nav
  FROM (SELECT DISTINCT factor FROM {source}) f CROSS JOIN lay CROSS JOIN days d
  LEFT JOIN tn ON tn.factor = f.factor AND tn.layer = lay.layer AND tn.i = d.i LEFT JOIN hr ON hr.factor = f.factor AND hr.layer = lay.layer AND hr.i = d.i)"""

#: The older backtest, from ``lw``, ``days`` and ``rt``: ``walk`` goes from one rebalancing of a series to the next, ``dnav`` is the value.
DRIFT = [
    "ts AS (SELECT stock, dt, close_adj AS price, COALESCE(volume > 0, FALSE) AND COALESCE(ret, 0) < 0.1 AS can_buy, COALESCE(volume > 0, FALSE) AND COALESCE(ret, 0) > -0.1 AS can_sell FROM rt)",
    """fl AS (
  SELECT e.stock, d.i, LAST_VALUE(ts.price IGNORE NULLS) OVER (PARTITION BY e.stock ORDER BY d.i) AS price, COALESCE(can_buy, FALSE) AS can_buy, COALESCE(can_sell, FALSE) AS can_sell, d.dt > e.last AS gone
  FROM (SELECT stock, MAX(dt) AS last FROM rt GROUP BY stock) e CROSS JOIN days d LEFT JOIN ts ON ts.stock = e.stock AND ts.dt = d.dt),
mk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor, layer ORDER BY i) AS k, LEAD(i) OVER (PARTITION BY factor, layer ORDER BY i) AS nxt FROM (SELECT DISTINCT factor, layer, i FROM lw) q),
nm AS (SELECT DISTINCT factor, layer, stock FROM lw),
dy AS (
  SELECT m.factor, m.layer, m.k, m.i, nm.stock, COALESCE(lw.weight, 0) AS want, COALESCE(z.price / a.price, 1) AS growth, a.can_buy, a.can_sell, a.gone
  FROM mk m JOIN nm ON nm.factor = m.factor AND nm.layer = m.layer JOIN fl a ON a.stock = nm.stock AND a.i = m.i LEFT JOIN fl z ON z.stock = nm.stock AND z.i = m.nxt
  LEFT JOIN lw ON lw.factor = m.factor AND lw.layer = m.layer AND lw.i = m.i AND lw.stock = nm.stock)""",
    """walk AS (
  SELECT factor, layer, CAST(0 AS BIGINT) AS k, stock, CAST(0 AS DOUBLE) AS weight, CAST(0 AS DOUBLE) AS old, CAST(0 AS DOUBLE) AS turnover FROM nm
  UNION ALL SELECT factor, layer, k, stock, weight, CASE WHEN SUM(weight) OVER s > 0 THEN weight * growth / (SUM(weight * growth) OVER s + 1 - SUM(weight) OVER s) ELSE weight * growth END, SUM(ABS(weight - old)) OVER s
  FROM (
    SELECT *, CASE WHEN kept THEN old WHEN SUM(CASE WHEN NOT kept THEN want END) OVER s > 0 THEN want * GREATEST(SUM(want) OVER s - COALESCE(SUM(CASE WHEN kept THEN old END) OVER s, 0), 0) / SUM(CASE WHEN NOT kept THEN want END) OVER s ELSE 0 END AS weight
    FROM (
      SELECT dy.*, w.old, (want < w.old AND NOT can_sell AND NOT gone) OR (want >= w.old AND NOT can_buy AND (want > 0 OR w.old > 0)) AS kept
      FROM walk w JOIN dy ON dy.factor = w.factor AND dy.layer = w.layer AND dy.stock = w.stock AND dy.k = w.k + 1) q WINDOW s AS (PARTITION BY factor, layer)) q
  WINDOW s AS (PARTITION BY factor, layer))""",
    """re AS (SELECT w.factor, w.layer, m.i AS mark, w.stock, w.weight, w.turnover FROM walk w JOIN mk m ON m.factor = w.factor AND m.layer = w.layer AND m.k = w.k WHERE w.weight > 0),
sp AS (SELECT *, LEAD(mark) OVER (PARTITION BY factor, layer ORDER BY mark) AS nxt FROM (SELECT factor, layer, mark, MAX(turnover) AS turnover FROM re GROUP BY factor, layer, mark) q),
ins AS (
  SELECT re.factor, re.layer, re.mark, p.i, 1 + SUM(re.weight * (p.price / b.price - 1)) AS v
  FROM re JOIN sp ON sp.factor = re.factor AND sp.layer = re.layer AND sp.mark = re.mark JOIN fl b ON b.stock = re.stock AND b.i = re.mark JOIN fl p ON p.stock = re.stock AND p.i >= re.mark AND p.i <= COALESCE(sp.nxt, 1000000)
  GROUP BY re.factor, re.layer, re.mark, p.i),
bs AS (
  SELECT sp.factor, sp.layer, sp.mark, turnover, COALESCE(PRODUCT(v) OVER (PARTITION BY sp.factor, sp.layer ORDER BY sp.mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * PRODUCT(1 - 0.002 * turnover) OVER (PARTITION BY sp.factor, sp.layer ORDER BY sp.mark) AS base
  FROM sp JOIN (SELECT factor, layer, mark, ARG_MAX(v, i) AS v FROM ins GROUP BY factor, layer, mark) e ON e.factor = sp.factor AND e.layer = sp.layer AND e.mark = sp.mark),
dnav AS (
  SELECT q.factor, q.layer, d.dt, q.turnover, q.nav FROM (
    SELECT ins.factor, ins.layer, ins.i, ins.v * bs.base AS nav, CASE WHEN ins.i = ins.mark THEN bs.turnover ELSE 0 END AS turnover, ROW_NUMBER() OVER (PARTITION BY ins.factor, ins.layer, ins.i ORDER BY ins.mark DESC) AS o
    FROM ins JOIN bs ON bs.factor = ins.factor AND bs.layer = ins.layer AND bs.mark = ins.mark) q JOIN days d ON d.i = q.i WHERE o = 1)""",
]


MONOTONE = """fin AS (SELECT factor, MAX(CASE WHEN layer = 0 THEN v END) AS a, MAX(CASE WHEN layer = 2 THEN v END) AS b, MAX(CASE WHEN layer = 4 THEN v END) AS c FROM (SELECT factor, layer, ARG_MAX(nav, dt) AS v FROM nav GROUP BY factor, layer) q GROUP BY factor),
mono AS (SELECT factor, (b >= a AND c >= b) OR (b <= a AND c <= b) AS is_monotone, CASE WHEN b >= a AND c >= b THEN 'positive' WHEN b <= a AND c <= b THEN 'negative' END AS direction FROM fin)"""
SPREAD = """legs AS (SELECT factor, dt, (MAX(CASE WHEN layer = 4 THEN nav END) - MAX(CASE WHEN layer = 0 THEN nav END)) / 2 + 1 AS v FROM nav GROUP BY factor, dt),
lr AS (SELECT *, v / LAG(v) OVER (PARTITION BY factor ORDER BY dt) - 1 AS r FROM legs),
ls AS (
  SELECT factor, ARG_MAX(v, dt) / ARG_MIN(v, dt) - 1 AS total, POWER(ARG_MAX(v, dt) / ARG_MIN(v, dt), CAST(252 AS DOUBLE) / COUNT(*)) - 1 AS annual, AVG(r) / NULLIF(STDDEV_SAMP(r), 0) * SQRT(252) AS sharpe FROM lr GROUP BY factor)"""
SIGNAL = f"""sg AS ({" UNION ALL ".join(f"SELECT '{f}' AS signal, stock, dt, ROUND({f}, 8) AS value FROM ft" for f in SIGNALS)})"""


def strategy(members: str, keys: str = "signal, pct", freq: int = 5, cost: float = 0.002, source: str = "sg") -> str:
    """From ``members`` (a query of keys, dt, stock, weight): ``snav``."""
    names = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    pre = lambda a: ", ".join(f"{a}.{k}" for k in names)
    return f"""sd AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM {source}) q),
sel AS ({members}),
sw AS (SELECT {pre("sel")}, sd.i, stock, weight FROM sel JOIN sd ON sd.dt = sel.dt WHERE sd.i % {freq} = 0),
sn AS (SELECT *, LEAD(i) OVER (PARTITION BY {keys} ORDER BY i) AS nxt FROM (SELECT DISTINCT {keys}, i FROM sw) q),
sc AS (SELECT {keys}, i, stock, weight FROM sw UNION ALL SELECT {pre("w")}, n.nxt, w.stock, -w.weight FROM sw w JOIN sn n ON {on("n", "w")} AND n.i = w.i WHERE n.nxt IS NOT NULL),
stn AS (SELECT {keys}, i, SUM(ABS(d)) AS turnover FROM (SELECT {keys}, i, stock, SUM(weight) AS d FROM sc GROUP BY {keys}, i, stock) q WHERE i > 0 GROUP BY {keys}, i),
sh AS (
  SELECT {pre("w")}, d.i, SUM(w.weight * COALESCE(r.ret, 0)) AS r FROM sw w JOIN sn n ON {on("n", "w")} AND n.i = w.i JOIN sd d ON d.i > n.i AND d.i <= COALESCE(n.nxt, 1000000)
  LEFT JOIN rt r ON r.stock = w.stock AND r.dt = d.dt GROUP BY {pre("w")}, d.i),
snav AS (
  SELECT {pre("g")}, d.dt, COALESCE(stn.turnover, 0) AS turnover, PRODUCT((1 + COALESCE(sh.r, 0)) * (1 - {cost} * COALESCE(stn.turnover, 0))) OVER (PARTITION BY {pre("g")} ORDER BY d.i) AS nav
  FROM (SELECT DISTINCT {keys} FROM sel) g CROSS JOIN sd d LEFT JOIN stn ON {on("stn", "g")} AND stn.i = d.i LEFT JOIN sh ON {on("sh", "g")} AND sh.i = d.i)"""


TOP = """SELECT signal, pct, dt, stock, CAST(1 AS DOUBLE) / size AS weight FROM (
  SELECT signal, dt, stock, pct, ROW_NUMBER() OVER (PARTITION BY signal, dt, pct ORDER BY value DESC, stock) AS k, GREATEST(1, CAST(FLOOR(COUNT(*) OVER (PARTITION BY signal, dt, pct) * pct) AS INTEGER)) AS size
  FROM sg, (SELECT UNNEST(CAST([0.05, 0.1, 0.2] AS DOUBLE[])) AS pct) p WHERE value IS NOT NULL) q WHERE k <= size"""
FIFTH = """SELECT signal, dt, stock, CAST(1 AS DOUBLE) / COUNT(*) OVER (PARTITION BY signal, dt) AS weight FROM (
  SELECT signal, dt, stock, COUNT(*) OVER (PARTITION BY signal, dt) AS n, RANK() OVER (PARTITION BY signal, dt ORDER BY value) - 1 AS a, COUNT(*) OVER (PARTITION BY signal, dt, value) AS c FROM sg WHERE value IS NOT NULL) q
  WHERE n >= 5 AND (a + c - 1) * 5 >= (n - 1) * 4"""


def measures(source: str = "snav", keys: str = "signal, pct", name: str = "met", less: int = 0, spread: str = "STDDEV_SAMP") -> str:
    """From ``source(keys, dt, turnover, nav)``: ``name`` with all metrics."""
    names = [k.strip() for k in keys.split(",")]
    pre = lambda a: ", ".join(f"{a}.{k}" for k in names)
    on = " AND ".join(f"w.{k} = g.{k}" for k in names)
    return f"""{name}_l AS (SELECT *, nav / LAG(nav) OVER (PARTITION BY {keys} ORDER BY dt) - 1 AS r, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY dt) AS k, MAX(nav) OVER (PARTITION BY {keys} ORDER BY dt) AS peak FROM {source}),
{name}_f AS (SELECT *, nav / peak - 1 AS fall, MIN(k) OVER (PARTITION BY {keys}, peak) AS since FROM {name}_l),
{name}_w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY fall, k) AS o FROM {name}_f),
{name}_g AS (
  SELECT {keys}, 100 * (ARG_MAX(nav, dt) / ARG_MIN(nav, dt) - 1) AS total, 100 * (POWER(ARG_MAX(nav, dt) / ARG_MIN(nav, dt), CAST(252 AS DOUBLE) / (COUNT(*) - {less})) - 1) AS annual, 100 * {spread}(r) * SQRT(252) AS volatility,
    SUM(turnover) / ((COUNT(*) - {less}) / CAST(252 AS DOUBLE)) AS turnover, 100 * AVG(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END) AS win_rate FROM {name}_l GROUP BY {keys}),
{name} AS (
  SELECT {pre("g")}, total, annual, volatility, annual / NULLIF(volatility, 0) AS sharpe, -100 * fall AS max_drawdown, k - since AS duration, annual / NULLIF(-100 * fall, 0) AS calmar, g.turnover, win_rate
  FROM {name}_g g JOIN {name}_w w ON {on} AND w.o = 1)"""


def renamed(text: str, suffix: str, *names: str) -> str:
    """``text`` with ``suffix`` behind each of ``names``, so that it can stand beside the original."""
    return re.sub(rf"\b({'|'.join(names)})\b(?!\()", rf"\g<1>{suffix}", text)


def rounded(columns: str, source: str, plain: str = "", where: str = "") -> str:
    """A query of ``plain`` columns and of ``columns`` rounded to 8 places."""
    keep = f"{plain}, " if plain else ""
    return f"SELECT {keep}{', '.join(f'ROUND({c.strip()}, 8) AS {c.strip()}' for c in columns.split(','))} FROM {source}" + (f" WHERE {where}" if where else "")


def query(*parts: str) -> str:
    """Common table expressions, the last part being the query; one named ``walk`` refers to itself."""
    return ("WITH RECURSIVE " if any(p.startswith("walk AS") for p in parts) else "WITH ") + ",\n".join(parts[:-1]) + "\n" + parts[-1]
