"""Operators on tables written by hand, with the values that they must give."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.stats import average_rank, concordance, correlation, roll, sample_skew
from crosspanel.operators import backtest, combine, evaluate, factors, features, legacy, membership, preprocess
from crosspanel.operators.trees import Growth
from crosspanel.sources import files
from crosspanel.streaming import bars as stream

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(60)]


def panel(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, values, column="close_price"):
    return panel(spark, [(1, DAYS[k], v) for k, v in enumerate(values)], f"stock long, dt date, {column} double")


def values(df, column):
    return [r[column] for r in df.orderBy("stock", "dt").collect()]


def test_windows_wait_until_they_are_full_and_skip_missing_values(spark):
    got = values(one(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0]).withColumn("m", roll(F.avg, "close_price", 3)), "m")
    assert got == [None, None, 2.0, None, None, None, 6.0]
    assert values(one(spark, [1.0, None, 3.0]).withColumn("m", roll(F.avg, "close_price", 3, 2)), "m") == [None, None, 2.0]


def test_new_high_counts_rows_before_a_full_window_as_no(spark):
    got = values(factors.new_high_ratio(one(spark, [1.0, 2.0, 3.0, 4.0], "high_price"), 2, 2), "new_high_ratio")
    assert got == [None, 0.5, 1.0, 1.0]


def test_returns_reach_back_over_missing_closes(spark):
    got = preprocess.with_returns(one(spark, [1.0, None, 3.0], "close_adj"))
    assert values(got, "ret") == [None, 0.0, 2.0] and values(got, "log_ret") == [None, None, None]


def test_repairs(spark):
    raw = panel(spark, [(1, DAYS[0], 10.0, None, 4.0, 8.0, None), (1, DAYS[1], 10.0, 9.0, None, 8.0, None), (1, DAYS[2], 10.0, 9.0, 4.0, 8.0, 3.0)], "stock long, dt date, close_price double, close_adj double, volume double, amount double, vwap double")
    got = preprocess.repaired(raw)
    assert values(got, "close_adj") == [10.0, 9.0, 9.0] and values(got, "vwap") == [pytest.approx(2.0), 10.0, 3.0]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (10.0, 20.0), (None, 1.0)], "x double, y double")
    r = df.agg(correlation("x", "y").alias("c"), sample_skew("x").alias("s"), concordance("x", "x").alias("k")).first()
    assert r["c"] == pytest.approx(1) and r["s"] == pytest.approx(1.7636, abs=1e-4) and r["k"] == pytest.approx(1)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(correlation("x", "y").alias("c"), sample_skew("x").alias("s")).first()
    assert flat["c"] is None and flat["s"] is None
    ties = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (0, 3.0)], "g int, x double").select(average_rank("x", "g").alias("r"))
    assert sorted(r["r"] for r in ties.collect()) == [1.0, 2.5, 2.5, 4.0]


def test_coefficients_need_ten_names_and_variance(spark):
    rows, returns = [], []
    for k in range(3):
        for s in range(10):
            rows.append(("f", s, DAYS[k], float(s)))
            rows.append(("flat", s, DAYS[k], 1.0))
            if s < 9:
                rows.append(("few", s, DAYS[k], float(s)))
            returns.append((s, DAYS[k], 0.01 * s))
    tidy = spark.createDataFrame(rows, "factor string, stock int, dt date, value double")
    got = evaluate.ic(tidy, spark.createDataFrame(returns, "stock int, dt date, ret double")).collect()
    assert {(r["factor"], r["dt"]) for r in got} == {("f", DAYS[0]), ("f", DAYS[1])} and all(r["ic"] == pytest.approx(1) for r in got)


def test_forward_return(spark):
    df = panel(spark, [(1, DAYS[k], r) for k, r in enumerate([0.1, 0.2, 0.3])], "stock int, dt date, ret double")
    assert values(evaluate.forward_return(df), "fwd") == [0.2, 0.3] and values(evaluate.forward_return(df, 2), "fwd") == [0.3]
    assert values(evaluate.forward_return(df, 2, cumulative=True), "fwd") == [pytest.approx(1.2 * 1.3 - 1)]


STINTS = "stock int, in_date date, out_date date"


def test_membership_edges(spark):
    stints = spark.createDataFrame([(1, DAYS[2], DAYS[4]), (1, DAYS[6], None), (2, DAYS[0], DAYS[9]), (2, DAYS[5], DAYS[9])], STINTS)
    grid = spark.createDataFrame([(s, d) for s in (1, 2, 3) for d in DAYS[:12]], "stock int, dt date")
    inside = {(r["stock"], r["dt"]) for r in membership.filter_members(grid, stints).collect()}
    assert {d for s, d in inside if s == 1} == {*DAYS[2:5], *DAYS[6:12]} and {d for s, d in inside if s == 2} == set(DAYS[:10])
    assert membership.filter_members(grid, stints).count() == len(inside)
    dense = membership.member_matrix(stints, grid)
    assert dense.count() == 24 and {(r["stock"], r["dt"]) for r in dense.where("is_member").collect()} == inside
    masked = membership.mask_nonmembers(grid.withColumn("v", F.lit(1.0)), stints, "v")
    assert masked.count() == 36 and masked.where("v is not null").count() == len(inside)
    assert {r["stock"] for r in membership.members_both_ends(stints, str(DAYS[0]), str(DAYS[8])).collect()} == {2}
    assert {r["stock"] for r in membership.members_overlap(stints, str(DAYS[3]), str(DAYS[3])).collect()} == {1, 2}


def test_layers_share_their_boundaries(spark):
    tidy = spark.createDataFrame([("f", s, DAYS[0], float(s)) for s in range(11)], "factor string, stock int, dt date, value double")
    got = {}
    for r in evaluate.layer_members(tidy, 5).collect():
        got.setdefault(r["layer"], set()).add(r["stock"])
    assert got == {j: {2 * j, 2 * j + 1, 2 * j + 2} for j in range(5)}
    weights = evaluate.layer_members(tidy, 5).groupBy("layer").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in weights)


def nav_inputs(spark):
    prices = {1: [0.0, 0.1, 0.1, -0.1, 0.0, 0.2], 2: [0.0, 0.0, 0.2, 0.1, None, 0.1]}
    signal = {1: [2.0, 1.0, 1.0, 1.0, 3.0, 1.0], 2: [1.0, 2.0, 2.0, 2.0, 1.0, 2.0]}
    returns = spark.createDataFrame([(s, DAYS[k], r) for s, rs in prices.items() for k, r in enumerate(rs)], "stock int, dt date, ret double")
    sig = spark.createDataFrame([("x", s, DAYS[k], v) for s, vs in signal.items() for k, v in enumerate(vs)], "signal string, stock int, dt date, value double")
    return sig, returns, prices, signal


def test_long_only_earns_first_and_pays_then(spark):
    sig, returns, prices, signal = nav_inputs(spark)
    nav, held, want = 1.0, None, []
    for k in range(6):
        if held:
            nav *= 1 + (prices[held][k] or 0)
        if k % 2 == 0:
            best = max((1, 2), key=lambda s: (signal[s][k], -s))
            if held and best != held:
                nav *= 1 - 0.002 * 2
            held = best
        want.append(nav)
    got = backtest.long_only(sig, returns, (0.1,), freq=2).orderBy("dt").collect()
    assert [r["nav"] for r in got] == pytest.approx(want) and [r["turnover"] for r in got] == [0, 0, 2, 0, 2, 0]


def test_layer_nav_pays_first_and_earns_the_same_day(spark):
    sig, returns, prices, signal = nav_inputs(spark)
    tidy = sig.withColumnRenamed("signal", "factor")
    nav, held, want = 1.0, None, []
    for k in range(6):
        if k and k % 2 == 0:
            best = max((1, 2), key=lambda s: signal[s][k - 2])
            nav *= 1 - 0.001 * (1 if held is None else 2 * (best != held))
            held = best
        nav *= 1 + (prices[held][k] or 0) if held else 1
        want.append(nav)
    got = evaluate.layer_nav(tidy, returns, layers=2, freq=2).where("layer = 1").orderBy("dt").collect()
    assert [r["nav"] for r in got] == pytest.approx(want)


def test_drawdown_is_counted_from_the_first_peak(spark):
    nav = spark.createDataFrame([("x", DAYS[k], v, 0.0) for k, v in enumerate([1.0, 1.2, 1.1, 1.2, 0.9, 1.0, 1.3, 1.2])], "signal string, dt date, nav double, turnover double")
    r = backtest.drawdown(nav, "signal").first()
    assert r["max_drawdown"] == pytest.approx(0.25) and r["duration"] == 3
    m = backtest.metrics(nav, "signal").first()
    assert m["total"] == pytest.approx(20) and m["annual"] == pytest.approx(100 * (1.2 ** (252 / 8) - 1)) and m["win_rate"] == pytest.approx(400 / 7)


def test_best_percentage(spark):
    rows = spark.createDataFrame([("a", 0.05, 1.0), ("a", 0.1, 1.0), ("a", 0.2, float("nan")), ("b", 0.05, None), ("b", 0.2, -1.0)], "signal string, pct double, sharpe double")
    assert {tuple(r) for r in backtest.optimal_pct(rows).collect()} == {("a", 0.05), ("b", 0.2)}


def test_compounding_by_month(spark):
    days = [dt.date(2020, 1, 30), dt.date(2020, 1, 31), dt.date(2020, 2, 3), dt.date(2020, 3, 2), dt.date(2020, 3, 3)]
    rows = [(1, d, 0.1) for d in days] + [(2, d, None if d == days[4] else 0.2) for d in days]
    got = {(r["stock"], r["dt"]): r["ret"] for r in features.monthly_returns(spark.createDataFrame(rows, "stock int, dt date, ret double")).collect()}
    assert got == {(1, days[1]): pytest.approx(0.21), (2, days[1]): pytest.approx(0.44), (1, days[4]): pytest.approx(0.21), (2, days[4]): None}


def test_scc_is_the_same_in_blocks_of_stocks(spark):
    day = dt.date(2024, 1, 1)
    data = [(s, day + dt.timedelta(i), None if (s * i) % 11 == 5 else math.sin(s * 3 + i * i % 17) / 10) for s in range(23) for i in range(9)]
    panel = spark.createDataFrame(data, "stock long, dt date, ret double")
    whole, parts = ({(r["stock"], r["dt"]): r["scc"] for r in factors.scc(panel, 5, block=b).collect()} for b in (2000, 4))
    assert whole and whole.keys() == parts.keys()
    assert all(abs(whole[k] - parts[k]) < 1e-12 for k in whole)
    ret = {(s, d): x for s, d, x in data}
    last = day + dt.timedelta(8)
    window = [day + dt.timedelta(i) for i in range(4, 9)]
    found = []
    for other in range(1, 23):
        pairs = [(ret[0, d], ret[other, d]) for d in window if ret[0, d] is not None and ret[other, d] is not None]
        n = len(pairs)
        a, b = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
        va, vb = sum((x - a) ** 2 for x, _ in pairs) / n, sum((y - b) ** 2 for _, y in pairs) / n
        if n >= 2 and va > 1e-8 and vb > 1e-8:
            found.append(sum((x - a) * (y - b) for x, y in pairs) / n / math.sqrt(va * vb))
    assert abs(whole[0, last] - sum(found) / len(found)) < 1e-9


@pytest.mark.parametrize("sizes", [(8192, 8192, 128), (3, 7, 2)])
def test_windows_with_the_same_gaps_are_correlated_as_one(monkeypatch, sizes):
    """The sums are those of all pairs, and the work is that of rows times patterns of gaps."""
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.1, size=(60, 40))
    r[rng.random(r.shape) < 0.1] = np.nan
    r[:30, 3] = np.nan
    r[5], r[6, 1:] = 0.25, np.nan  # without variance, and too short
    own = np.arange(60) % 2
    for k, v in zip(("PIECE", "CHUNK", "PIECES"), sizes, strict=True):
        monkeypatch.setattr(factors, k, v)

    def pair(x, y):
        both = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[both], y[both]
        return np.corrcoef(x, y)[0, 1] if both.sum() >= 10 and x.var() > 1e-8 and y.var() > 1e-8 else np.nan

    whole = np.array([[np.nan if i == j else pair(r[i], r[j]) for j in range(60)] for i in range(60)])
    for a, b, meets in ((0, 0, (own[:, None] == 0) & (own == 0)), (0, 1, own[:, None] != own)):
        total, pairs = factors._correlation_sums(r, own, a, b, 10)
        want = np.where(meets, whole, np.nan)
        assert np.allclose(total, np.nansum(want, 1), atol=1e-9) and (pairs == (~np.isnan(want)).sum(1)).all()
    asked, towards = [], factors._towards
    monkeypatch.setattr(factors, "_towards", lambda x, masks, least: asked.append(len(x.r) * len(masks)) or towards(x, masks, least))
    many = np.tile(r[:2], (500, 1))
    factors._correlation_sums(many, np.zeros(1000, int), 0, 0, 10)
    assert sum(asked) <= 1000 * (2 + 1000 // sizes[0])


def test_wide_rows_of_the_factor_table_are_dealt_once(spark):
    """What is computed by stock or put to a stock's rows needs no exchange of the panel."""
    rows = [(s, DAYS[k], *(5.0 + s + k,) * 4, 100.0, 100.0 + s, 0.01, 0.01 * ((s * k) % 7)) for s in range(3) for k in range(30)]
    p = panel(spark, rows, "stock long, dt date, " + ", ".join(f"{c} double" for c in factors.INPUTS))
    stints = panel(spark, [(0, DAYS[0], None), (1, DAYS[0], DAYS[3]), (1, DAYS[25], None)], "stock long, in_date date, out_date date")
    got = factors.factor_table(p, stints, 5, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\(stock#\w+, dt#", plan)
    held = {(r["stock"], r["dt"]): r for r in got.collect()}
    assert len(held) == 90 and held[0, DAYS[29]]["bias"] is not None and held[0, DAYS[29]]["arc"] is not None
    assert {k for k, r in held.items() if r["bias"] is not None} == {(0, d) for d in DAYS[4:30]} | {(1, d) for d in DAYS[25:30]}


def test_relative_cost(spark):
    rng = [10 + math.sin(k) for k in range(15)]
    turn = [0.05 + 0.01 * (k % 3) for k in range(15)]
    df = spark.createDataFrame([(1, DAYS[k], rng[k], turn[k]) for k in range(15)], "stock int, dt date, close_adj double, turnover double")
    got = factors.relative_cost(df, 12).orderBy("dt").collect()
    assert [r["dt"] for r in got] == DAYS[12:15]
    p, t = rng[1:13], turn[1:13]
    w = [t[j] * (1 - sum(t[: j + 1]) / (j + 1)) ** (11 - j) for j in range(12)]
    w = [x / sum(w) for x in w]
    r = [0.0] + [p[11] / p[j - 1] - 1 for j in range(1, 12)]
    mean = sum(a * b for a, b in zip(w, r, strict=True))
    assert got[0]["arc"] == pytest.approx(mean) and got[0]["vrc"] == pytest.approx(sum(a * (b - mean) ** 2 for a, b in zip(w, r, strict=True)))


def test_selection_of_factors(spark):
    scored = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.8, 0.1), ("c", 0.7, 0.001), ("d", 0.6, 0.05)], "factor string, score double, ic_mean double")
    corr = spark.createDataFrame([("a", "b", 0.9), ("a", "d", 0.1)], "a string, b string, corr double")
    assert combine.select_factors(scored, corr, 1, 3) == ["a", "d"] and combine.select_factors(scored, corr, 3, 3) == ["a", "b", "c"]
    assert evaluate.pruned(corr) == (["a"], ["b"])


def drift_inputs(spark, locked=()):
    w = spark.createDataFrame([("x", 0, 1, 0.5), ("x", 0, 2, 0.5), ("x", 2, 1, 1.0)], "s string, i int, stock int, weight double")
    prices = {1: [1.0, 2.0, 2.0, 4.0], 2: [1.0, 1.0, 2.0, 9.0]}
    rows = [(s, DAYS[k], p, (s, k) not in locked, (s, k) not in locked) for s, ps in prices.items() for k, p in enumerate(ps)]
    return w, spark.createDataFrame(rows, "stock int, dt date, price double, can_buy boolean, can_sell boolean")


@pytest.mark.parametrize("in_task", [legacy.IN_TASK, 1])
def test_drift(spark, in_task):
    got = legacy.drift_nav(*drift_inputs(spark), "s", fee=0.1, in_task=in_task).orderBy("dt").collect()
    base = 0.9 * 2.0 * (1 - 0.1 * 1.0)  # 0.5 and 0.5 have both doubled; half is sold and bought
    assert [r["nav"] for r in got] == pytest.approx([0.9, 0.9 * 1.5, base, 2 * base])
    assert [r["turnover"] for r in got] == pytest.approx([1, 0, 1, 0])


@pytest.mark.parametrize("in_task", [legacy.IN_TASK, 1])
def test_a_locked_name_keeps_its_weight(spark, in_task):
    got = legacy.drift_nav(*drift_inputs(spark, {(2, 2)}), "s", fee=0.0, in_task=in_task).orderBy("dt").collect()
    assert [r["nav"] for r in got] == pytest.approx([1.0, 1.5, 2.0, 2.0 * (1 + 0.5 * 1.0 + 0.5 * 3.5)])
    assert got[2]["turnover"] == pytest.approx(0)


def test_steps_and_tasks_hold_the_same(spark):
    """Series with rebalancings of their own, names that can't be traded, come late, leave, or have no price on a date."""
    r = np.random.default_rng(5)
    w, prices = [], []
    for s in range(3):
        for i in sorted(r.choice(12, 6 - s, replace=False).tolist()):
            chosen = r.choice(15, 6, replace=False).tolist()
            w += [(f"s{s}", i, n, 1 / 6) for n in chosen]
    for n in range(15):
        for k in range(int(r.integers(0, 3)), 12 - int(r.integers(0, 3))):
            if r.random() < 0.85:
                prices.append((n, dt.date(2020, 1, k + 1), float(r.uniform(1, 3)), bool(r.random() < 0.7), bool(r.random() < 0.7)))
    prices += [(99, dt.date(2020, 1, k + 1), 1.0, True, True) for k in range(12)]
    weights = spark.createDataFrame(w, "s string, i int, stock int, weight double")
    state = spark.createDataFrame(prices, "stock int, dt date, price double, can_buy boolean, can_sell boolean")
    one, many = (legacy.drift_nav(weights, state, "s", in_task=k).orderBy("s", "dt").collect() for k in (100, 1))
    assert [tuple(x)[:2] for x in one] == [tuple(x)[:2] for x in many] and len(one) > 20
    assert [x for row in one for x in row[2:]] == pytest.approx([x for row in many for x in row[2:]], nan_ok=True)
    nothing = weights.where("false")
    assert all(legacy.drift_nav(nothing, state, "s", in_task=k).count() == 0 for k in (100, -1))


def test_wide_files(spark, tmp_path):
    df = spark.createDataFrame([("a", DAYS[0], 1.0), ("a", DAYS[1], None), ("b", DAYS[1], 2.5)], "stock string, dt date, value double")
    files.write_wide_csv(df, "value", str(tmp_path / "f"))
    back = files.read_factors(spark, {"f": str(tmp_path / "f")})
    assert {tuple(r) for r in back.collect()} == {("f", "a", DAYS[0], 1.0), ("f", "b", DAYS[1], 2.5)}
    with pytest.raises(Exception, match="duplicate"):
        files.long_to_wide(df.union(df), "value", DAYS[:2]).collect()


def test_csv_contract(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("trade_dt,index_close,market_return\n20200102,10.5,NaN\nbad,1,2\n2020-01-03,11,0.1\n")
    got = files.read_csv(spark, str(path), files.MARKET_INDEX).orderBy("index_close").collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 2.0), (dt.date(2020, 1, 2), 10.5, None), (dt.date(2020, 1, 3), 11.0, 0.1)]


def test_stream_gives_the_batch_bars_of_closed_windows(spark, tmp_path):
    rows = [(k, dt.datetime(2020, 1, 1 + k // 10, k % 10), k % 3, "e", float(k * 7 % 11), "") for k in range(100)]
    events = spark.createDataFrame(rows, stream.EVENTS.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in range(5):
        events.where(f"event_id >= {part * 20} and event_id < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.write_bars(stream.streaming_bars(stream.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    from crosspanel.sources.tables import bars

    batch = bars(events, "user_id", F.to_date("ts"), F.col("value"), F.lit(1.0), F.col("value"), ["ts", "event_id"])
    whole = {tuple(r) for r in batch.select("stock", "dt", "open_price", "high_price", "low_price", "close_price", "volume", "amount").collect()}
    assert got and got <= whole and {r for r in whole if r[1] < dt.date(2020, 1, 7)} <= got


def test_loaders_by_parts_of_names(spark, tmp_path):
    (tmp_path / "index.csv").write_text("Trade_Date,Market_Return\n20200101,0.01\n20200102,\n2020-01-03,-0.02\n")
    (tmp_path / "level.csv").write_text("日期,index_close\n20200102,110\n20200101,100\n20200103,99\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    got = [(str(r["dt"]), r["market_return"]) for r in files.read_benchmark(spark, str(tmp_path / "index.csv")).orderBy("dt").collect()]
    assert got == [("2020-01-01", 0.01), ("2020-01-03", -0.02)]
    got = [(str(r["dt"]), round(r["market_return"], 12)) for r in files.read_benchmark(spark, str(tmp_path / "level.csv")).orderBy("dt").collect()]
    assert got == [("2020-01-02", 0.1), ("2020-01-03", -0.1)]
    assert files.read_benchmark(spark, str(tmp_path / "other.csv")) is None

    (tmp_path / "s.csv").write_text(",20200101,20200102\nA,1.5,\nB,,2\n")
    sig, missing = files.read_signals(spark, {"s": str(tmp_path / "s.csv"), "gone": str(tmp_path / "gone.csv")})
    assert sorted((r["signal"], r["stock"], str(r["dt"]), r["value"]) for r in sig.collect()) == [("s", "A", "2020-01-01", 1.5), ("s", "B", "2020-01-02", 2.0)]
    assert missing == ["gone"]

    (tmp_path / "m.csv").write_text("stock_code,in_date,out_date,cur_sign,short_code\nA,20200101,,1,a\nB,20200101,20200601,0,b\nC,,,0,c\n")
    got = sorted((r["stock"], str(r["in_date"]), str(r["out_date"])) for r in files.read_membership(spark, str(tmp_path / "m.csv")).collect())
    assert got == [("A", "2020-01-01", "None"), ("B", "2020-01-01", "2020-06-01")]


def test_contracts_of_csv_tables(spark, tmp_path):
    for name, schema, line in (
        ("prices", files.PRICES, "A,20200101,1,2,3,4,5,6,7,8,9"),
        ("value", files.MARKET_VALUE, "A,20200101,10,9"),
        ("turnover", files.TURNOVER, "A,20200101,10"),
        ("index", files.MARKET_INDEX, "20200101,10,0.1"),
    ):
        columns = [c.strip().split(" ")[0] for c in schema.split(",")]
        (tmp_path / name).write_text(",".join(columns) + "\n" + line + "\n" + line.replace("20200101", "soon").replace("10", "NaN") + "\n")
        got = files.read_csv(spark, str(tmp_path / name), schema)
        assert got.columns == columns and got.count() == 2 and got.where("trade_dt = date'2020-01-01'").count() == 1


def test_names_with_a_bar_keep_their_names(spark):
    rows = [("a|b", s, DAYS[k], float((s * 7 + k) % 11)) for s in range(12) for k in range(20)]
    tidy = panel(spark, rows, "factor string, stock long, dt date, value double")
    returns = panel(spark, [(s, DAYS[k], 0.001 * ((s + k) % 5)) for s in range(12) for k in range(20)], "stock long, dt date, ret double")
    assert [r["factor"] for r in evaluate.abs_retry(tidy, returns).collect()] == ["a|b"]
    assert evaluate.signal_analysis(tidy.withColumnRenamed("factor", "signal"), returns, panel(spark, [("a|b", "c", 3, 0.5)], "a string, b string, n long, corr double")).first()["corr"] == {"c": 0.5}


def test_trees_learn_a_plain_rule(spark):
    rows = [(s, DAYS[k], float((s * 5 + k * 3) % 13), None if k == 0 else 0.01 * ((s * 5 + (k - 1) * 3) % 13)) for s in range(20) for k in range(40)]
    p = panel(spark, rows, "stock long, dt date, x double, ret double")
    for made in (combine.forest_signal(p, ["x"], 10, 5), combine.boosted_signal(p, ["x"], Growth(trees=40, depth=3, gamma=0.0, l1=0.0, columns=1.0)), combine.walk_forward_signal(p, ["x"], 10, 12, 2)):
        both = made.join(p.select("stock", "dt", "x"), ["stock", "dt"])
        assert both.agg(F.corr("value", "x")).first()[0] > 0.9


def test_date_range_reaches_the_scan(spark, tmp_path):
    from crosspanel.sources.tables import trade_bars

    rows = [(1, 1, 1, 1, dt.datetime(2020, m, 5), 2.0, 10.0) for m in range(1, 7)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = trade_bars(spark, str(tmp_path), since="2020-02-01", until="2020-04-01")
    assert got.count() == 2 and "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in got._jdf.queryExecution().toString()
