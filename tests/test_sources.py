"""Sources and sinks that go on where they stopped, read databases, and report what is missing."""

import datetime
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import asof, legacy, strategy
from crosspanel.sources import arrays, files, ingest
from crosspanel.sources.stages import Stages

DAY = datetime.date(2024, 1, 15)


def days(spark, first, n, stocks=3):
    rows = [(s, DAY + datetime.timedelta(first + k), float(s + k)) for k in range(n) for s in range(stocks)]
    return spark.createDataFrame(rows, "stock long, dt date, x double")


def test_ingest_rewrites_the_open_period_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert ingest.high_water(spark, path) is None
    assert ingest.take_in(days(spark, 0, 40), path) == ["2024-01-01", "2024-02-01"]
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=2024-01-01/*")}
    assert ingest.high_water(spark, path) == DAY + datetime.timedelta(39)
    assert ingest.take_in(days(spark, 0, 55), path) == ["2024-02-01", "2024-03-01"]
    assert ingest.take_in(days(spark, 0, 55), path) == ["2024-03-01"]  # again: the same rows
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=2024-01-01/*")} == before
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.select("stock", "dt", "x").collect())) == sorted(map(tuple, days(spark, 0, 55).collect()))
    assert ingest.take_in(days(spark, 0, 0), path) == []
    plan = spark.read.parquet(path).where(F.col("dt") >= F.trunc(F.lit(DAY), "month"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(dt), GreaterThanOrEqual(dt" in plan


def test_stages_resume(spark, tmp_path):
    source, folder, runs = f"{tmp_path}/in", f"file://{tmp_path}/stages", []
    days(spark, 0, 3).write.parquet(source)

    def build(n=1):
        runs.append(n)
        return spark.range(n)

    def broken():
        return spark.range(4).withColumn("x", F.raise_error(F.lit("stopped")))

    one = Stages(spark, folder, [source], depth=6)
    with pytest.raises(Exception, match="stopped"):
        one.table("a", broken).count()
    assert not one.finished("a")
    assert one.table("a", lambda: build(3)).count() == 3
    assert Stages(spark, folder, [source], depth=6).table("a", build).count() == 3 and runs == [3]  # read
    other = Stages(spark, folder, [source], depth=7)
    assert other.table("a", lambda: build(5)).count() == 5 and runs == [3, 5]  # another parameter
    os.makedirs(f"{tmp_path}/stages/b-{other.key}")  # a stage that was killed
    assert other.clean() == sorted([f"a-{one.key}", f"b-{other.key}"])
    assert other.finished("a") and not one.finished("a")
    days(spark, 3, 1).write.mode("append").parquet(source)
    assert Stages(spark, folder, [source], depth=7).key != other.key  # another input


def test_predictions_are_saved_and_read(spark, tmp_path, monkeypatch):
    rows = [(s, DAY + datetime.timedelta(k), 0.01 * ((s * 7 + k * 3) % 11 - 5), float((s * 7 + (k + 1) * 3) % 11), float((s * k) % 5)) for k in range(30) for s in range(15)]
    panel = spark.createDataFrame(rows, "stock long, dt date, ret double, good double, gru_daily double")
    calls = []
    plain = lambda name: lambda panel, names: calls.append(name) or panel.select("stock", "dt", F.lit(1.0).alias("value"))
    monkeypatch.setattr(strategy.combine, "network_signal", plain("network"))
    monkeypatch.setattr(strategy.combine, "boosted_signal", plain("trees"))
    source = f"{tmp_path}/in"
    panel.write.parquet(source)
    for _ in range(2):
        got = strategy.predictions(panel, ["good", "gru_daily"], Stages(spark, f"file://{tmp_path}/stages", [source]), limits={"price": (1, 1), "model": (1, 1)})
    assert calls == ["network", "trees"]
    assert {(r["factor"], r["category"], r["direction"]) for r in got["chosen"].collect()} >= {("good", "price", "positive")}
    one = {(r["stock"], r["dt"]): r["value"] for r in got["model1"].collect()}
    assert all(r["value"] == pytest.approx((one[(r["stock"], r["dt"])] + 2) / 3) for r in got["final"].collect())


def test_jdbc_reads_batches_of_stocks(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    names = [f"{k:06d}.S'H" for k in range(7)]
    rows = [(n, DAY + datetime.timedelta(k), float(k)) for n in names for k in range(5)]
    spark.createDataFrame(rows, "stock_code string, trade_dt date, close_price double").write.jdbc(url, "prices", properties={"createTableColumnTypes": "stock_code VARCHAR(20)"})
    got = files.read_jdbc(spark, url, "prices", names[:5] + names[:1], '"stock_code"', batch=2)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 25
    some = got.where(F.col("trade_dt") > DAY + datetime.timedelta(2)).select("stock_code", "close_price")
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(trade_dt), *GreaterThan(trade_dt" in plan and "ReadSchema: struct<stock_code:string,close_price:double>" in plan
    assert some.count() == 10
    assert files.read_jdbc(spark, url, "prices", [], '"stock_code"').count() == 0 and files.read_jdbc(spark, url, "prices").count() == 35


def test_factor_folder(spark, tmp_path):
    for name in ("BIAS", "CGO", "factor_summary"):
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write(",2024-01-02,2024-01-03\nA,1.5,\nB,,2\n")
    with open(f"{tmp_path}/notes.txt", "w") as f:
        f.write("x")
    tidy, missing = files.read_factor_folder(spark, str(tmp_path), ("BIAS", "SUE", "APB"))
    assert missing == ["APB", "SUE"]
    assert sorted((r["factor"], r["stock"], r["value"]) for r in tidy.collect()) == [("BIAS", "A", 1.5), ("BIAS", "B", 2.0), ("CGO", "A", 1.5), ("CGO", "B", 2.0)]


@pytest.mark.parametrize("blocks", [False, True])
def test_asof_join(spark, blocks):
    left = days(spark, 0, 60, 4).withColumn("n", F.lit("left")).union(days(spark, 0, 0).withColumn("n", F.lit("")))
    left = left.unionByName(spark.createDataFrame([(None, DAY, 0.0, "null"), (1, None, 0.0, "null")], left.schema))
    marks = [(0, 3, "a"), (0, 3, "b"), (0, 31, "c"), (1, -400, "d"), (1, 59, None), (2, 70, "late"), (9, 0, "other")]
    right = spark.createDataFrame([(s, DAY + datetime.timedelta(k), v) for s, k, v in marks] + [(3, None, "never")], "stock long, dt date, v string")
    got = asof.asof_join(left, right, ["stock"], "dt", F.trunc("dt", "month") if blocks else None)
    assert got.columns == ["stock", "dt", "x", "n", "v"]

    def last(stock, dt):
        fit = [(k, v or "", v) for s, k, v in marks if dt and s == stock and DAY + datetime.timedelta(k) <= dt]
        return max(fit)[2] if fit else None

    found = got.collect()
    assert len(found) == 4 * 60 + 2 and all(r["v"] == last(r["stock"], r["dt"]) for r in found)


def test_average_price_falls_back_to_the_close_before(spark):
    rows = [(1, DAY, 10.0, 10.5, 5.0, 0.0), (1, DAY + datetime.timedelta(1), 11.0, 0.0, 5.0, 0.1), (1, DAY + datetime.timedelta(2), 12.0, None, 0.0, 0.2), (2, DAY, 7.0, None, 5.0, 0.0)]
    panel = spark.createDataFrame(rows, "stock long, dt date, close_adj double, vwap double, volume double, ret double")
    assert [r["price"] for r in legacy.trading_state(panel, price="vwap").orderBy("stock", "dt").collect()] == [10.5, 10.0, 11.0, None]
    assert [r["price"] for r in legacy.trading_state(panel).orderBy("stock", "dt").collect()] == [10.0, 11.0, 12.0, 7.0]


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">i2", "u1"])
def test_npy_blocks(spark, tmp_path, kind):
    x = np.random.default_rng(3).integers(0, 200, size=(1000, 4, 3)).astype(kind)
    np.save(f"{tmp_path}/x.npy", x)
    got = arrays.read_npy(spark, f"{tmp_path}/x.npy", block=90 * 12 * x.itemsize)
    assert got.rdd.getNumPartitions() == 12
    assert [r["x"] for r in got.orderBy("row").collect()] == x.reshape(1000, 12).astype(float).tolist()
    few = arrays.read_npy(spark, f"file://{tmp_path}/x.npy", columns=[2, 11]).orderBy("row").collect()
    assert [r["x"] for r in few] == x.reshape(1000, 12)[:, [2, 11]].astype(float).tolist()


def test_npy_of_one_dimension_and_none(spark, tmp_path):
    np.save(f"{tmp_path}/one.npy", np.arange(5.0))
    np.save(f"{tmp_path}/none.npy", np.zeros((0, 3)))
    assert [(r["row"], r["x"]) for r in arrays.read_npy(spark, f"{tmp_path}/one.npy").orderBy("row").collect()] == [(k, [float(k)]) for k in range(5)]
    assert arrays.read_npy(spark, f"{tmp_path}/none.npy").count() == 0
    np.save(f"{tmp_path}/names.npy", np.array(["a", "b"]))
    np.save(f"{tmp_path}/columns.npy", np.asfortranarray(np.ones((3, 2))))
    for name in ("names", "columns"):
        with pytest.raises(Exception, match="not an array of numbers|one after another"):
            arrays.read_npy(spark, f"{tmp_path}/{name}.npy").count()
