"""CSV contracts: long tables with fixed schemas, wide factor files, and what is written back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.sources.stages import files_of

PRICES = "stock_code string, trade_dt string, close_price double, open_price double, high_price double, low_price double, close_adj double, volume double, amount double, vwap double, adj_factor double"
MARKET_VALUE = "stock_code string, trade_dt string, total_mv double, free_mv double"
TURNOVER = "stock_code string, trade_dt string, amount double"
MARKET_INDEX = "trade_dt string, index_close double, market_return double"
MEMBERSHIP = "stock_code string, in_date string, out_date string, cur_sign int, short_code string"


def date_of(column: str) -> F.Column:
    """A date from ``yyyyMMdd`` or ``yyyy-MM-dd``; NULL for anything else."""
    return F.coalesce(F.try_to_timestamp(F.col(column), F.lit("yyyyMMdd")), F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd"))).cast("date")


def read_csv(spark: SparkSession, path: str, schema: str, dates: tuple[str, ...] = ("trade_dt",)) -> DataFrame:
    """A CSV with a header under an explicit schema; dates that can't be read are NULL, NaN is NULL."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    fixed = {c: date_of(c) for c in dates if c in df.columns}
    fixed |= {c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t == "double"}
    return df.withColumns(fixed)


def read_jdbc(spark: SparkSession, url: str, table: str, stocks: list[str] | None = None, column: str = "stock_code", batch: int = 100, **options: str) -> DataFrame:
    """A database table; with ``stocks`` only their rows, read in parallel by batches of that many names.

    Later filters and selections of columns are handed to the database, together with each batch's condition; a batch whose
    connection fails is read again by its task alone.
    """
    if stocks is None:
        return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    names = sorted(set(stocks))
    quoted = lambda part: ", ".join("'" + x.replace("'", "''") + "'" for x in part)
    conditions = [f"{column} IN ({quoted(names[k : k + batch])})" for k in range(0, len(names), batch)] or ["1 = 0"]
    return spark.read.jdbc(url, table, predicates=conditions, properties=options)


def wide_to_long(wide: DataFrame, stock: str = "stock", name: str = "value") -> DataFrame:
    """``(stock, dt, value)`` from a column for each date; cells without a value are left out."""
    dates = [c for c in wide.columns if c != stock]
    if not dates:
        return wide.select(F.col(stock).alias("stock"), F.lit(None).cast("date").alias("dt"), F.lit(None).cast("double").alias(name)).where("false")
    long = wide.unpivot([stock], [f"`{c}`" for c in dates], "dt", name)
    return long.select(F.col(stock).alias("stock"), date_of("dt").alias("dt"), F.col(name).cast("double").alias(name)).where(F.col(name).isNotNull())


def read_factors(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(factor, stock, dt, value)`` from a wide CSV for each factor."""
    parts = [wide_to_long(spark.read.option("header", True).csv(p).withColumnRenamed("_c0", "stock")).withColumn("factor", F.lit(n)) for n, p in sorted(paths.items())]
    if not parts:
        return spark.createDataFrame([], "factor string, stock string, dt date, value double")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("factor", "stock", "dt", "value")


def read_signals(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """``(signal, stock, dt, value)`` from a wide CSV for each signal, and the names whose file isn't there."""
    found, missing = {}, []
    for name, path in paths.items():
        try:
            spark.read.option("header", True).csv(path)
            found[name] = path
        except AnalysisException:
            missing.append(name)
    return read_factors(spark, found).withColumnRenamed("factor", "signal"), missing


def read_factor_folder(spark: SparkSession, folder: str, expected: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``(factor, stock, dt, value)`` of all CSV files of a folder but the summary, and the expected names that have none."""
    named = {path.rpartition("/")[2].removesuffix(".csv"): path for path, _, _ in files_of(spark, folder) if path.endswith(".csv")}
    named.pop("factor_summary", None)
    return read_factors(spark, named), sorted(set(expected) - set(named))


def column_with(columns: list[str], *parts: str) -> str | None:
    """The first column whose name has one of ``parts``, whatever its case."""
    return next((c for c in columns if any(p.upper() in c.upper() for p in parts)), None)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame | None:
    """``(dt, market_return)`` of an index file whose columns are found by parts of their names.

    Without a column of returns they are changes of a price column; None if there is no date or neither of both, so
    that an equal-weight benchmark can take its place.
    """
    raw = spark.read.option("header", True).csv(path)
    day = column_with(raw.columns, "DATE", "DT", "日期")
    gain, price = column_with(raw.columns, "RETURN", "收益率"), column_with(raw.columns, "CLOSE", "PRICE", "INDEX")
    if day is None or (gain is None and price is None):
        return None
    rows = raw.select(date_of(f"`{day}`").alias("dt"), F.col(f"`{gain or price}`").try_cast("double").alias("x")).where(F.col("dt").isNotNull())
    if gain is None:  # one row a date: small whatever the number of stocks
        rows = rows.withColumn("x", F.try_divide(F.col("x"), F.lag("x").over(Window.partitionBy(F.lit(1)).orderBy("dt"))) - 1)
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x")).select("dt", F.col("x").alias("market_return"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """``(stock, in_date, out_date)`` stints; those without a first date are left out."""
    rows = read_csv(spark, path, MEMBERSHIP, ("in_date", "out_date"))
    return rows.where(F.col("in_date").isNotNull()).select(F.col("stock_code").alias("stock"), "in_date", "out_date")


def long_to_wide(panel: DataFrame, value: str, dates: list) -> DataFrame:
    """A column for each of ``dates``.  Raises (when run) if a stock has two rows of a date, which a pivot would hide."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate stock and date"))).otherwise(F.first(value))
    unique = panel.groupBy("stock", "dt").agg(one.cast("double").alias("v"))
    return unique.groupBy("stock").pivot("dt", dates).agg(F.first("v"))


def write_wide_csv(panel: DataFrame, value: str, path: str) -> None:
    """A wide CSV of one factor; the dates are the panel's, one row each."""
    dates = [r["dt"] for r in panel.select("dt").distinct().orderBy("dt").collect()]
    long_to_wide(panel, value, dates).write.mode("overwrite").option("header", True).csv(path)


def factor_summary(tidy: DataFrame) -> DataFrame:
    """Per factor: stocks, dates and the percentage of the stock x date grid that has no value."""
    with_value = F.col("value").isNotNull()
    per = tidy.groupBy("factor").agg(F.count_distinct("stock").alias("n_stocks"), F.count_distinct("dt").alias("n_dates"), F.count(F.when(with_value, 1)).alias("n_values"))
    return per.withColumn("missing_pct", F.round(100 * (1 - F.col("n_values") / (F.col("n_stocks") * F.col("n_dates"))), 6))
