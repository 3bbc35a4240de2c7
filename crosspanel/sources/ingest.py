"""Incremental ingest: a partitioned table takes in what is new since its last date, and may be fed the same rows twice."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.sources.stages import _fs


def high_water(spark: SparkSession, path: str, on: str = "dt") -> datetime.date | None:
    """The table's last date, None if there is no table or no row."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.parquet(path).agg(F.max(on).alias("d")).first()["d"]


def take_in(rows: DataFrame, path: str, on: str = "dt", grain: str = "month", part: str = "part") -> list[str]:
    """Write ``rows`` from the period of the table's last date on, one folder ``part=yyyy-MM-dd`` a period; the periods written.

    The period of the last date is written anew, as it may have been incomplete; earlier ones aren't touched, and the
    filter on dates reaches the source's scan.  Only the written periods are replaced (dynamic overwrite), so a run that was
    killed or is repeated leaves each row once.
    """
    spark = rows.sparkSession
    mark = high_water(spark, path, on)
    if mark is not None:
        rows = rows.where(F.col(on) >= F.trunc(F.lit(mark), grain))
    new = rows.where(F.col(on).isNotNull()).withColumn(part, F.date_format(F.date_trunc(grain, F.col(on)), "yyyy-MM-dd"))
    periods = sorted(r[part] for r in new.select(part).distinct().collect())  # a row a period
    if periods:
        new.repartition(part, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return periods
