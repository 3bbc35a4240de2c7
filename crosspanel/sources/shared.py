"""Tables in the folder that all executors share: where a result is used more than once, it is written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A name under ``spark.checkpoint.dir`` that nothing has yet.  Where that setting is missing (tests, one machine) a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: what lies before it is computed once, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same, dealt by ``key`` into buckets: what is done by ``key`` with the table's rows needs no exchange."""
    path, n = new_folder(df.sparkSession, name), partitions(df.sparkSession)
    table = path.rpartition("/")[2].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
