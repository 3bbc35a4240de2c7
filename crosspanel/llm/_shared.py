"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: An odd multiplier, so that its powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made where none is set and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables written inside each open ``scratch``.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``cut`` writes inside are removed at the end.  What is yielded is a ``cut`` whose table stays."""
    made, stay = [], []
    token = _OPEN.set((*_OPEN.get(), made))

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        stay.append(made.pop())
        return out

    try:
        yield kept
    finally:
        _OPEN.reset(token)
        for path in made:
            remove(spark, path)
        for outer in _OPEN.get()[-1:]:
            outer.extend(stay)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for inner in _OPEN.get()[-1:]:
        inner.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``.  Long rows go to Python in small batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(29))


class Rolling:
    """Hashes of all stretches of a symbol sequence from one prefix sum (polynomial modulo 2**64)."""

    _powers = np.ones(1, U64)
    _inverse = np.ones(1, U64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if n >= len(Rolling._powers):
            size = max(2 * len(Rolling._powers), n + 1)
            up, down = np.full(size, BASE, U64), np.full(size, pow(BASE, -1, 2**64), U64)
            up[0] = down[0] = 1
            Rolling._powers, Rolling._inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * Rolling._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``values[s:e]`` for each pair; equal stretches of equal length have equal hashes."""
        return mix((self.sums[ends] - self.sums[starts]) * Rolling._inverse[starts] + U64(0x51ED27) * (ends - starts).astype(U64))

    def every(self, width: int) -> np.ndarray:
        """Hash of each stretch of ``width`` symbols, by its start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * Rolling._inverse[:n] + U64(0x51ED27 * width))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    a = np.frombuffer(raw, np.uint8)
    black = np.zeros(len(a) + 2, np.int8)
    black[1:-1] = (a != 0x20) & ((a < 0x09) | (a > 0x0D))
    edge = np.diff(black)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, U64)
    return starts, ends, Rolling(mix(a.astype(U64) + U64(0x1234567))).of(starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def remainder(column: str, by: int) -> F.Column:
    """crc32 of a number written in decimals, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
