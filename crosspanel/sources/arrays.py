"""Arrays saved as ``.npy`` files, as a data source of their own: a partition for each block of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block of rows.
BLOCK = 32 << 20


def _opened(path: str):
    """A file that can be read from any place, in a store that Arrow knows."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and start of the numbers."""
    version = npy.read_magic(f)
    shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError("columns are stored one after another: rows can't be read in blocks")
    if dtype.hasobject or dtype.kind not in "fiub":
        raise ValueError(f"not an array of numbers: {dtype}")
    return shape, dtype, f.tell()


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))
        wanted = options.get("columns")
        self.columns = [int(c) for c in wanted.split(",")] if wanted else None

    def partitions(self) -> list[Rows]:
        with _opened(self.path) as f:
            shape, dtype, _ = header(f)
        n = shape[0] if shape else 1
        step = max(1, self.block // max(1, dtype.itemsize * int(np.prod(shape[1:]))))
        return [Rows(k, min(n, k + step)) for k in range(0, n, step)] or [Rows(0, 0)]

    def read(self, partition: Rows):
        with _opened(self.path) as f:
            shape, dtype, start = header(f)
            width = int(np.prod(shape[1:]))
            f.seek(start + partition.first * width * dtype.itemsize)
            raw = f.read((partition.last - partition.first) * width * dtype.itemsize)
        x = np.frombuffer(raw, dtype).reshape(-1, width)
        x = np.ascontiguousarray(x if self.columns is None else x[:, self.columns], np.float64)
        for a in range(0, len(x), 10_000):
            part = x[a : a + 10_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part)) + partition.first), lists], ["row", "x"])


class NpySource(DataSource):
    """``(row long, x array<double>)``: each row's other dimensions flattened, or the ``columns`` of them."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, x array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, columns: list[int] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of an ``.npy`` file, read in parallel blocks of about ``block`` bytes; of ``columns`` only those numbers go on."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("block", block)
    return (reader.option("columns", ",".join(map(str, columns))) if columns else reader).load(path)
