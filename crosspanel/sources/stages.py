"""Jobs that go on where they stopped: results of stages as tables named by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of each file under ``path``, in any store that Spark reads."""
    fs, at = _fs(spark, path)
    found, rest = [], fs.listFiles(at, True)
    while rest.hasNext():
        f = rest.next()
        found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return sorted(found)


class Stages:
    """Tables under ``folder``, each named by its stage and a digest of the input files and parameters.

    A table counts only if the marker that Spark writes last is there, so a stage that was killed is made again and a finished
    one is read.  Changed inputs or parameters give other names; ``clean`` removes what those and killed stages left.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: list[str], **parameters):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []
        known = [files_of(spark, p) for p in sorted(inputs)]
        self.key = hashlib.sha256(json.dumps([known, parameters], sort_keys=True, default=str).encode()).hexdigest()[:24]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.key}"

    def finished(self, name: str) -> bool:
        fs, at = _fs(self.spark, f"{self.path(name)}/_SUCCESS")
        return fs.exists(at)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; ``build`` runs only if it isn't finished."""
        path = self.path(name)
        if not self.finished(name):
            fs, at = _fs(self.spark, path)
            fs.delete(at, True)
            build().write.parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)

    def clean(self) -> list[str]:
        """Remove the folder's tables of other inputs or parameters, and unfinished ones; their names."""
        fs, at = _fs(self.spark, self.folder)
        if not fs.exists(at):
            return []
        gone = []
        for f in fs.listStatus(at):
            name, done = f.getPath().getName(), _fs(self.spark, f"{f.getPath()}/_SUCCESS")
            if f.isDirectory() and not (name.endswith(f"-{self.key}") and done[0].exists(done[1])):
                fs.delete(f.getPath(), True)
                gone.append(name)
        return sorted(gone)
