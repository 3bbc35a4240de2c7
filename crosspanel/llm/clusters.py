"""Operator 12: centroid clustering by delta Lloyd.

The vectors lie in a written table with their assignment: cluster and squared distance.  The driver holds the centroids
and their global sums and counts (k rows of whole numbers).  A round compares each vector with the centroids that the
last round changed, and with all of them only if its own is one of these.  Vectors that change their cluster send their
components as signed numbers, out of the old sum and into the new one, added up in each task first; no round
sums all vectors again.  Each state is written to the shared folder and its predecessor removed, so a lost executor
costs its tasks alone.  A round that changes no centroid ends the work: later ones would change nothing.

Everything is whole numbers, so the result doesn't depend on partitioning.  Vectors that are null, have another number of
components, or hold a null or non-finite one (or one that 64 bits can't hold once scaled) take no part.  Repeated rows
count each.  The first centroids are those of the least hash of the id; ties of hashes go by id, then vector, and rows
without an id are last.  With fewer vectors than ``k`` each starts a cluster.  Equal distances go to the smaller cluster;
distances and sums over 2**63 - 1 are given as that.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import integers
from crosspanel.llm._shared import remove, shared_folder, table

K, ROUNDS, SEED, WIDTH = 40, 5, 2, 64
_STATE = "vec_id {id}, v array<double>, was int, cluster int, distance long"


def _assigned(state: DataFrame, centroids: list[list[int]], changed: list[int]) -> DataFrame:
    """``state`` after a comparison with the centroids ``changed`` since the last one."""
    shared = state.sparkSession.sparkContext.broadcast((np.array(centroids, np.float64), np.array(sorted(changed), np.int64)))
    schema = state.schema

    def run(batches):
        at, new = shared.value
        for b in batches:
            x = integers.matrix(b.column("v"), at.shape[1])
            was, near = np.asarray(b.column("cluster")), np.asarray(b.column("distance"))
            owner, distance = was.astype(np.int64), near.astype(object) if (near == integers.MOST).any() else near.copy()
            whole = np.isin(was, new) | (was < 0) | (near == integers.MOST)
            for rows, those in ((np.flatnonzero(whole), np.arange(len(at))), (np.flatnonzero(~whole), new)):
                if not len(rows) or not len(those):
                    continue
                d = integers.distances(x[rows], at[those])
                first = d.argmin(1)
                least, who = d[np.arange(len(rows)), first], those[first]
                if those is new:
                    better = (least < distance[rows]) | ((least == distance[rows]) & (who < owner[rows]))
                    rows, least, who = rows[better], least[better], who[better]
                owner[rows] = who
                distance = distance.astype(object) if least.dtype == object else distance
                distance[rows] = least
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(integers.clipped(distance), pa.int64())], schema.names)

    return state.mapInArrow(run, schema)


def _transfers(state: DataFrame, k: int, width: int) -> dict[tuple[int, int], int]:
    """Changes of each cluster's sums, by (cluster, position), and of its count, at position ``width``: k x (width + 1) numbers at most."""

    def run(batches):
        total = np.zeros((k, width + 1), object)
        for b in batches:
            x = np.concatenate([integers.matrix(b.column("v"), width), np.ones((b.num_rows, 1))], 1)
            for column, sign in (("cluster", 1), ("was", -1)):
                who = np.asarray(b.column(column))
                for c in np.unique(who[who >= 0]):
                    own = x[who == c]
                    exact = own if len(own) * np.abs(own).max() < 2**52 else np.array([[int(v) for v in row] for row in own.tolist()], object)
                    total[c] += sign * np.array([int(v) for v in exact.sum(0).tolist()], object)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([str(v) for v in total[at].tolist()], pa.string())], ["c", "p", "n"])

    moved = state.where("was <> cluster").select("v", "was", "cluster").mapInArrow(run, "c int, p int, n string")
    return {(r["c"], r["p"]): int(r["n"]) for r in moved.groupBy("c", "p").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, v, was, cluster, distance)`` of each vector after ``rounds`` rounds and a last assignment, and the centroids."""
    spark = vectors.sparkSession
    ready = integers.scaled(vectors, vector_col, width).select(F.col(f"`{id_col}`").alias("vec_id"), "v", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(integers.MOST).alias("distance"))
    schema = _STATE.format(id=ready.schema["vec_id"].dataType.simpleString())
    number = 0
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        nonlocal number
        path, number = f"{folder}/{number}", number + 1
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(schema).parquet(path), path

    state, path = kept(ready)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.orderBy(by_hash.asc_nulls_last(), "vec_id", "v").limit(k).select("v").collect()
    centroids = [[int(x) for x in r["v"]] for r in first]
    if not centroids:
        return state, []
    sums, counts, changed = [[0] * width for _ in centroids], [0] * len(centroids), list(range(len(centroids)))
    for turn in range(rounds + 1):
        after, its_path = kept(_assigned(state, centroids, changed))
        remove(spark, path)
        state, path = after, its_path
        if turn == rounds:
            break
        for (c, p), n in _transfers(state, len(centroids), width).items():
            if p == width:
                counts[c] += n
            else:
                sums[c][p] += n
        means = [[s // n for s in sums[c]] if (n := counts[c]) else centroids[c] for c in range(len(centroids))]
        changed = [c for c, m in enumerate(means) if m != centroids[c]]
        centroids = means
        if not changed:
            break
    return state, centroids


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    state, centroids = clustered(table(spark, sf_dir, "embeddings"))
    parts = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # a row a cluster
    every = sum(int(r["n"]) for r in parts)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(r["cluster"], min(int(r["n"]), integers.MOST), min(every, integers.MOST), digest[r["cluster"]]) for r in parts]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
