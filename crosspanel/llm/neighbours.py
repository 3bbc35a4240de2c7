"""Operator 10: approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by a learnt rotation (principal axes, then iterative quantisation).  A code is split
into ``PARTS`` substrings, each with an index of its own: the values that occur, and each one's rows.  Substrings have
thresholds t with the sum of t + 1 being r + 1, so that codes within Hamming radius r agree in some substring up to its
threshold, and probing the values within it finds all of them.  They are verified on the whole code and ranked by
exact Euclidean distance.  The radius grows for queries that find too few.

Each row goes once to a shard, by a hash of its id, and the queries are sent past every shard in batches; a shard
answers with its nearest rows, and those of all shards are ranked.  The rotation is fitted on a bounded sample
(``SAMPLE``), while every row is indexed.

Vectors that are null, empty, zero, hold null or non-finite components, or differ in length from the most common
one of the sample take no part, nor do null ids.  An id counts once: of a query's rows the one of the least vector
asks, of a neighbour's rows the nearest one answers, and rows of the query's id are its own.  Equal distances rank by
id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm._shared import U64, table

SAMPLE, BITS, PARTS, ROUNDS = 20_000, 64, 4, 30
#: First radius, and the share of a shard that a query has to find before the radius stops growing.
RADIUS, SHARE = 20, 0.15
#: Rows of a shard at most and at least, on average: more shards than that would only repeat the queries.
SHARD, LEAST = 65_536, 8_192


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(ok & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code's bits."""
    mean = sample.mean(0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    p = axes[:, ::-1][:, : min(bits, x.shape[1])]
    y = x @ p
    r, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(p.shape[1],) * 2))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
        r = (u @ vt).T
    return mean, p @ r


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    b = (x - mean) @ projection > 0
    packed = np.zeros((len(b), 8), np.uint8)
    small = np.packbits(b, axis=1, bitorder="little")
    packed[:, : small.shape[1]] = small
    return packed.view("<u8").ravel().astype(U64)


def thresholds(radius: int, parts: int) -> list[int]:
    """One for each substring; -1 for none."""
    return [(radius + 1) // parts - 1 + (i < (radius + 1) % parts) for i in range(parts)]


class Index:
    """Substring indexes over the codes of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, c: np.ndarray, bits: int):
        self.ids, self.x, self.codes, self.bits = ids, x, c, bits
        edges = np.linspace(0, bits, PARTS + 1).astype(int)
        self.parts = [(U64(lo), U64((1 << int(hi - lo)) - 1)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        self.lists = []  # values, and where each one's rows lie in the list of rows
        for lo, m in self.parts:
            part = (c >> lo) & m
            rows = np.argsort(part, kind="stable")
            values, first = np.unique(part[rows], return_index=True)
            self.lists.append((values, np.append(first, len(rows)), rows))

    def within(self, q: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes lie within ``radius`` bits of ``q``."""
        seen = np.zeros(len(self.codes), bool)
        for (lo, m), (values, bounds, rows), t in zip(self.parts, self.lists, thresholds(radius, PARTS), strict=True):
            hit = np.flatnonzero(np.bitwise_count(values ^ ((q >> lo) & m)) <= t) if t >= 0 else []
            if len(hit):
                n = bounds[hit + 1] - bounds[hit]
                seen[rows[np.repeat(bounds[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ q) <= radius]

    def search(self, qid: np.ndarray, qx: np.ndarray, qc: np.ndarray, k: int):
        """Query ids, row ids and distances of each query's nearest rows found."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        want = min(len(self.ids), max(4 * k, int(np.ceil(SHARE * len(self.ids)))))
        for i in range(len(qid)):
            radius = RADIUS
            rows = self.within(qc[i], radius)
            while len(rows) < want and radius < self.bits:
                radius += 2
                rows = self.within(qc[i], radius)
            rows = rows[self.ids[rows] != qid[i]]
            d = np.sqrt(((self.x[rows] - qx[i]) ** 2).sum(1))
            order = np.lexsort((self.ids[rows], d))
            _, first = np.unique(self.ids[rows[order]], return_index=True)  # of an id's rows the nearest
            best = order[np.sort(first)[:k]]
            out.append((np.full(len(best), qid[i]), self.ids[rows[best]], d[best]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` nearest ids of ``vectors`` found for each id of ``queries``."""
    spark = vectors.sparkSession
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    lens = np.asarray(sample.value_lengths())
    width = int(np.bincount(lens).argmax())
    learnt = spark.sparkContext.broadcast(rotation(_matrix(sample.filter(pa.array(lens == width)), width)))
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width)
    n = rows.count()
    shards = max(-(-n // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")

    def search(batches):
        """Rows of a shard come first and become its index, queries follow and are answered batch by batch."""
        mean, projection = learnt.value
        now, held, index = None, [], None
        for b in batches:
            shard, asks = np.asarray(b.column("shard")), np.asarray(b.column("asks").to_numpy(zero_copy_only=False))
            turn = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), b.num_rows], strict=True):
                if hi == lo:
                    continue
                if shard[lo] != now:
                    now, held, index = shard[lo], [], None
                ids, x = b.column("id").slice(lo, hi - lo).to_numpy(), _matrix(b.column("v").slice(lo, hi - lo), width)
                if not asks[lo]:
                    held.append((ids, x))
                elif held:
                    if index is None:
                        every, x_ = (np.concatenate(c) for c in zip(*held, strict=True))
                        index = Index(every, x_, codes(x_, mean, projection), projection.shape[1])
                    found = index.search(ids, x, codes(x, mean, projection), k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", id_col, "score"])

    dealt = left.union(right).repartition("shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(search, f"query_id long, `{id_col}` long, score double")
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
