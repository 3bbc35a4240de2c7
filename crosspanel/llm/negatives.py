"""Operator 13: hard negatives by a full sort of each anchor's scores.

Rows go to shards by a hash of their id, once; anchors are sent past every shard in batches.  A shard scores an anchor
against all its rows (whole numbers), sorts by score and id, and answers in two passes.  In the first it gives the best
rows of the anchor's label; those of all shards make the anchor's positives.  In the second an anchor comes with the
scores of its positives: for each, a binary search in the sorted scores of other labels finds the upper limit, and the
first rows from there to the lower limit are the answer.  Shards' answers are ranked again, so the result is that of one
sort over all rows.  A task holds one shard and the scores of a few anchors.  Cost is that of scoring every anchor against
every row, which the task asks for; nothing else grows with the square.

Rows whose id, label or vector is null, or whose vector holds a null or non-finite component (or one that 64 bits can't hold
once scaled), take no part.  An id counts once: of several rows that with the least (label, vector).  Only vectors of one
length are scored with each other.  Equal scores rank by id; scores beyond 64 bits are compared exactly and given as the
largest or smallest number.  An anchor without a positive, or a positive without a row between its limits, has no
row in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm import integers
from crosspanel.llm._shared import cut, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a shard at most and at least, on average, and anchors scored at a time.
SHARD, LEAST, TOGETHER = 65_536, 8_192, 64


class Shard:
    """Rows of one shard in the order of their ids, and each label's places."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]

    def sorted_scores(self, x: np.ndarray, anchors: np.ndarray, labels: np.ndarray, same: bool):
        """For each anchor its number, and ids and scores of the rows of the same or of other labels, best first."""
        for a in range(0, len(x), TOGETHER):
            scores = integers.products(x[a : a + TOGETHER], self.x)
            for i, row in enumerate(scores, a):
                at = np.flatnonzero((self.labels == labels[i]) == same)
                at = at[self.ids[at] != anchors[i]]
                s = row[at]
                order = np.argsort(-s, kind="stable")  # ties stay in the order of ids
                yield i, self.ids[at[order]], s[order]


def between(scores: np.ndarray, positive: int, k: int, low: int, high: int) -> tuple[int, int]:
    """Where in ``scores``, which fall, the first ``k`` lie with low * positive <= 100 * score <= high * positive."""
    least, most = -((-low * positive) // 100), (high * positive) // 100
    first = int(np.searchsorted(-scores, -most, side="left"))
    return first, max(first, min(first + k, int(np.searchsorted(-scores, -least, side="right"))))


def _passed(rows: DataFrame, asked: DataFrame, shards: int, answer, schema: str) -> DataFrame:
    """What ``answer(shard, anchors)`` yields when ``asked(id, label, v, positives, scores)`` passes every shard of ``rows(id, label, v)``."""
    deal = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<decimal(38,0)>")
    left = rows.select(F.size("v").alias("width"), deal.alias("shard"), F.lit(False).alias("asks"), "id", "label", "v", none[0].alias("positives"), none[1].alias("scores"))
    right = asked.select(F.size("v").alias("width"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "label", "v", "positives", "scores")

    def run(batches):
        now, held, shard = None, [], None
        for b in batches:
            width, number, asks = (np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("width", "shard", "asks"))
            turn = np.flatnonzero((width[1:] != width[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if (width[lo], number[lo]) != now:
                    now, held, shard = (width[lo], number[lo]), [], None
                part = b.slice(lo, hi - lo)
                own = part.column("id").to_numpy(), part.column("label").to_numpy(), integers.matrix(part.column("v"), int(width[lo]))
                if not asks[lo]:
                    held.append(own)
                elif held:
                    shard = shard or Shard(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    yield from answer(shard, *own, part)

    dealt = left.union(right).repartition("width", "shard").sortWithinPartitions("width", "shard", "asks")
    return dealt.mapInArrow(run, schema)


def _batch(columns: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def mined(vectors: DataFrame, is_anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; ``is_anchor`` is a condition on ``id``."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"))
    whole = integers.scaled(plain.where("id IS NOT NULL AND label IS NOT NULL"), "x").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    rows = cut(whole.select("id", "r.label", "r.v"), "negatives")
    anchors = rows.where(is_anchor)
    n = rows.count()
    shards = max(1, -(-n // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)))
    pairs = [("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.decimal128(38, 0))]
    bands = [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.decimal128(38, 0)), ("id", pa.int64()), ("score", pa.decimal128(38, 0))]

    def alike(shard, ids, labels, x, _part):
        out = [[], [], []]
        for i, found, scores in shard.sorted_scores(x, ids, labels, True):
            for c, v in zip(out, ([int(ids[i])] * len(found[:positives]), found[:positives].tolist(), scores[:positives].tolist()), strict=True):
                c.extend(v)
        yield _batch(out, pairs)

    def unlike(shard, ids, labels, x, part):
        known, scores_of = part.column("positives").to_pylist(), part.column("scores").to_pylist()
        out = [[], [], [], [], []]
        for i, found, scores in shard.sorted_scores(x, ids, labels, False):
            for p, s in zip(known[i], scores_of[i], strict=True):
                lo, hi = between(scores, int(s), negatives, low, high)
                for c, v in zip(out, ([int(ids[i])] * (hi - lo), [p] * (hi - lo), [s] * (hi - lo), found[lo:hi].tolist(), scores[lo:hi].tolist()), strict=True):
                    c.extend(v)
        yield _batch(out, bands)

    nothing = F.array().cast("array<bigint>").alias("positives"), F.array().cast("array<decimal(38,0)>").alias("scores")
    near = _passed(rows, anchors.select("id", "label", "v", *nothing), shards, alike, "anchor_id long, id long, score decimal(38,0)")
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    chosen = near.withColumn("o", F.row_number().over(best)).where(F.col("o") <= positives)
    listed = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("o", "id", "score"))).alias("p"))
    asked = anchors.join(listed.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", F.col("p.id").alias("positives"), F.col("p.score").alias("scores"))
    found = _passed(rows, asked, shards, unlike, "anchor_id long, positive_id long, positive_score decimal(38,0), id long, score decimal(38,0)")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "id")
    long = lambda c: F.greatest(F.least(F.col(c), F.lit(integers.MOST)), F.lit(-integers.MOST - 1)).cast("long").alias(c)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", long("positive_score"), long("negative_score"))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """A seventh of the labels is moved by one, as the contract of the query has it."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.withColumn("label", moved), F.col("id") % 50 == 0)
