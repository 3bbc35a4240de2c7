"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(src, dst)``: the smallest node that can be reached.

    Self links and repeated links are fine; an empty table gives an empty result.  Each round is two joins on
    a node with its smallest neighbour, so no neighbourhood is ever gathered in one place, and ends in a
    written table.  Rounds grow with the logarithm of the longest chain; ``rounds`` of them without an end are an error.
    """
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before:
            break
        before = (state.n, state.s)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
