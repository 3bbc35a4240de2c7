"""As-of joins: to each row the last row of another table that isn't later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, block: Column | None = None) -> DataFrame:
    """All columns of ``left``, and the other columns of the last row of ``right`` with equal ``keys`` and ``on`` up to the row's own; NULL if there is none.

    Both tables are sorted together once, and the last known row is carried forward, so no row of ``right`` is copied to
    the dates that it holds for.  Of several rows of one time the greatest counts; rows without a time match nothing.  With
    ``block``, an expression of ``on`` that never falls (such as the year), rows of a key are dealt by block as well: a key with
    very many rows is then sorted in many tasks, and each block starts from the last row of those before it.
    """
    taken = [c for c in right.columns if c not in keys and c != on]
    held = F.struct(*taken)
    kind = right.select(held.alias("r")).schema["r"].dataType
    mine = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_held"))
    theirs = right.where(F.col(on).isNotNull()).select(*keys, on, F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    both = mine.unionByName(theirs)
    deal = [*keys]
    if block is not None:
        both, deal = both.withColumn("_block", block), [*keys, "_block"]
    now = Window.partitionBy(*deal).orderBy(on, "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_last", F.last("_held", ignorenulls=True).over(now))
    if block is not None:
        ends = both.groupBy(*deal).agg(F.max(F.when(F.col("_side") == 0, F.struct(on, "_held"))).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(c).alias(f"{c}_") for c in deal], F.last("_end", ignorenulls=True).over(before)["_held"].alias("_before"))
        same = F.lit(True)
        for c in deal:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        known = known.join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return known.where("_side = 1").select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in taken])
