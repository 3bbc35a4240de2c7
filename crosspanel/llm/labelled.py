"""A bounded sample of labelled documents, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import remainder

#: Labelled documents that a classifier learns from at most.  They are those of the least hash, so the choice
#: doesn't depend on order or partitioning.
SAMPLE = 6_000
#: Documents of this remainder of crc32(doc_id) modulo ``FOLDS`` are held out.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str) -> F.Column:
    return F.coalesce(remainder(id_col, FOLDS) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """``(text, label double)`` of at most ``size`` labelled documents that are not held out.

    Labels other than 0 and 1 are left out; of several labels of a document the greatest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("label"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(size)  # bounded by `size`, so it may be broadcast
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").select("id", "text", "label")
