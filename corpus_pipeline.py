"""From raw documents to token ids: five stages, each of which calls one operator of ``crosspanel.llm``.

Each stage works on all rows that the one before it kept; its result is written as Parquet in the shared folder and
read again.  Nulls, empty and repeated rows fare as the operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import bpe, decontaminate, labelled, quality, simhash, substring
from crosspanel.llm._shared import cut, table, texts
from crosspanel.llm.repeats import keyed

#: Documents that score less are rejected.  Between this and the query's 0.7 a document is in doubt and stays.
REJECTED = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "quality"))
    return quality.scored(docs, model).where(F.col("score") >= REJECTED).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, null ids last."""
    return simhash.near_duplicates_dropped(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that lie in repeated windows; texts without any stay as they are."""
    found = substring.repeats_removed(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    own = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    types = dict(docs.dtypes)
    return found.select(*[(own[c].cast(types[c]) if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no passage of the benchmark."""
    own = [f"c{k}" for k in range(len(docs.columns))]  # so that no column of ``docs`` clashes with ``row_key``
    id_col, text_col = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    base = keyed(docs.toDF(*own), id_col, text_col)
    leaks = decontaminate.leaks(base.select("row_key", F.col(text_col).alias("text")), table(spark, sf_dir, "benchmark"), id_col="row_key")
    return base.join(leaks.select("row_key").distinct(), "row_key", "left_anti").select(*own).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of the ids and of the bytes that they decode to."""
    return bpe.decode(bpe.encode(docs)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("bpe", tokens)]
#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
