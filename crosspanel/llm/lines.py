"""Operator 11: lines that several documents have.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case.  Keys of at least ``CHARS``
characters that at least ``DOCS`` documents have lose all their lines but those of the largest id among them.

Native: everything is DataFrame functions.  Lines are exploded and hashed; a first count of hashes, combined before
its shuffle, leaves those that occur often enough at all, and only their places go on (a written table).  There
distinct documents are counted by (hash, id) first, so a key that a third of the lines share is counted in all tasks.
What both joins on hashes look up is a written table, so they have plain exchanges on both sides and Spark can split a
hash that is everywhere.
The places to drop return to the texts in one join by row, and lines are put together again by position, in slices
between dropped places.

Null and empty texts are one empty line.  Rows of one id are one document, and so are all rows without an id, which is
smaller than any other; each row is judged and returned by itself.  A text of any length is split once, without
its shorter or longer lines being looked up in each other.  Keys and rows are known by 128 bits.  An empty
table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import cut, texts

CHARS, DOCS = 20, 3
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: F.Column) -> F.Column:
    """Only texts beyond ASCII go through the slow replacement of single letters."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def names(prefix: str, *columns: F.Column) -> list[F.Column]:
    """128 bits of the columns."""
    return [F.xxhash64(*columns).alias(f"{prefix}1"), F.xxhash64(F.lit(1), *columns).alias(f"{prefix}2")]


def line_dedup(docs: DataFrame, chars: int = CHARS, least: int = DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row struct, kept string, n_lines long, n_dropped long)``: all columns of each row, and what is left of its text."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    own = names("r", ident, text)
    every = docs.select(*own, ident.alias("id"), F.posexplode(lines_of(text)).alias("pos", "line")).withColumn("key", key_of(F.col("line")))
    hashed = every.where(F.char_length("key") >= chars).select("r1", "r2", "id", "pos", *names("k", F.col("key")))
    often = cut(hashed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("k1", "k2"), "often")
    places = cut(hashed.join(often, ["k1", "k2"]), "lines")
    counted = places.groupBy("k1", "k2").agg(F.count_distinct(F.struct("id")).alias("n"), F.max("id").alias("keeper"))
    shared = cut(counted.where(F.col("n") >= least).select("k1", "k2", "keeper"), "shared")
    dropped = places.join(shared, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = dropped.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), *own)
    split = rows.join(gone, ["r1", "r2"], "left").select("row", lines_of(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    edge = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    parts = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", F.get("edge", k) + 2, F.get("edge", k + 1) - F.get("edge", k) - 1))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.flatten(parts))
    return split.withColumn("edge", edge).select("row", F.array_join(kept, "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def op11_lines(spark, sf_dir: str) -> DataFrame:
    return line_dedup(texts(spark, sf_dir)).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
