"""Operator 6: byte-level BPE encoding and decoding over a global table of distinct words.

Pre-tokens are coded in blocks (``blocks.py``), each distinct word of the whole corpus is sent to one place and
merged there once (by tiktoken), its ids go back to the blocks that have it, and each document is put together by position.
Decoding looks ids up in the token-byte table, whose size is that of the vocabulary file.

Nulls and empty texts have no ids and decode to no bytes; null and repeated ids keep a row each; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import blocks
from crosspanel.llm._shared import texts

PATTERN = public_tokenizers.PATTERN
#: Tokens that a vocabulary file may have: it is read by the driver and sent to every executor.
MAX_TOKENS = 1_000_000


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file, which is bounded by ``MAX_TOKENS``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{path} has more than {MAX_TOKENS} tokens")
    return ranks


#: The white space of Unicode, which the pattern's ``\\s`` means.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that splits a text by ``pattern``; ASCII texts take a form without Unicode classes."""
    exact = re.sub(r"(\[\^?)\\s", lambda m: m[1] + SPACE, pattern).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    whole = regex.compile(exact)
    plain = re.sub(r"(\[[^\]]*)\\p\{L\}", r"\1A-Za-z", exact)
    plain = re.sub(r"(\[[^\]]*)\\p\{N\}", r"\g<1>0-9", plain).replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    if r"\p" in plain:
        return whole.findall
    ascii_ = re.compile(plain)
    return lambda text: (ascii_ if text.isascii() else whole).findall(text)


def encode(docs: DataFrame, path: str | None = None, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for each row: the tokens of the whole text, special tokens as plain text."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    split = splitter(pattern)
    coded = blocks.coded(docs, id_col, text_col, split, lambda w: w.encode("utf-8", "surrogatepass"), F.lit(False))

    def words(batches):
        for b in batches:
            yield b.filter(pc.equal(b.column("kind"), 0)).select(["block", "bucket", "payload"])

    def encoded(batches):
        one = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        now, done = None, {}
        for b in batches:
            out = []
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if bucket != now:
                    now, done = bucket, {}
                found = []
                for w in blocks.unpack_words(raw)[0]:
                    ids = done.get(w)
                    if ids is None:
                        ids = done[w] = one(w.decode("utf-8", "surrogatepass"))
                    found.append(ids)
                lens = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter(chain.from_iterable(found), np.int64, int(lens.sum()))
                out.append(len(lens).to_bytes(4, "little") + zstandard.compress(blocks.planes(lens) + blocks.planes(flat), 1))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind")
        own = right.filter(pc.equal(kind, 0))
        codes = dict(zip(own.column("bucket").to_pylist(), map(blocks.unpack_codes, own.column("payload").to_pylist()), strict=True))
        docs_ = right.filter(pc.equal(kind, 1))
        top = max((int(c[-1]) for c in codes.values()), default=-1) + 1
        size, start, flat, used = np.zeros(top, np.int64), np.zeros(top, np.int64), [], 0
        for bucket, raw in zip(left.column("bucket").to_pylist(), left.column("ids").to_pylist(), strict=True):
            n, data = int.from_bytes(raw[:4], "little"), zstandard.decompress(raw[4:])
            lens = blocks.unplane(data, n, 1)[0].astype(np.int64)
            total = int(lens.sum())
            flat.append(blocks.unplane(data[4 * n :], total, 1)[0].astype(np.int32))
            size[codes[bucket]], start[codes[bucket]] = lens, np.cumsum(lens) - lens + used
            used += total
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        ids, ends = [], [0]
        for raw in docs_.column("payload").to_pylist():
            of = blocks.unpack(raw)
            lens = size[of]
            total = int(lens.sum())
            ids.append(flat[np.repeat(start[of] - (np.cumsum(lens) - lens), lens) + np.arange(total)])
            ends.append(ends[-1] + total)
        values = np.concatenate(ids) if ids else flat
        return pa.table({id_col: docs_.column("id").combine_chunks(), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))})

    back = coded.mapInArrow(words, "block long, bucket int, payload binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encoded, "block long, bucket int, ids binary")
    return back.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, f"`{id_col}` long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids_col, decoded binary)``: the bytes of each row's tokens, from the token-byte table.

    The table, of the vocabulary's bounded size, is a constant of the plan: token bytes as hexadecimal digits, looked up
    by id, joined and turned into bytes.  Ids that the vocabulary hasn't got give no bytes.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = {i: w for w, i in vocabulary(path).items()}
    digits = F.split(F.lit(",".join(table.get(i, b"").hex() for i in range(max(table) + 1))), ",")
    decoded = F.unhex(F.array_join(F.transform(F.coalesce(ids_col, F.array().cast("array<int>")), lambda i: F.get(digits, i)), ""))
    return tokens.select(id_col, ids_col, decoded.alias("decoded"))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    done = decode(encode(docs))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
