"""Documents as coded blocks: one dictionary of distinct words for some megabytes of text.

A block is what one task has read in a row, up to a fixed number of bytes.  Its rows are of two kinds:
``kind`` 0, one row for each bucket of word hashes that the block has words in (``payload``: those words, their
codes and counts), and ``kind`` 1, one row for each document (``id``, ``flag``, ``payload``: its words as codes of
the block's dictionary, most frequent first).  A word then crosses the network once for each block that has it,
not once for each occurrence; all blocks' rows of a bucket meet in one place, and so do all rows of a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind int, block long, bucket int, id long, flag boolean, payload binary"
NAMES = ["kind", "block", "bucket", "id", "flag", "payload"]
#: Characters of text and distinct words that end a block.
BLOCK_CHARS, BLOCK_WORDS = 12 << 20, 250_000
_ONE, _HIGH = 192, 62


def planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2**32, byte by byte, so that zero bytes lie together."""
    return b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)


def unplane(raw: memoryview | bytes, n: int, columns: int) -> list[np.ndarray]:
    a = np.frombuffer(raw, np.uint8, 4 * n * columns).reshape(columns, 4, n)
    return [np.ascontiguousarray(x.T).view("<u4").ravel() for x in a]


def pack_words(words: list[bytes], codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Words with their codes (ascending) and counts."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    head = planes(np.diff(codes, prepend=0), counts, lens)
    return len(words).to_bytes(4, "little") + zstandard.compress(head + b"".join(words), 1)


def unpack_words(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n, data = int.from_bytes(raw[:4], "little"), zstandard.decompress(raw[4:])
    codes, counts, lens = unplane(data, n, 3)
    ends = (np.cumsum(lens, dtype=np.int64) + 12 * n).tolist()
    return [data[a:b] for a, b in zip([12 * n, *ends], ends, strict=False)], np.cumsum(codes, dtype=np.int64), counts


def unpack_codes(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    return np.cumsum(unplane(zstandard.decompress(raw[4:]), n, 3)[0], dtype=np.int64)


def pack(codes: np.ndarray) -> bytes:
    """Numbers as bytes: one for the smallest ones, three for the others, then entropy coded."""
    rest = codes >= _ONE
    big = codes[rest] - _ONE
    if len(big) and int(big.max()) >> 13 >= _HIGH:
        return b"\0" + zstandard.compress(codes.astype("<u4").tobytes(), 1)
    first = codes.astype(np.uint8)
    first[rest] = _ONE + (big >> 13)
    low = (big & 8191).astype(np.uint16)
    return b"\1" + len(codes).to_bytes(8, "little") + zstandard.compress(first.tobytes() + (low & 255).astype(np.uint8).tobytes() + (low >> 8).astype(np.uint8).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\0":
        return np.frombuffer(zstandard.decompress(raw[1:]), "<u4")
    n = int.from_bytes(raw[1:9], "little")
    a = np.frombuffer(zstandard.decompress(raw[9:]), np.uint8)
    codes = a[:n].astype(np.uint32)
    at = np.flatnonzero(codes >= _ONE)
    low = a[n : n + len(at)].astype(np.uint32) + (a[n + len(at) :].astype(np.uint32) << 8)
    codes[at] = ((codes[at] - _ONE) << 13) + low + _ONE
    return codes


def batch(kind: int, block: int, buckets, ids, flags, payloads) -> pa.RecordBatch:
    n = len(payloads)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, block)), pa.array(buckets, pa.int32()), pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(payloads, pa.binary())], names=NAMES
    )


def _emit(block: int, known: dict, docs: list, key: Callable, buckets: int) -> Iterator[pa.RecordBatch]:
    m = len(known)
    every = np.concatenate([c for _, _, c in docs]) if docs else np.zeros(0, np.uint32)
    order = np.argsort(-np.bincount(every, minlength=m), kind="stable")
    rank = np.empty(m, np.uint32)
    rank[order] = np.arange(m, dtype=np.uint32)
    counted = [c for _, flag, c in docs if not flag]
    n = np.bincount(np.concatenate(counted), minlength=m) if counted else np.zeros(m, np.int64)
    words = [key(w) for w in known]
    home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, m)
    turn = np.lexsort((rank, home))
    bounds = np.searchsorted(home[turn], np.arange(buckets + 1))
    held = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
    for a in range(0, len(held), 500):
        part = [(b, turn[bounds[b] : bounds[b + 1]]) for b in held[a : a + 500]]
        none = [None] * len(part)
        yield batch(0, block, [b for b, _ in part], none, none, [pack_words([words[i] for i in at.tolist()], rank[at].astype(np.int64), n[at]) for _, at in part])
    for a in range(0, len(docs), 500):
        part = docs[a : a + 500]
        yield batch(1, block, [None] * len(part), [i for i, _, _ in part], [f for _, f, _ in part], [pack(rank[c]) for _, _, c in part])


def coded(docs: DataFrame, id_col: str, text_col: str, split: Callable[[str], list], key: Callable[[object], bytes], flag: F.Column) -> DataFrame:
    """Blocks of ``docs``, dealt by block.  ``split`` makes a text's words and ``key`` the bytes of a word.

    Counts are of the occurrences in documents whose ``flag`` is false.  Blocks follow from the input's own
    partitions, so a lost task makes the same ones again.
    """
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part, number, size, known, held = TaskContext.get().partitionId(), 0, 0, {}, []
        for b in batches:
            ids, texts, flags = (b.column(k) for k in range(3))
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                words = split(text)
                held.append((ids[i].as_py(), bool(flags[i].as_py()), np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))))
                size += len(text)
                if size >= BLOCK_CHARS or len(known) >= BLOCK_WORDS:
                    yield from _emit((part << 24) + number, known, held, key, buckets)
                    number, size, known, held = number + 1, 0, {}, []
        if held:
            yield from _emit((part << 24) + number, known, held, key, buckets)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), flag.alias("flag"))
    return rows.mapInArrow(run, SCHEMA).repartition("block")
