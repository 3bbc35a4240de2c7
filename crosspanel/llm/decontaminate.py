"""Operator 3: benchmark decontamination by spaced seeds.

A seed is a fixed mask that ignores some positions.  Masked hashes of test items and of
documents are joined; each hit names a document, an item and how they align.  Around the hit the aligned words
are compared, and the longest stretch in which at least ``AGREE`` of the words are equal counts, so substituted
words don't hide a passage.  Such a stretch of ``LEAST`` words, or of the whole item if that is shorter, is a leak.

The masks lose nothing: any stretch of ``LEAST`` or more words that agrees enough has one of ``MASKS`` where all
words are equal, and a shorter item that agrees enough has one of its ``whole_masks``.

Words are runs of letters, their marks and digits in lower case; each sign of Chinese, Japanese and Korean scripts is a word.  Items
under five words have to be equal as a whole, since one substitution leaves them less than ``AGREE``.  Null and empty
texts have no words; repeated rows give repeated results; an empty table on either side gives an empty result.  Of the
ways in which an item can lie on a very long text, only those with enough equal words are looked at; many of them, as in
texts of a few words repeated, are walked along together in blocks of bounded size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import U64, Rolling, cut, mix, signed, table, texts
from crosspanel.llm.repeats import keyed

LEAST, AGREE = 13, 0.8
#: Positions that count.  A stretch of 26 words or more that agrees enough has a part of 13 to 25 words that does, and
#: each pattern of those lengths has one of these masks somewhere (a test goes through all of them).
MASKS = ("1101111", "110010001011", "110101011", "1110111")
#: Masked hashes of the benchmark up to which they are sent to all tasks as a filter; more are joined unfiltered.
FILTER = 4_000_000
#: Cells (ways to lie x words of the item) that are compared at once, and ways from which all are walked along together.
CELLS, FEW = 4_000_000, 16

_BLACK = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_SIGN = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
_WORD = re.compile(f"[{_SIGN}]|[^\\W_{_SIGN}]+")
#: Marks that belong to the letter before them, and words of texts that have any: those take a slower pattern.
_MARK = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M" and not re.match(f"[{_SIGN}]", c))
_MARKS, _MARKED_WORD = re.compile(f"[{_MARK}]"), re.compile(f"[{_SIGN}]|(?:[^\\W_{_SIGN}]|[{_MARK}])+")


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words."""
    text = (text or "").lower()
    if not text.isascii():
        text = " ".join((_MARKED_WORD if _MARKS.search(text) else _WORD).findall(text))
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[0], _BLACK[a].astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, U64)
    return Rolling(mix(a.astype(U64) + U64(0x1234567))).of(starts, ends)


def masked(v: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the positions that count, for each place of the mask."""
    n = len(v) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, len(mask), U64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ v[i : i + n]) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(29)
    return h


def whole_masks(n: int) -> list[str]:
    """Masks of an item of ``n`` words: substitutions that ``AGREE`` allows leave one of them untouched.

    Of one part more than twice the substitutions, those are untouched that no substitution falls into.
    """
    wrong = n - math.ceil(AGREE * n - 1e-9)
    parts = np.array_split(np.arange(n), min(n, 2 * wrong + (wrong > 0)) or 1)
    return ["".join("0" if any(i in parts[k] for k in gone) else "1" for i in range(n)) for gone in combinations(range(len(parts)), wrong)]


def _masks(short: list[int]) -> list[tuple[str, int]]:
    """Masks, and for how many words an item's own (0: items of ``LEAST`` or more)."""
    return [*((m, 0) for m in MASKS), *((m, n) for n in sorted(short) for m in whole_masks(n))]


def _seeds(rows: DataFrame, masks: list[tuple[str, int]], keep: np.ndarray | None, whole: bool) -> DataFrame:
    """``(mask, hash, key, pos)`` of ``rows(key, text)``; with ``keep`` only hashes in it.

    ``whole``: each text is an item and has just the masks for its length.
    """
    if keep is not None:
        bits = np.zeros(1 << 22, bool)
        bits[(keep & U64((1 << 22) - 1)).astype(np.int64)] = True
        shared = rows.sparkSession.sparkContext.broadcast((bits, np.sort(keep)))

    def run(batches):
        for b in batches:
            out = []
            for row, text in enumerate(b.column(1)):
                v = words_of(text.as_py())
                for i, (m, n) in enumerate(masks):
                    if whole and n != (len(v) if len(v) < LEAST else 0):
                        continue
                    h = masked(v, m)
                    at = np.arange(len(h))
                    if keep is not None and len(h):
                        bits, every = shared.value
                        at = np.flatnonzero(bits[(h & U64((1 << 22) - 1)).astype(np.int64)])
                        at = at[every[np.minimum(np.searchsorted(every, h[at]), len(every) - 1)] == h[at]]
                        h = h[at]
                    if len(h):
                        out.append((np.full(len(h), i, np.int32), h, np.full(len(h), row), at.astype(np.int32)))
            if out:
                m, h, k, p = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(signed(h)), b.column(0).take(pa.array(k)), pa.array(p)], ["mask", "hash", "key", "pos"])

    return rows.mapInArrow(run, f"mask int, hash long, key {rows.dtypes[0][1]}, pos int")


def overlap(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Of item ``b`` laid on ``a`` from word ``diagonal`` on: length, first word in ``a`` and equal words of the best stretch."""
    lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
    if hi <= lo:
        return 0, 0, 0
    same = np.concatenate([[0], np.cumsum(a[lo + diagonal : hi + diagonal] == b[lo:hi])])
    score = same - AGREE * np.arange(len(same)) + 1e-9
    # the last end that still agrees enough, for each start that is lower than all before it
    best = (0, 0, 0)
    high = np.maximum.accumulate(score[::-1])[::-1]
    for i in np.flatnonzero(score < np.minimum.accumulate(np.concatenate([[np.inf], score[:-1]]))).tolist():
        j = int(np.searchsorted(-high, -(score[i] - 1e-9), side="right")) - 1
        if j - i > best[0]:
            best = (j - i, i + lo + diagonal, int(same[j] - same[i]))
    return best


def _longest(same: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``same`` (whether words are equal) the length of the longest stretch within ``lo`` to ``hi`` that agrees enough, and the rows' scores before each word.

    A stretch agrees if its score doesn't fall; starts that are lowest so far and ends that are highest from there on are
    walked along together, for all rows at once.
    """
    n, width = same.shape
    score = np.concatenate([np.zeros((n, 1)), np.cumsum(same - AGREE, 1)], 1)
    place = np.arange(width + 1)
    low = np.minimum.accumulate(np.where(place < lo[:, None], np.inf, score), 1)
    high = np.maximum.accumulate(np.where(place > hi[:, None], -np.inf, score)[:, ::-1], 1)[:, ::-1]
    rows, i, j, best = np.arange(n), lo.copy(), lo.copy(), np.zeros(n, np.int64)
    while len(rows):
        more = high[rows, j[rows]] >= low[rows, i[rows]] - 1e-9
        best[rows] = np.where(more, np.maximum(best[rows], j[rows] - i[rows]), best[rows])
        j[rows] += more
        i[rows] += ~more
        rows = rows[(j[rows] <= hi[rows]) & (i[rows] <= hi[rows])]
    return best, score


def best_overlap(v: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    """Length, equal words and first word (negative) of the longest stretch over the ascending ``diagonals``; zeros if none is a leak."""
    size, best = len(item), (0, 0, 0)
    least = min(LEAST, size)
    padded = np.concatenate([np.zeros(size, U64), v, np.zeros(size, U64)])
    step = max(1, CELLS // size)
    for a in range(0, len(diagonals), step):
        part = diagonals[a : a + step]
        part = part[(part > -size) & (part < len(v))]
        same = padded[part[:, None] + size + np.arange(size)] == item
        equal = same.sum(1)
        # enough equal words for a leak, and for one that is no shorter than the best so far
        open_ = (equal >= AGREE * least - 1e-9) & (equal >= AGREE * best[0] - 1e-9)
        part, same = part[open_], same[open_]
        if len(part) < FEW:
            for d in part.tolist():
                n, start, equal_ = overlap(v, item, d)
                if n >= least:
                    best = max(best, (n, equal_, -start))
                if best[:2] == (size, size):  # nothing further on is better
                    return best
            continue
        lo, hi = np.maximum(0, -part), np.minimum(size, len(v) - part)
        length, score = _longest(same, lo, hi)
        n = int(length.max())
        if n < max(least, best[0]):
            continue
        at = np.flatnonzero(length == n)
        place = np.arange(size + 1 - n)
        fits = (score[at, n:] >= score[at, : size + 1 - n] - 1e-9) & (place >= lo[at, None]) & (place + n <= hi[at, None])
        first = fits.argmax(1)
        count = np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(same[at], 1)], 1)
        equal = count[np.arange(len(at)), first + n] - count[np.arange(len(at)), first]
        best = max(best, *((n, e, -s) for e, s in zip(equal.tolist(), (first + part[at]).tolist(), strict=True)))
        if best[:2] == (size, size):
            return best
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id_col, item_id, start, length, equal)``: each document and item that overlap, with the best stretch."""
    items = cut(benchmark.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "items")

    def counted(batches):
        for b in batches:
            v = [words_of(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("item_id"), pa.array([len(x) for x in v], pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], ["key", "item_id", "n", "words"])

    name = items.schema["item_id"].dataType.simpleString()
    coded = cut(items.mapInArrow(counted, f"key long, item_id {name}, n int, words binary").where("n > 0"), "items")
    short = [r["n"] for r in coded.where(F.col("n") < LEAST).select("n").distinct().collect()]  # under LEAST numbers
    masks = _masks(short)
    index = cut(_seeds(items.join(coded.select("key"), "key", "left_semi").select("key", "text"), masks, None, True), "seeds")
    keep = None
    if index.count() <= FILTER:
        keep = index.select("hash").distinct().toArrow().column("hash").to_numpy().astype(np.int64).view(U64)
    base = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    if keep is not None and not len(keep):
        keep = np.zeros(1, U64)
    hits = _seeds(base.select("row_key", "text"), masks, keep, False)
    pairs = hits.join(index.select("mask", "hash", F.col("key").alias("item"), F.col("pos").alias("own")), ["mask", "hash"])
    pairs = pairs.select(F.col("key").alias("row_key"), "item", (F.col("pos") - F.col("own")).alias("diagonal"))
    # at most one diagonal for each word of the text and the item
    pairs = pairs.groupBy("row_key", "item").agg(F.array_sort(F.collect_set("diagonal")).alias("diagonals"))
    pairs = pairs.join(coded.withColumnRenamed("key", "item"), "item")
    wanted = cut(pairs.groupBy("row_key").agg(F.collect_list(F.struct("item_id", "diagonals", "words")).alias("want")), "hits")

    def verified(batches):
        for b in batches:
            out = []
            for i, text, want in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
                v, best = words_of(text), {}
                for w in want:
                    found = best_overlap(v, np.frombuffer(w["words"], U64), np.array(w["diagonals"]))
                    if found > best.get(w["item_id"], (0, 0, 0)):
                        best[w["item_id"]] = found
                out += [(i, item, -start, n, equal) for item, (n, equal, start) in best.items()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field("id").type, b.schema.field("want").type.value_type.field("item_id").type, pa.int32(), pa.int32(), pa.int32()), strict=True)], [id_col, "item_id", "start", "length", "equal"])

    kind = base.schema["id"].dataType.simpleString()
    return base.join(wanted.hint("shuffle_hash"), "row_key").select("id", "text", "want").mapInArrow(verified, f"`{id_col}` {kind}, item_id {name}, start int, length int, equal int")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
