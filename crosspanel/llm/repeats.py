"""Windows of symbols (words or bytes) that occur more than once in a corpus, found from winnowed anchors.

Every window of ``width`` symbols has an anchor: of its ``k``-grams the one with the least hash (the last of
equal ones).  Equal windows have equal anchors at equal places, so

1. anchors that occur once in the corpus are left out;
2. a *segment* is the stretch of windows that share one anchor; equal segments (equal anchors and equal hash of
   all their symbols, 128 bits together) repeat as a whole, and stand for one *context* from here on;
3. the different contexts of an anchor, where one of them is alone, go to one task, which finds the windows that
   two of them share (``resolve``: how that is done is the operator's own method);
4. contexts of an anchor with over ``crowd`` of them are halved: windows that begin well before the anchor, and the
   others; all windows of a half have a longer stretch in common, which is its anchor from here on.  Halves go through
   2 and 3 again, until no anchor is crowded or a half is one window.  A half that no other meets ends there, so no
   window becomes a row unless it repeats all but in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import BASE, U64, Rolling, cut, mix, signed


@dataclass(frozen=True)
class Kind:
    """What a repeat is made of."""

    width: int  # symbols of a window
    k: int  # symbols of an anchor
    values: Callable[[bytes], np.ndarray]  # a text's symbols as 64-bit values
    payload: Callable[[bytes, np.ndarray, int, int], bytes]  # (text, values, from, to): what resolve() gets of a context, as many bytes for each symbol
    resolve: Callable[[list[bytes], list[int], int], list[list[tuple[int, int]]]]  # contexts, anchors' offsets, symbols of an anchor -> runs of repeated windows in each
    crowd: int  # different contexts of an anchor that may meet in one task


def segments(v: np.ndarray, width: int, k: int):
    """First windows, numbers of windows, anchor positions, anchor hashes and segment hashes of a sequence."""
    none = np.zeros(0, np.int64)
    if len(v) < width:
        return none, none, none, none.astype(U64), none.astype(U64)
    roll = Rolling(v)
    g = roll.every(k)
    span, windows = width - k + 1, len(v) - width + 1
    order = (g & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(len(g), dtype=U64))
    padded = np.concatenate([order, np.full(-len(g) % span, U64(2**64 - 1))]).reshape(-1, span)
    head = np.minimum.accumulate(padded, 1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(tail[:windows], head[span - 1 : span - 1 + windows])
    at = (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], windows)
    at = at[first]
    return first, last - first, at, g[at], roll.of(first, last - 1 + width)


def row_key(*columns: str | F.Column) -> F.Column:
    """16 bytes that stand for the values of ``columns``: two hashes of 64 bits, which are equal for equal rows only."""
    two = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))]
    return F.unhex(F.concat(*two))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``row_key``, which stands for a row's id and text: equal rows share it and fare alike."""
    return docs.withColumn("row_key", row_key(F.col(id_col), F.col(text_col)))


def _found(docs: DataFrame, text_col: str, kind: Kind, whole: bool) -> DataFrame:
    """A row for each different segment of a text, ``s`` being its places; or just anchors and how often the text has them."""
    names = ["anchor", "seg", "row_key", "s", "m"] if whole else ["anchor", "n"]

    def run(batches):
        for b in batches:
            out, places = [], []
            for row, text in enumerate(b.column(1)):
                s, m, _, a, seg = segments(kind.values((text.as_py() or "").encode("utf-8", "surrogatepass")), kind.width, kind.k)
                if len(s) and whole:
                    turn = np.lexsort((s, a, seg))
                    a, seg = a[turn], seg[turn]
                    first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (a[1:] != a[:-1])]))
                    places.append(s[turn])
                    out.append((a[first], seg[first], np.full(len(first), row), np.diff(np.append(first, len(s))), m[turn[first]]))
                elif len(s):
                    out.append(np.unique(a, return_counts=True))
            if not out:
                continue
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            if whole:
                at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(cols[0])), pa.array(signed(cols[1])), b.column(0).take(pa.array(cols[2])), at, pa.array(cols[4].astype(np.int32))], names)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(signed(cols[0])), pa.array(cols[1])], names)

    return docs.select("row_key", text_col).mapInArrow(run, "anchor long, seg long, row_key binary, s array<int>, m int" if whole else "anchor long, n long")


def repeated_windows(docs: DataFrame, kind: Kind, text_col: str = "text") -> DataFrame:
    """``(row_key, spans array<struct<lo array<int>, n int>>)`` for rows that have repeated windows: the ``n`` windows from each of ``lo`` on.

    ``docs`` is the result of ``keyed``.
    """
    # written, so that the join below has plain exchanges on both sides and Spark can split an anchor that is everywhere
    shared = cut(_found(docs, text_col, kind, False).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "repeated")
    rows = cut(_found(docs, text_col, kind, True).join(shared, "anchor", "left_semi"), "anchors")
    pairs = cut(rows.groupBy("anchor", "seg").agg(F.sum(F.size("s")).alias("n"), F.min(F.struct("row_key", F.col("s")[0].alias("s"), "m")).alias("rep")), "contexts")
    full = rows.join(pairs.where("n > 1").select("anchor", "seg"), ["anchor", "seg"]).select("row_key", F.col("s").alias("lo"), F.col("m").alias("n"))
    open_ = pairs.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1 and kinds > 1")
    wanted = pairs.join(open_.select("anchor", "kinds"), "anchor").select("anchor", "kinds", (F.col("n") == 1).alias("alone"), "rep.*")
    by_row = wanted.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "kinds", "alone", "s", "m")).alias("want"))
    # a repeated row gives its contexts twice; they are then not alone, and only those that are alone are resolved
    held = docs.select("row_key", text_col).join(by_row.hint("shuffle_hash"), "row_key")
    names = ["anchor", "kinds", "alone", "row_key", "s", "m", "at", "payload"]

    def contexts(batches):
        for b in batches:
            for key, text, want in zip(b.column("row_key").to_pylist(), b.column(text_col).to_pylist(), b.column("want").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                v = kind.values(raw)
                s, _, at, _, _ = segments(v, kind.width, kind.k)
                where = dict(zip(s.tolist(), at.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["anchor"] for w in want], pa.int64()),
                        pa.array([w["kinds"] for w in want], pa.int64()),
                        pa.array([w["alone"] for w in want], pa.bool_()),
                        pa.array([key] * len(want), pa.binary()),
                        pa.array([w["s"] for w in want], pa.int32()),
                        pa.array([w["m"] for w in want], pa.int32()),
                        pa.array([where[w["s"]] - w["s"] for w in want], pa.int32()),
                        pa.array([kind.payload(raw, v, w["s"], w["s"] + w["m"] - 1 + kind.width) for w in want], pa.binary()),
                    ],
                    names,
                )

    spread = cut(held.mapInArrow(contexts, "anchor long, kinds long, alone boolean, row_key binary, s int, m int, at int, payload binary"), "extended")

    found, k = [full], kind.k
    while True:
        found.append(_resolved(spread.where(F.col("kinds") <= kind.crowd), kind, k))
        crowded = spread.where(F.col("kinds") > kind.crowd)
        if crowded.isEmpty():
            break
        halves, k = _halves(crowded, kind.width, k)
        spread, whole = _open(cut(halves, "halves"))
        found.append(whole)
    return reduce(DataFrame.union, found).groupBy("row_key").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def _resolved(few: DataFrame, kind: Kind, k: int) -> DataFrame:
    """``(row_key, lo array<int>, n)``: the windows that the contexts of an anchor of ``k`` symbols share; they meet in one task."""

    def run(batches):
        now, held = None, []

        def done():
            spans = kind.resolve([x[4] for x in held], [x[3] for x in held], k)
            return [(x[1], x[2] + lo, x[2] + hi) for x, found in zip(held, spans, strict=True) if x[0] for lo, hi in found]

        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "alone", "row_key", "s", "at", "payload")), strict=True):
                if row[0] != now and held:
                    out += done()
                    held = []
                now = row[0]
                held.append(row[1:])
            yield from _span_batches(out)
        if held:
            yield from _span_batches(done())

    spans = few.repartition("anchor").sortWithinPartitions("anchor", "row_key", "s").mapInArrow(run, "row_key binary, lo int, hi int")
    return spans.select("row_key", F.array("lo").alias("lo"), (F.col("hi") - F.col("lo")).alias("n"))


def _halves(crowded: DataFrame, width: int, k: int) -> tuple[DataFrame, int]:
    """Each context as two, and the symbols of their anchors: windows with half of what an anchor leaves open before it, or else behind it."""
    more = (width - k + 1) // 2
    names = ["anchor", "seg", "alone", "row_key", "s", "m", "at", "payload"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            anchor, s, m, at = (b.column(c).to_numpy().astype(np.int64) for c in ("anchor", "s", "m", "at"))
            size = m - 1 + width
            texts = b.column("payload").to_pylist()
            unit = len(texts[0]) // int(size[0])
            roll = Rolling(mix(np.frombuffer(b"".join(texts), f"<u{unit}").astype(U64) + U64(BASE)))
            start = np.cumsum(size) - size
            for side, lo, hi in ((0, np.zeros_like(m), np.minimum(at - more + 1, m)), (1, np.maximum(at - more + 1, 0), m)):
                i = np.flatnonzero(lo < hi)
                lo, hi = lo[i], hi[i]
                core = start[i] + at[i] - (0 if side else more)
                hashes = mix(roll.of(core, core + k + more) + mix(anchor[i].view(U64)) + U64(side))
                seg = roll.of(start[i] + lo, start[i] + hi - 1 + width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(hashes)),
                        pa.array(signed(seg)),
                        b.column("alone").take(pa.array(i)),
                        b.column("row_key").take(pa.array(i)),
                        pa.array((s[i] + lo).astype(np.int32)),
                        pa.array((hi - lo).astype(np.int32)),
                        pa.array((core - start[i] - lo).astype(np.int32)),
                        pa.array([texts[x][unit * p : unit * q] for x, p, q in zip(i.tolist(), lo.tolist(), (hi - 1 + width).tolist(), strict=True)], pa.binary()),
                    ],
                    names,
                )

    return crowded.mapInArrow(run, "anchor long, seg long, alone boolean, row_key binary, s int, m int, at int, payload binary"), k + more


def _open(halves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different contexts of anchors that are still open, and the windows of those that repeat as a whole; ``halves`` is a written table."""
    n = F.sum(F.when(F.col("alone"), 1).otherwise(2))  # one that isn't alone stands for more
    pairs = cut(halves.groupBy("anchor", "seg").agg(n.alias("n"), F.min(F.struct("row_key", "s")).alias("rep")), "pairs")
    whole = halves.where("alone").join(pairs.where("n > 1").select("anchor", "seg"), ["anchor", "seg"]).select("row_key", F.array("s").alias("lo"), F.col("m").alias("n"))
    open_ = pairs.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1 and kinds > 1")
    wanted = pairs.join(open_.select("anchor", "kinds"), "anchor").select("anchor", "seg", "kinds", (F.col("n") == 1).alias("alone"), "rep.*")
    spread = halves.drop("alone").join(wanted, ["anchor", "seg", "row_key", "s"]).select("anchor", "kinds", "alone", "row_key", "s", "m", "at", "payload")
    return cut(spread, "extended"), whole


def _span_batches(found: list):
    if found:
        key, lo, hi = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["row_key", "lo", "hi"])


def covered(spans: list | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of symbols that windows starting in ``spans`` cover."""
    none = np.zeros(0, np.int64)
    if not spans:
        return none, none
    lo = np.concatenate([np.asarray(x["lo"], np.int64) for x in spans])
    size = np.repeat([x["n"] for x in spans], [len(x["lo"]) for x in spans])
    a = np.stack([lo, lo + size - 1 + width], 1)
    a = a[np.argsort(lo, kind="stable")]
    top = np.maximum.accumulate(a[:, 1])
    first = np.flatnonzero(np.concatenate([[True], a[1:, 0] > top[:-1]]))
    return a[first, 0], top[np.append(first[1:], len(a)) - 1]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))



def stripped(docs: DataFrame, kind: Kind, take: Callable, fields: str, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``) and what ``take(raw, starts, ends)`` makes of each text and its removed stretches.

    ``fields`` is the schema of ``take``'s tuples.
    """
    base = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    spans = repeated_windows(base, kind)
    joined = base.select("row_key", "row", "text").join(spans.hint("shuffle_hash"), "row_key", "left").select("row", "text", "spans")
    names = ["row", *[x.strip().split(" ")[0] for x in fields.split(",")]]

    def run(batches):
        for b in batches:
            made = [take((t or "").encode("utf-8", "surrogatepass"), *covered(s, kind.width)) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(x) for x in zip(*made, strict=True)]], names)

    return joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, {fields}")
