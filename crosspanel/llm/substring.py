"""Operator 7: substring dedup by seed and extend.

Documents are joined on winnowed word anchors (``repeats.py``); in each group of contexts that share an anchor
the match is extended to the left and to the right, and what is at least ``WIDTH`` words long is a repeat.
Few contexts are extended pair by pair; more of them class by class (contexts that agree on d words to the left
and on the rest to the right), so that the work stays linear in their number.

Null and empty texts have no words; texts under ``WIDTH`` words lose nothing; equal rows are documents of their
own and so repeats of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import U64, texts, word_hashes
from crosspanel.llm.repeats import Kind, runs, stripped

WIDTH, ANCHOR, PAIRS = 35, 8, 6
#: Different contexts of an anchor that are extended in one task: about 60 words of 8 bytes each, so some 10 MB.
CROWD = 20_000


def _same(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def extend(contexts: list[bytes], at: list[int], width: int, k: int) -> list[list[tuple[int, int]]]:
    """For each context the runs of first words of windows that another context shares; anchors are at ``at``."""
    c = [np.frombuffer(x, "<u8") for x in contexts]
    flags = [np.zeros(max(0, len(x) - width + 1), bool) for x in c]
    if len(c) <= PAIRS:
        for i in range(len(c)):
            for j in range(i):
                left = _same(c[i][: at[i]][::-1], c[j][: at[j]][::-1])
                right = _same(c[i][at[i] + k :], c[j][at[j] + k :])
                if left + k + right >= width:  # a maximal repeat: its windows start up to `left` words before the anchor
                    for x in (i, j):
                        flags[x][max(0, at[x] - left) : at[x] + k + right - width + 1] = True
        return [runs(f) for f in flags]
    room = width - k

    def classes(parts: list[np.ndarray]) -> np.ndarray:
        """classes[d][i]: contexts of one number agree on their first d words; 0 is for those that are too short."""
        out = np.zeros((room + 1, len(parts)), np.int64)
        out[0] = 1
        words = np.zeros((room, len(parts)), U64)
        lens = np.array([min(len(p), room) for p in parts])
        for i, p in enumerate(parts):
            words[: lens[i], i] = p[: lens[i]]
        for d in range(1, room + 1):
            ok = np.flatnonzero(lens >= d)
            if not len(ok):
                break
            _, number = np.unique(words[d - 1, ok], return_inverse=True)
            _, number = np.unique(out[d - 1, ok] * (len(ok) + 1) + number, return_inverse=True)
            out[d, ok] = number + 1
        return out

    left = classes([x[:a][::-1] for x, a in zip(c, at, strict=True)])
    right = classes([x[a + k :] for x, a in zip(c, at, strict=True)])
    for d in range(room + 1):
        ok = np.flatnonzero((left[d] > 0) & (right[room - d] > 0))
        if len(ok) > 1:
            _, number, n = np.unique(left[d, ok] * (len(c) + 2) + right[room - d, ok], return_inverse=True, return_counts=True)
            for i in ok[n[number] > 1].tolist():
                if 0 <= at[i] - d < len(flags[i]):
                    flags[i][at[i] - d] = True
    return [runs(f) for f in flags]


def kind(width: int = WIDTH, k: int = ANCHOR) -> Kind:
    return Kind(width, k, lambda raw: word_hashes(raw)[2], lambda raw, v, a, b: v[a:b].tobytes(), lambda c, at, k: extend(c, at, width, k), CROWD)


def _take(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    words = raw.split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    keep = np.cumsum(gone)[: len(words)] == 0
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if len(starts) else words
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")


def repeats_removed(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_words``, ``n_removed`` and ``kept``, the words left with one space between."""
    return stripped(docs, kind(width, k), _take, "n_words long, n_removed long, kept string", id_col, text_col)


def op7_substring(spark, sf_dir: str) -> DataFrame:
    found = repeats_removed(texts(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
