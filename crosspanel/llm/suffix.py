"""Operator 2: suffix-array dedup of bytes.

Windows of 200 bytes that may repeat are gathered by their anchors (``repeats.py``).  The contexts of an anchor
agree on a common core around it, which becomes one symbol; what differs to its left and right is written behind
one another, and a suffix array of that shows which windows are equal: equal windows begin suffixes that are
neighbours.  The array is built by linear grouping construction: suffixes are grouped by their Lyndon prefixes,
from the highest group to the lowest, by pointers to the previous smaller suffix, and each group's order is then
emitted from the order of what follows, without renaming and recursion.

Null and empty texts have no bytes; texts under ``WIDTH`` bytes lose nothing; equal rows are documents of their
own and so repeats of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import BASE, U64, mix, texts
from crosspanel.llm.repeats import Kind, stripped

WIDTH, ANCHOR = 200, 50
#: Different contexts of an anchor whose suffixes one task sorts: up to 350 bytes each.
CROWD = 1000
#: Values that UTF-8 never uses.
CORE, END = 0xFE, 0xFF

_VALUES = mix(mix(np.arange(1, 257, dtype=U64) * U64(BASE)))


def lyndon_groups(s: bytes) -> tuple[list[list[int]], list[int]]:
    """Suffixes by Lyndon prefix, highest group first, and each suffix's previous smaller one (-1: none)."""
    n = len(s)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    number = {c: g for g, c in enumerate(sorted(by_symbol))}
    group = [number[c] for c in s]
    below = list(range(-1, len(members) - 1))  # the groups are a list from which groups split off upwards
    above = [*range(1, len(members)), -1]
    link = list(range(n))  # of a suffix that is done: leftwards, to one that may not be
    previous = [-1] * n
    order = []
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            order.append(own)
            for i in own:
                link[i] = i - 1
            seen: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and link[j] != j:
                    up = link[j]
                    if up >= 0:
                        link[j] = link[up]
                    j = up
                previous[i] = j
                if j >= 0:
                    seen[j] = seen.get(j, 0) + 1
            if seen:
                by_count: dict[int, list[int]] = {}
                for j, count in seen.items():
                    by_count.setdefault(count, []).append(j)
                for count in sorted(by_count, reverse=True):
                    new: dict[int, int] = {}
                    for j in by_count[count]:
                        old = group[j]
                        h = new.get(old)
                        if h is None:
                            h = new[old] = len(members)
                            members.append([])
                            below.append(old)
                            above.append(above[old])
                            below[above[old]] = h
                            above[old] = h
                        group[j] = h
                        members[h].append(j)
        g = below[g]
    return order, previous


def suffix_array(s: bytes) -> list[int]:
    """First positions of the suffixes of ``s`` in lexicographic order; a shorter one comes before its extensions."""
    order, previous = lyndon_groups(s)
    n = len(s)
    free, at, position = [0] * n, [0] * n, 1
    for k, own in enumerate(reversed(order)):
        free[k] = position
        position += len(own)
        for i in own:
            at[i] = k
    sa, placed = [n] + [0] * n, [False] * n
    for i in range(n + 1):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            k = at[j]
            sa[free[k]] = j
            free[k] += 1
            placed[j] = True
            j = previous[j]
    return sa[1:]


def _prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def equal_windows(contexts: list[bytes], at: list[int], width: int, k: int) -> list[list[tuple[int, int]]]:
    """For each context the runs of first bytes of windows that another one shares; anchors are at ``at``."""
    lefts = [c[:a][::-1] for c, a in zip(contexts, at, strict=True)]
    rights = [c[a + k :] for c, a in zip(contexts, at, strict=True)]
    before, after = _prefix(min(lefts), max(lefts)), _prefix(min(rights), max(rights))
    core = before + k + after
    found: list[list[tuple[int, int]]] = []
    reach = [0] * len(contexts)  # bytes after the core that another context shares
    extra: list[list[int]] = [[] for _ in contexts]  # windows that begin before the core
    if len(contexts) > 2:  # two contexts share their core and no more
        s, start, heart = b"", [], []
        for a, b in zip(lefts, rights, strict=True):
            start.append(len(s))
            heart.append(len(s) + len(a) - before)
            s += a[before:][::-1] + bytes([CORE]) + b[after:] + bytes([END])
        sa = suffix_array(s)
        owner = np.repeat(np.arange(len(start)), np.diff([*start, len(s)])).tolist()
        last = None
        for i in sa:
            x = owner[i]
            ahead = heart[x] - i
            if ahead < 0:
                continue
            if ahead:  # symbols of the window that begins here: some before the core, and what is needed after it
                need = ahead + 1 + max(0, width - ahead - core)
                if i + need >= (start[x + 1] if x + 1 < len(start) else len(s)) or ahead > width - k:
                    continue
                window = s[i : i + need]
                if last is not None and last[0] == window:
                    extra[x].append(i - start[x])
                    if not last[3]:
                        extra[last[1]].append(last[2])
                    last = (window, x, i - start[x], True)
                else:
                    last = (window, x, i - start[x], False)
        hearts = [i for i in sa if heart[owner[i]] == i]
        for p, q in zip(hearts, hearts[1:], strict=False):
            x, y = owner[p], owner[q]
            same = _prefix(rights[x][after:], rights[y][after:])
            reach[x], reach[y] = max(reach[x], same), max(reach[y], same)
    for x, c in enumerate(contexts):
        windows = len(c) - width + 1
        lo = at[x] - before
        hi = min(windows, lo + core + reach[x] - width + 1, at[x] + 1)
        spans = [(p, p + 1) for p in sorted(extra[x]) if p < windows]
        if lo < hi:
            spans.append((lo, hi))
        found.append(spans)
    return found


def kind(width: int = WIDTH, k: int = ANCHOR) -> Kind:
    return Kind(width, k, lambda raw: _VALUES[np.frombuffer(raw, np.uint8)], lambda raw, v, a, b: raw[a:b], lambda c, at, k: equal_windows(c, at, width, k), CROWD)


def _take(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    if not len(starts):
        return len(raw), 0, 0, raw
    from_, to = [0, *ends.tolist()], [*starts.tolist(), len(raw)]
    kept = b"".join([raw[a:b] for a, b in zip(from_, to, strict=True)])
    return len(raw), len(raw) - len(kept), len(starts), kept


def repeats_removed(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left."""
    return stripped(docs, kind(width, k), _take, "n_bytes long, n_removed long, n_spans long, kept binary", id_col, text_col)


def op2_suffix(spark, sf_dir: str) -> DataFrame:
    found = repeats_removed(texts(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
