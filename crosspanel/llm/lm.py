"""Operator 8: language-model scores from an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting:

* ``p(w | v) = max(c(v,w) - D, 0) / c(v) + D * T(v) / c(v) * p(w)``, T being the number of distinct successors;
* ``p(w) = (c(w) - D) / N`` for known words, and what the discount frees goes to the unknown word, ``D * V / N``.

Both sum to one over the known words, the end and the unknown word.  Its n-grams are dealt by context to shards,
and each shard is one trie: contexts, monotone pointers into the level below, and their successors with the
discounted probability in 8 bits.  All sequences are Elias-Fano coded, in one memory map of the task, and are read
and searched in that form.  A successor is searched relative to its context, within the range that the pointers give.

A block is some megabytes of text that one task has read in a row; it sends each distinct pair of words once, with
its count in training texts, and gets back the probability of each.  A context with more than ``2 / shards`` of all
words is split over several shards by its successors, each of which has a part of the context's count, so no
context and no word weighs on one task.  Higher orders would send another context and successor for nearly each
word (long contexts hardly repeat), more than the input itself, so two levels are kept.

Null and empty texts consist of the end alone; rows of null id learn and are scored like others; repeated rows count
as often as they occur; without any training text every score is that of the base model; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import U64, cut, remainder, signed, text_bytes, texts, word_hashes
from crosspanel.llm.blocks import pack, planes, unpack, unplane

DISCOUNT = 0.8
#: Characters that end a block.
BLOCK_CHARS = 6 << 20
#: Bytes of text whose words' pairs make up a shard at most (more shuffle partitions make smaller shards).
SHARD_BYTES = 64 << 20
#: Bits of a word's hash by which it is known among the successors of a context; the end has the highest value.
BITS = 40
END = (1 << BITS) - 1


#: Bits of a block of the high bits; ones are counted up to each block.
DIRECTORY = 512
_ONES = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """An ascending sequence of unsigned numbers: low bits as they are, high bits as counts in unary.

    ``data`` is one buffer of bytes: a header of 4 words, the low bits, the high bits, and the ones before each block
    of high bits.  All of it stays as it is: numbers are read and searched in the coded form.
    """

    def __init__(self, data: np.ndarray):
        self.n, self.low, self.buckets, at = (int(x) for x in data[:32].view("<u8"))
        blocks = -(-(self.n + self.buckets) // DIRECTORY)
        self.lows = data[32:at]
        self.highs = data[at : at + blocks * DIRECTORY // 8].view("<u8").reshape(-1, DIRECTORY // 64)
        self.before = data[at + blocks * DIRECTORY // 8 : at + blocks * (DIRECTORY // 8 + 8)].view("<u8").astype(np.int64, copy=False)

    @staticmethod
    def build(values: np.ndarray) -> np.ndarray:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        high = (values >> U64(low)).astype(np.int64)
        buckets = int(high[-1]) + 1 if n else 0
        packed = []
        for a in range(0, n if low else 0, 1 << 16):  # a multiple of 8, so that each piece ends with a byte
            bits = (values[a : a + (1 << 16), None] >> np.arange(low, dtype=U64)[None]) & U64(1)
            packed.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        lows = np.concatenate([*packed, np.zeros(8, np.uint8)])
        lows = np.append(lows, np.zeros(-len(lows) % 8, np.uint8))
        unary = np.zeros(-(-(n + buckets) // DIRECTORY) * DIRECTORY, np.uint8)
        unary[high + np.arange(n)] = 1
        ones = unary.reshape(-1, DIRECTORY).sum(1, dtype=np.int64)
        head = np.array([n, low, buckets, 32 + len(lows)], "<u8").view(np.uint8)
        return np.concatenate([head, lows, np.packbits(unary, bitorder="little"), (np.cumsum(ones) - ones).astype("<u8").view(np.uint8)])

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        at, out = bit >> 3, np.zeros(len(i), U64)
        for k in range((self.low + 14) // 8):
            out |= self.lows[at + k].astype(U64) << U64(8 * k)
        return (out >> (bit & 7).astype(U64)) & U64((1 << self.low) - 1)

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the ``k``-th ones (or zeros) of the high bits, from 0 on."""
        before = self.before if ones else np.arange(len(self.before)) * DIRECTORY - self.before
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 16):
            rest = k[a : a + (1 << 16)]
            row = np.arange(len(rest))
            at = np.searchsorted(before, rest, side="right") - 1
            rest = rest - before[at]
            words = self.highs[at] if ones else ~self.highs[at]
            for _ in range(2):  # the word in the block, then the byte in the word
                count = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
                own = (count <= rest[:, None]).sum(1)
                rest = rest - np.where(own > 0, count[row, np.maximum(own - 1, 0)], 0)
                at, one = at * words.shape[1] + own, words[row, own]
                words = one.view(np.uint8).reshape(-1, 8) if one.itemsize > 1 else one
            out[a : a + (1 << 16)] = at * 8 + _ONES[one, rest]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at ``i``."""
        high = (self.select(i, True) - i).astype(U64)
        return (high << U64(self.low)) | self.low_bits(i)

    def gaps(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at ``i`` and what is added to them at ``i + 1``."""
        at = self.get(i).astype(np.int64)
        return at, self.get(i + 1).astype(np.int64) - at

    def start(self, bucket: np.ndarray) -> np.ndarray:
        """Position of the first number of each bucket of equal high bits."""
        out = np.zeros(len(bucket), np.int64)
        some = np.flatnonzero(bucket > 0)
        out[some] = self.select(bucket[some] - 1, False) - (bucket[some] - 1)
        return out

    def find(self, q: np.ndarray, begin: np.ndarray | int = 0, stop: np.ndarray | int | None = None) -> np.ndarray:
        """Position of each of ``q`` within ``begin`` to ``stop``, -1 if it isn't there."""
        high = np.minimum(q >> U64(self.low), U64(self.buckets)).astype(np.int64)
        lo = np.maximum(self.start(high), begin)
        end = np.minimum(self.start(np.minimum(high + 1, self.buckets)), self.n if stop is None else stop)
        hi, want = end.copy(), q & U64((1 << self.low) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            below = self.low_bits(mid) < want[todo]
            lo[todo[below]] = mid[below] + 1
            hi[todo[~below]] = mid[~below]
            todo = todo[lo[todo] < hi[todo]]
        found = np.full(len(q), -1)
        maybe = np.flatnonzero(lo < end)
        same = self.low_bits(lo[maybe]) == want[maybe]
        found[maybe[same]] = lo[maybe[same]]
        return found


class Trie:
    """Contexts and their successors in levels of one memory map, searched as they are.

    Counts of contexts are kept as their running sums, which ascend like pointers.
    """

    def __init__(self, data: bytes | mmap.mmap):
        a = np.frombuffer(data, np.uint8)
        ends = a[:40].view("<u8").astype(np.int64).tolist()
        self.floor = float(a[40:48].view("<f8")[0])
        part = [a[x:y] for x, y in zip([48, *ends], ends, strict=False)]
        self.contexts, self.pointers, self.sums, self.successors = (EliasFano(p) for p in part[:4])
        self.code = part[4]

    @staticmethod
    def build(contexts: np.ndarray, key: np.ndarray, count: np.ndarray, discount: float = DISCOUNT) -> mmap.mmap:
        """Of ascending contexts, and keys (context's place in the upper bits, successor in the ``BITS`` lower ones) with counts.

        The map is anonymous: it belongs to the task and goes with it.
        """
        of = (key >> U64(BITS)).astype(np.int64)
        total = np.bincount(of, count, len(contexts)).astype(np.int64)
        kinds = np.bincount(of, minlength=len(contexts))
        p = np.log10(np.maximum(count - discount, 1e-9) / np.maximum(total[of], 1))
        floor = min(float(p.min()) if len(p) else -1.0, -1e-6)
        code = (1 + np.rint(254 * (1 - p / floor))).astype(np.uint8)  # 1: floor, 255: certain
        parts = [EliasFano.build(x) for x in (contexts, *(np.concatenate([[0], np.cumsum(n)]).astype(U64) for n in (kinds, total)), key)] + [code]
        at = 48 + np.cumsum([0, *(len(x) + -len(x) % 8 for x in parts)])
        out = mmap.mmap(-1, int(at[-1]))
        out[:48] = at[1:].astype("<u8").tobytes() + np.array([floor], "<f8").tobytes()
        for a, x in zip(at.tolist(), parts, strict=False):
            out[a : a + len(x)] = x.tobytes()
        return out

    def counts(self, node: np.ndarray) -> np.ndarray:
        """How often each context occurs in training texts."""
        return self.sums.gaps(node)[1]

    def ask(self, contexts: np.ndarray, of: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and number of successors of each context, and the code of each successor of ``contexts[of]`` (0: none)."""
        count, kinds, begin = (np.zeros(len(contexts), np.int64) for _ in range(3))
        code = np.zeros(len(successors), np.uint8)
        if not self.contexts.n:
            return count, kinds, code
        node = self.contexts.find(contexts)
        known = np.flatnonzero(node >= 0)
        begin[known], kinds[known] = self.pointers.gaps(node[known])
        count[known] = self.counts(node[known])
        for a in range(0, len(of), 1 << 18):
            part = of[a : a + (1 << 18)]
            ask = np.flatnonzero(kinds[part] > 0)
            own = part[ask]
            at = self.successors.find((node[own].astype(U64) << U64(BITS)) | successors[a + ask], begin[own], begin[own] + kinds[own])
            code[a + ask[at >= 0]] = self.code[at[at >= 0]]
        return count, kinds, code


@dataclass(frozen=True)
class Split:
    """Contexts that are split over several shards, ascending, and the number of parts of each."""

    shards: int
    words: np.ndarray
    parts: np.ndarray


def _short(h: np.ndarray) -> np.ndarray:
    return np.minimum(h >> U64(64 - BITS), U64(END - 1))


def _home(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a context: equal ranges of the hashes, so sorted contexts lie in the order of their shards."""
    return (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


class Block:
    """Texts as codes: places of their words among the block's sorted hashes."""

    def __init__(self, docs: list[tuple]):
        self.ids, self.held = [d[0] for d in docs], np.array([d[1] for d in docs], bool)
        self.n = np.array([len(d[2]) for d in docs], np.int64)
        every = np.concatenate([d[2] for d in docs]) if docs else np.zeros(0, U64)
        self.words, codes = np.unique(every, return_inverse=True)
        self.codes = codes.astype(np.int64)


def pair_keys(codes: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """Each word with its successor as one number; the end is word ``m``."""
    after = np.append(codes[1:], m)
    after[np.cumsum(n[n > 0]) - 1] = m
    return codes * (m + 1) + after


def _blocks(batches) -> Iterator[tuple[int, Block]]:
    part, number, size, held = TaskContext.get().partitionId(), 0, 0, []
    for b in batches:
        ids, text, flags = (b.column(k) for k in range(3))
        for i in range(b.num_rows):
            raw = text_bytes(text[i].as_py()).lower()
            held.append((ids[i].as_py(), flags[i].as_py(), word_hashes(raw)[2]))
            size += len(raw)
            if size >= BLOCK_CHARS:
                yield (part << 24) + number, Block(held)
                number, size, held = number + 1, 0, []
    if held:
        yield (part << 24) + number, Block(held)


def _squeeze(n: list[int], *columns: bytes) -> bytes:
    return np.array(n, "<i8").tobytes() + zstandard.compress(b"".join(columns), 1)


def _wide(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unwide(raw, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()


def _requests(block: Block, split: Split) -> Iterator[tuple[int, bytes]]:
    """What the block asks of each shard: contexts, their successors and their counts in training texts.

    Contexts that aren't split come first, in the order of their hashes; parts of split ones follow, with the codes
    of their successors, and each part is asked even if the block has no successor in it.
    """
    m = len(block.words)
    keys = pair_keys(block.codes, block.n, m)
    both, times = np.unique(keys * 2 + np.repeat(block.held, block.n), return_counts=True)
    pair = both >> 1
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.add.reduceat(np.where(both & 1, 0, times), first)
    pair = pair[first]
    v, w = pair // (m + 1), pair % (m + 1)
    short = np.append(_short(block.words), U64(END))
    place = np.minimum(np.searchsorted(split.words, block.words), max(0, len(split.words) - 1))
    hot = split.words[place] == block.words if len(split.words) else np.zeros(m, bool)
    home = _home(block.words, split.shards)
    plain = np.flatnonzero(~hot[v])
    kinds = np.bincount(v[plain], minlength=m)
    bounds = np.searchsorted(home, np.arange(split.shards + 1))
    ends = np.concatenate([[0], np.cumsum(kinds)])
    extra: dict[int, list] = {}
    for slot, c in enumerate(np.flatnonzero(hot).tolist()):
        parts, own = int(split.parts[place[c]]), np.flatnonzero(v == c)
        of = (short[w[own]] % U64(parts)).astype(np.int64)
        for p in range(parts):
            at = own[of == p]
            extra.setdefault((int(home[c]) + p) % split.shards, []).append((slot, block.words[c], short[w[at]], count[at], w[at]))
    for s in range(split.shards):
        a, b = bounds[s], bounds[s + 1]
        cold = np.arange(a, b)[~hot[a:b]]
        at = plain[ends[a] : ends[b]]
        more = extra.get(s, [])
        if not len(cold) and not more:
            continue
        words = np.concatenate([block.words[cold], np.array([x[1] for x in more], U64)])
        sizes = np.concatenate([kinds[cold], np.array([len(x[2]) for x in more], np.int64)])
        after = np.concatenate([short[w[at]], *[x[2] for x in more]])
        counts = np.concatenate([count[at], *[x[3] for x in more]])
        codes = np.concatenate([np.zeros(0, np.int64), *[x[4] for x in more]])
        slots = np.array([x[0] for x in more], np.int64)
        five = np.ascontiguousarray(after.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T).tobytes()
        yield s, _squeeze([len(words), len(more), len(after), len(codes)], _wide(words), planes(sizes), five, planes(counts), planes(slots), planes(codes))


def _open(raw: bytes):
    n, hot, pairs, codes = np.frombuffer(raw, "<i8", 4).tolist()
    data, at = zstandard.decompress(raw[32:]), 0
    words = _unwide(data, n)
    at = 8 * n
    sizes = unplane(memoryview(data)[at:], n, 1)[0].astype(np.int64)
    at += 4 * n
    eight = np.zeros((pairs, 8), np.uint8)
    eight[:, : BITS // 8] = np.frombuffer(data, np.uint8, BITS // 8 * pairs, at).reshape(-1, pairs).T
    at += BITS // 8 * pairs
    counts = unplane(memoryview(data)[at:], pairs, 1)[0].astype(np.int64)
    return words, sizes, eight.view("<u8").ravel(), counts, hot, data[at + 4 * pairs :], codes


def answered(requests: list[bytes], split: Split, discount: float) -> tuple[list[bytes], int, np.ndarray, np.ndarray]:
    """Builds a shard's trie from all requests and asks it for each of them.

    Also the number of contexts that occur in training texts, without those that are split, and the latter with their counts.
    """
    opened = [_open(r) for r in requests]
    words = np.concatenate([o[0] for o in opened])
    contexts, of = np.unique(words, return_inverse=True)
    if len(contexts) >= 1 << (64 - BITS):
        raise ValueError("a shard has too many contexts; use more shuffle partitions")
    sizes = np.concatenate([o[1] for o in opened])
    after, count = np.concatenate([o[2] for o in opened]), np.concatenate([o[3] for o in opened])
    # equal places of successors in a context's range: one key for each
    key = (np.repeat(of, sizes).astype(U64) << U64(BITS)) | after
    seen = np.flatnonzero(count)
    turn = seen[np.argsort(key[seen])]
    first = np.flatnonzero(np.concatenate([[True], key[turn[1:]] != key[turn[:-1]]])) if len(turn) else turn
    total = np.add.reduceat(count[turn], first) if len(turn) else count[turn]
    trie = Trie(Trie.build(contexts, key[turn[first]], total, discount))
    c, kinds, code = trie.ask(words, np.repeat(np.arange(len(words)), sizes), after)
    out, a, b = [], 0, 0
    for o in opened:
        n, pairs = len(o[0]), len(o[2])
        x, y = slice(a, a + n), slice(b, b + pairs)
        head = np.array([n, o[4], pairs, o[6]], "<i8").tobytes() + np.array([trie.floor], "<f8").tobytes()
        own = o[1][n - o[4] :]  # sizes of the parts of split contexts
        out.append(head + zstandard.compress(_wide(c[x]) + planes(kinds[x]) + planes(own) + o[5] + code[y].tobytes(), 1))
        a, b = a + n, b + pairs
    every = trie.counts(np.arange(len(contexts)))
    hot = np.isin(contexts, split.words)
    return out, int((every[~hot] > 0).sum()), contexts[hot], every[hot]


def _score(codes: np.ndarray, n: np.ndarray, m: int, hot: np.ndarray, replies: list[bytes], end: int, tokens: int, known: int, discount: float):
    """Base score, score and number of known tokens of each text of a block."""
    count, kinds = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    keys = pair_keys(codes, n, m)
    pair, at = np.unique(keys, return_inverse=True)
    v, w = pair // (m + 1), pair % (m + 1)
    is_hot = np.zeros(m + 1, bool)
    is_hot[hot] = True
    p = np.zeros(len(pair))  # discounted share, of the context's count, times that count
    plain_c, plain_k, plain_p = [], [], []
    for raw in replies:
        k, parts, pairs, coded = np.frombuffer(raw, "<i8", 4).tolist()
        floor = float(np.frombuffer(raw, "<f8", 1, 32)[0])
        data, o = zstandard.decompress(raw[40:]), 0
        c = _unwide(data, k).astype(np.int64)
        o = 8 * k
        t = unplane(memoryview(data)[o:], k, 1)[0].astype(np.int64)
        o += 4 * k
        sizes = unplane(memoryview(data)[o:], parts, 1)[0].astype(np.int64)
        o += 4 * parts
        slots = unplane(memoryview(data)[o:], parts, 1)[0].astype(np.int64)
        o += 4 * parts
        after = unplane(memoryview(data)[o:], coded, 1)[0].astype(np.int64)
        o += 4 * coded
        code = np.frombuffer(data, np.uint8, pairs, o)
        share = np.where(code > 0, 10.0 ** (floor * (255.0 - code) / 254.0), 0.0)
        plain_c.append(c[: k - parts])
        plain_k.append(t[: k - parts])
        plain_p.append(share[: pairs - coded])
        if parts:
            of = hot[slots]
            np.add.at(count, of, c[k - parts :])
            np.add.at(kinds, of, t[k - parts :])
            where = np.searchsorted(pair, np.repeat(of, sizes) * (m + 1) + after)
            p[where] = share[pairs - coded :] * np.repeat(c[k - parts :], sizes)
    cold = np.flatnonzero(~is_hot[:m])
    if sum(map(len, plain_c)) != len(cold):
        raise RuntimeError("a block has changed between two reads; write the input to a table first")
    if len(cold):
        count[cold], kinds[cold] = np.concatenate(plain_c), np.concatenate(plain_k)
        own = np.flatnonzero(~is_hot[v])
        p[own] = np.concatenate(plain_p) * count[v[own]]
    count[m] = end
    base = np.log10((count + 1) / (tokens + known + 1))
    one = np.where(count > 0, count - discount, discount * known) / max(tokens, 1) if tokens else np.full(m + 1, 1.0)
    c = count[v]
    two = np.log10(np.where(c > 0, (p + discount * kinds[v] * one[w]) / np.maximum(c, 1), one[w]))
    one = np.log10(one)
    ends = np.cumsum(n)
    first = np.full(len(n), m)
    full = np.flatnonzero(n)
    first[full] = codes[(ends - n)[full]]
    score, low, good = one[first], np.full(len(n), base[m]), np.full(len(n), int(end > 0))
    if len(full):
        starts = (ends - n)[full]
        score[full] += np.add.reduceat(two[at], starts)
        low[full] += np.add.reduceat(base[codes], starts)
        good[full] += np.add.reduceat((count[codes] > 0).astype(np.int64), starts)
    return low, score if tokens else low, good


def scored(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row; rows that aren't held out train.

    ``docs`` is read three times and has to give equal partitions each time, as a table does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def census(batches):
        for _, block in _blocks(batches):
            n = np.bincount(block.codes, minlength=len(block.words)) if len(block.words) else np.zeros(0, np.int64)
            often = np.flatnonzero(n * shards >= max(1, len(block.codes)))
            train = int(block.n[~block.held].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *signed(block.words[often]).tolist()], pa.int64()), pa.array([len(block.codes), *n[often].tolist()], pa.int64()), pa.array([train, *[0] * len(often)], pa.int64()), pa.array([int((~block.held).sum()), *[0] * len(often)], pa.int64())],
                ["word", "n", "train", "docs"],
            )

    counted = cut(rows.mapInArrow(census, "word long, n long, train long, docs long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"), F.sum("docs").alias("docs")), "census")
    total = counted.where("word is null").first()
    every, end = (total["n"], total["docs"]) if total else (0, 0)
    tokens = total["train"] + end if total else 0
    # at most shards / 2 words can have that share
    often = counted.where(F.col("word").isNotNull() & (F.col("n") * shards >= 2 * every)).select("word", "n").collect() if shards > 1 else []
    words = np.array([r["word"] for r in often], np.int64).view(U64)
    parts = np.array([min(shards, -(-r["n"] * shards // every)) for r in often], np.int64)
    turn = np.argsort(words)
    shared = spark.sparkContext.broadcast(Split(shards, words[turn], parts[turn]))

    def ask(batches):
        for number, block in _blocks(batches):
            if len(block.codes):
                made = list(_requests(block, shared.value))
                for a in range(0, len(made), 256):
                    part = made[a : a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array([s for s, _ in part], pa.int32()), pa.array([r for _, r in part], pa.binary())], ["block", "shard", "payload"])

    names = ["block", "word", "n", "payload"]

    def answer(batches):
        now, blocks, held = None, [], []

        def done():
            found, kinds, hot, n = answered(held, shared.value, discount)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.nulls(len(found), pa.int64()), pa.array([now] * len(found), pa.int64()), pa.array(found, pa.binary())], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1 + len(hot), pa.int64()), pa.array([None, *signed(hot).tolist()], pa.int64()), pa.array([kinds, *n.tolist()], pa.int64()), pa.nulls(1 + len(hot), pa.binary())], names)

        for b in batches:
            for block, shard, raw in zip(b.column("block").to_pylist(), b.column("shard").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if shard != now and held:
                    yield from done()
                    blocks, held = [], []
                now = shard
                blocks.append(block)
                held.append(raw)
        if held:
            yield from done()

    asked = rows.mapInArrow(ask, "block long, shard int, payload binary").repartition(shards, "shard").sortWithinPartitions("shard", "block")
    replies = cut(asked.mapInArrow(answer, "block long, word long, n long, payload binary"), "replies")
    seen = replies.where("block is null").groupBy("word").agg(F.sum("n").alias("n"))
    known = seen.agg(F.sum(F.when(F.col("word").isNull(), F.col("n")).otherwise((F.col("n") > 0).cast("long"))).alias("n")).first()["n"] or 0
    known += int(end > 0)

    def code(batches):
        for number, block in _blocks(batches):
            m = len(block.words)
            order = np.argsort(-np.bincount(block.codes, minlength=m), kind="stable") if m else np.zeros(0, np.int64)
            rank = np.empty(m, np.uint32)
            rank[order] = np.arange(m, dtype=np.uint32)
            hot = np.flatnonzero(np.isin(block.words, shared.value.words))
            head = np.array([m, len(hot)], "<i8").tobytes() + zstandard.compress(planes(order) + planes(hot), 1)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([0], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([head], pa.binary())], ["block", "at", "id", "held", "payload"])
            ends = np.cumsum(block.n)
            for a in range(0, len(block.n), 500):
                b = min(len(block.n), a + 500)
                coded = [pack(rank[block.codes[e - k : e]]) for e, k in zip(ends[a:b].tolist(), block.n[a:b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, number)), pa.array(np.arange(a + 1, b + 1)), pa.array(block.ids[a:b], pa.int64()), pa.array(block.held[a:b]), pa.array(coded, pa.binary())], ["block", "at", "id", "held", "payload"]
                )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at")
        head = right.column("payload")[0].as_py()
        m, hots = np.frombuffer(head, "<i8", 2).tolist()
        data = zstandard.decompress(head[16:])
        order = unplane(data, m, 1)[0].astype(np.int64)
        hot = unplane(memoryview(data)[4 * m :], hots, 1)[0].astype(np.int64)
        right = right.slice(1)
        codes = [unpack(x) for x in right.column("payload").to_pylist()]
        n = np.array([len(c) for c in codes], np.int64)
        codes = order[np.concatenate(codes).astype(np.int64)] if n.sum() else np.zeros(0, np.int64)
        asked = left.sort_by("n").column("payload").to_pylist()
        low, high, good = _score(codes, n, m, hot, asked, end, tokens, known, discount)
        return pa.table({"id": right.column("id"), "held": right.column("held"), "n_tokens": n + 1, "n_known": good, "base_score": low, "score": high})

    coded = rows.mapInArrow(code, "block long, at long, id long, held boolean, payload binary")
    found = replies.where("block is not null").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(score, "id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    return scored(texts(spark, sf_dir), remainder("doc_id", 7) == 2)
