"""Operator 1: SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint bits that go together are put into one partition; each partition has a threshold of its own, and the
thresholds (their sum is ``radius - partitions + 1``) come from dynamic programming on the number of probes and
the estimated number of candidates.  Two fingerprints within ``radius`` bits agree in some partition up to its
threshold, so a fingerprint is dealt to each value that its partition can take within the threshold, and those
that meet are verified on all bits.  Links leave a bucket as a star, not as all pairs; stars are joined to
components.

Near copies (``near_duplicates_dropped``) are texts whose sets of shingles are similar.  At a similarity of 0.8
fingerprints of 64 bits differ in some ten of them, where no partition prunes any more, so fingerprints give the
candidates that are close and a prefix filter over the sets gives the rest; both are decided on the exact sets.

Null and empty texts have fingerprint zero and link like any other; repeated texts share a fingerprint; an
empty table gives an empty result; other columns are left out.  A very long text is read once by one task and leaves
it as a fingerprint, or as the set of its shingles (8 bytes a word).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._shared import U64, Rolling, cut, mix, scratch, signed, text_bytes, texts, word_hashes
from crosspanel.llm.blocks import planes, unplane
from crosspanel.llm.components import components

SEED = 42
#: Members of a bucket that meet in one task.  A larger one is dealt again by the bits that its key leaves out, and what
#: is still larger is compared in pairs of such parts.
PART = 4_096
#: Nodes of a shingle from which it comes last in the order of prefixes.
CROWD = 50
#: Rows of a shingle that meet in one task in the last pass over candidates.
BLOCK = 2_000
#: Differing bits up to which fingerprints of sets make candidates of similar sets.
RADIUS = 3
#: Row keys (8 bytes each) up to which they are broadcast to the texts; more keys are joined by a shuffle.
BROADCAST = 1_000_000
#: Bits of a shingle by which it is counted.
SHORT = 48
#: Column of a row's own key.
KEY = "__row"
#: What a row that is dealt costs, in comparisons.
ROW_COST = 400


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles of a text in lower case, repeats included; none without words."""
    words = text_bytes(text).lower().split()
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], U64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), U64, len(starts))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The set of the ``width``-word shingles of a text in lower case as sorted 64-bit hashes; none without words."""
    words = word_hashes(text_bytes(text).lower())[2]
    return np.unique(Rolling(words).every(min(width, len(words)))) if len(words) else words


def fingerprint(hashes: np.ndarray) -> int:
    """Bit ``b`` is 1 if it is set in over half of ``hashes``; zero for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of each row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(np.array(fps, U64)))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits of each partition and its threshold; -1 leaves a partition out."""

    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits that are set together, summed by Spark."""

    def run(batches):
        n, total = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            a = np.asarray(b.column(0)).astype(np.int64).view(U64)
            x = np.unpackbits(a.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            n += len(a)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def correlated_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups of near-equal width, each grown by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        first = max(left, key=lambda b: (corr[b, left].max(), -b))
        group = [first]
        left.remove(first)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def chance(bits: list[int], together: np.ndarray, n: int, most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t of ``bits``, for t from 0 to ``most``.

    From the bits' own frequencies, with the number of bits lowered for their correlation.
    """
    p = np.diag(together)[bits] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(len(bits) + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    sub = together[np.ix_(bits, bits)] / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = (sub - np.outer(p, p)) / np.outer(sd, sd)
    free = len(bits) / max(1.0, float((rho**2).sum() / len(bits)))
    return [float(min(1, max(x, 1e-30)) ** (free / len(bits))) for x in np.cumsum(dist)[: most + 1]]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each partition, of the sum ``total`` and of the least summed cost.

    ``costs[i][t + 1]`` is the cost of threshold t in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in after or c + x < after[s + t][0]:
                    after[s + t] = (c + x, [*ts, t])
        best = after
    return best[total]


def make_plan(n: int, together: np.ndarray, radius: int, most_parts: int = 8) -> Plan:
    """The cheapest partitions and thresholds; at least two partitions, unless the radius is 0."""
    n = float(max(n, 1))
    found = []
    for parts in range(min(2, radius + 1), max(1, min(most_parts, radius + 1)) + 1):
        groups, costs = correlated_groups(together, n, parts), []
        for g in groups:
            most = min(radius, 3, len(g))
            share = chance(g, together, n, most)
            balls = np.cumsum([math.comb(len(g), t) for t in range(most + 1)])
            costs.append([0.0] + [ROW_COST * n * float(balls[t]) + balls[t] * n * n * share[0] / 2 for t in range(most + 1)])
        if parts * min(radius, 3) >= radius - parts + 1:
            cost, ts = allocate(costs, radius - parts + 1)
            found.append((cost, Plan(tuple(map(tuple, groups)), tuple(ts))))
    return min(found, key=lambda x: x[0])[1]


def _number(bits) -> int:
    """Bits as a signed 64-bit number."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _probes(rows: DataFrame, plan: Plan) -> DataFrame:
    """``(part, key, id, fp)``: each fingerprint at every value of a partition within its threshold."""
    each = []
    for i, (bits, most) in enumerate(zip(plan.bits, plan.thresholds, strict=True)):
        for flipped in (c for t in range(most + 1) for c in combinations(bits, t)):
            each.append(F.struct(F.lit(i).alias("part"), F.lit(_number(bits)).alias("mask"), F.lit(_number(flipped)).alias("flip")))
    dealt = rows.select("id", "fp", F.explode(F.array(*each)).alias("p"))
    return dealt.select("p.part", F.xxhash64("p.part", F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip"))).alias("key"), "id", "fp")


def _again(rows: DataFrame, plan: Plan, radius: int) -> DataFrame:
    """Members of crowded buckets, dealt by the bits outside their partition: of ``radius`` + 1 groups of those one is equal."""
    masks = []
    for bits in plan.bits:
        rest = [b for g in plan.bits for b in g if b not in bits]
        masks.append(F.array(*[F.lit(_number(g.tolist())) for g in np.array_split(np.array(rest, int), radius + 1)]))
    dealt = rows.select("key", "id", "fp", F.posexplode(F.array(*masks)[F.col("part")]).alias("k", "mask"))
    return dealt.select(F.xxhash64("key", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "id", "fp")


def _link_rows(fp, a, b, radius):
    """Of the pairs a[i], b[i], those that link."""
    ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    return a[ok], b[ok]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels of linked rows until each component has one."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]


def _bucket_labels(fp, bounds, radius):
    """Label of each row, the first row of its component within its bucket; ``bounds`` are the buckets' starts and end."""
    n = len(fp)
    label, length = np.arange(n), np.diff(bounds)
    small = np.repeat(length <= 64, length)
    ends = np.repeat(bounds[1:], length)
    at = np.arange(n)
    for shift in range(1, int(length[length <= 64].max(initial=1))):
        a = at[small & (at + shift < ends)]
        if not len(a):
            break
        _join(label, *_link_rows(fp, a, a + shift, radius))
    for k in np.flatnonzero(length > 64):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        step = max(1, 2_000_000 // (hi - lo))
        for s in range(lo, hi, step):
            e = min(hi, s + step)
            near = np.bitwise_count(fp[s:e, None] ^ fp[None, s:hi]) <= radius
            near &= label[s:e, None] != label[None, s:hi]  # what an earlier slice has joined isn't looked at again
            a, b = np.nonzero(near)
            keep = a < b
            _join(label, a[keep] + s, b[keep] + s)
    return label


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``(src, dst)``: a star for each set of ``nodes(id, fp)`` that link at ``radius`` or fewer bits within a bucket.

    Buckets of over ``PART`` rows are dealt again by the other bits; those that stay larger are compared in pairs of
    parts, each pair in a task of its own, so memory is bounded.
    """
    plan = make_plan(*bit_statistics(nodes), radius)
    first = _probes(nodes, plan)
    crowded = cut(first.groupBy("key").count().where(F.col("count") > PART).select("key"), "crowded")
    again = _again(first.join(crowded, "key", "left_semi"), plan, radius)
    parts = again.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    again = again.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = again.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "fp")
    dealt = first.join(crowded, "key", "left_anti").select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), "id", "fp").union(again)

    def run(batches):
        held = None

        def done(t: pa.Table, last: bool):
            """Links of the whole buckets of ``t``, and the rows of the last bucket, which may go on."""
            key = np.stack([np.asarray(t.column(c)) for c in ("key", "x", "y")])
            turn = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = np.concatenate([[0], turn, [t.num_rows]]).astype(np.int64)
            if not last:
                bounds = bounds[:-1]
            stop = int(bounds[-1])
            if len(bounds) < 2 or not stop:
                return None, t
            head = t.slice(0, stop)
            ids = np.asarray(head.column("id"))
            label = _bucket_labels(np.asarray(head.column("fp")).astype(np.int64).view(U64), bounds, radius)
            moved = np.flatnonzero(label != np.arange(stop))
            pairs = np.unique(np.stack([ids[moved], ids[label[moved]]]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"]), t.slice(stop)

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 20_000:
                out, held = done(held.combine_chunks(), False)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out, _ = done(held.combine_chunks(), True)
            yield out

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "src long, dst long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp long, component long)`` for each row: the smallest id that links lead to, its own included."""
    each = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = cut(each.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    # nodes are named by their fingerprint; a component's id is its smallest document
    joined = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component"))
    return each.join(named.join(least, "c").select("fp", "component"), "fp").select(F.col("id").alias(id_col), "fp", "component")


def set_hash(h: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes(), SEED)


def prefix(h: np.ndarray, similarity: float, last: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, so many that any two sets of ``similarity`` share one of them, and how many are rare.

    In one order for all sets: those in ``last`` (sorted, see ``_crowded``) come last, otherwise by a scrambled hash.
    Rare are those that aren't in ``last``.
    """
    n = len(h)
    if not n:
        return h, 0
    m = mix(h)
    short = m >> U64(64 - SHORT)
    late = last[np.minimum(np.searchsorted(last, short), len(last) - 1)] == short if len(last) else np.zeros(n, bool)
    return m[np.lexsort((m, late))][: prefix_length(n, similarity)], n - int(late.sum())


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def _crowded(rows: DataFrame, shingle: int, most: int, text_col: str) -> np.ndarray:
    """Shingles (the upper ``SHORT`` bits of their scrambled hashes) that over ``most`` of ``rows`` have, sorted.

    Counted over all sets; there are at most (rows x mean set size) / ``most``.  They only steer the order of prefixes:
    any order gives the same result.  A task sends its shingles as sorted differences, a few bytes each.
    """
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(token, np.ceil(np.arange(buckets + 1) * (2.0**SHORT / buckets)).astype(U64))
            full = np.flatnonzero(np.diff(at))
            made = []
            for x, y in zip(at[full].tolist(), at[full + 1].tolist(), strict=True):
                step = np.diff(token[x:y], prepend=U64(0))
                made.append((y - x).to_bytes(4, "little") + zstandard.compress(planes(step & U64(0xFFFFFFFF), step >> U64(32), n[x:y]), 1))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(made, pa.binary())], ["bucket", "counts"])

        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(mix(shingle_set(t.as_py(), shingle)) >> U64(64 - SHORT))
                size += len(held[-1])
                if size > 1 << 21:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    def often(batches):
        def found():
            every, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held]))
            return pa.RecordBatch.from_arrays([pa.array(signed(every[n > most]))], ["token"])

        now, held = None, []
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield found()
                    held = []
                now = bucket
                low, high, n = unplane(zstandard.decompress(raw[4:]), int.from_bytes(raw[:4], "little"), 3)
                held.append((np.cumsum(low.astype(U64) + (high.astype(U64) << U64(32)), dtype=U64), n))
        if held:
            yield found()

    sent = rows.select(text_col).mapInArrow(run, "bucket int, counts binary")
    tokens = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(often, "token long").toArrow()
    return np.sort(tokens.column("token").to_numpy().astype(np.int64).view(U64))


def _prefixes(rows: DataFrame, shingle: int, similarity: float, last: np.ndarray, text_col: str) -> DataFrame:
    """``(token, id, size, pos, rare)`` of the prefixes of ``rows(KEY, text)``; ``pos`` is the place in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            made = [prefix(h, similarity, shared.value) for h in sets]
            n = [len(x) for x, _ in made]
            if sum(n):
                ids, sizes, rare = (np.repeat(x, n) for x in (b.column(0).to_numpy(), np.array([len(h) for h in sets], np.int32), np.array([r for _, r in made], np.int32)))
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                cols = [signed(np.concatenate([x for x, _ in made])), ids, sizes, pos, rare]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "id", "size", "pos", "rare"])

    return rows.select(KEY, text_col).mapInArrow(run, "token long, id long, size int, pos int, rare int")


def _alike(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float, text_col: str) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose sets have that Jaccard similarity, counted on the sets themselves."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], ["id", "hashes"])

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    named = pairs.select(F.col("src").alias(KEY)).union(pairs.select(F.col("dst").alias(KEY))).distinct()
    held = cut(_of_keys(rows, cut(named, "named")).mapInArrow(sets, "id long, hashes binary"), "sets")
    both = pairs.join(held.select(F.col("id").alias("src"), F.col("hashes").alias("x")), "src").join(held.select(F.col("id").alias("dst"), F.col("hashes").alias("y")), "dst")
    return both.select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` of the written table ``keys(KEY)``; where the keys are too many to broadcast, written after one shuffle."""
    if keys.count() <= BROADCAST:
        return rows.join(F.broadcast(keys), KEY, "left_semi")
    return cut(rows.join(keys, KEY, "left_semi"), "texts")


def similar_groups(rows: DataFrame, shingle: int, similarity: float, text_col: str, radius: int = RADIUS) -> DataFrame:
    """``(KEY, component)``: rows in one component have equal shingle sets or are joined by pairs of ``similarity``.

    Equal sets are one node.  Candidates are, in turn,

    1. nodes whose fingerprints (of the sets) link within ``radius`` bits, by the pigeonhole principle: most near copies;
    2. for what fingerprints can't find, the sets that share a shingle of their prefixes (two similar sets always do):
       first each of them with the one that has the fewest rare shingles, the centre of a group of copies if there is
       one, and then all pairs which nothing has joined yet and whose places allow the similarity.

    Each candidate is decided on the exact sets.  Shingles of over ``CROWD`` nodes come last in the order of prefixes.
    """

    def digests(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_hash(h) for h in sets], pa.binary()), pa.array(signed(np.array([fingerprint(h) for h in sets], U64)))], [KEY, "digest", "fp"])

    each = cut(rows.select(KEY, text_col).mapInArrow(digests, f"`{KEY}` long, digest binary, fp long"), "digests")
    nodes = cut(each.groupBy("digest").agg(F.min(KEY).alias("id"), F.min("fp").alias("fp")), "nodes")
    texts_ = _of_keys(rows.select(KEY, text_col), nodes.select(F.col("id").alias(KEY)))
    last = _crowded(texts_, shingle, max(CROWD, nodes.count() // 5_000), text_col)  # so that the list is bounded
    tokens = cut(_prefixes(texts_, shingle, similarity, last, text_col), "prefixes")
    met = tokens.groupBy("token").count().where("count > 1").select("token")
    tokens = cut(tokens.join(met, "token", "left_semi"), "tokens")
    lead = tokens.groupBy("token").agg(F.min(F.struct("rare", "id", "size", "pos")).alias("lead"))
    pairs = tokens.join(lead, "token").where(F.col("id") != F.col("lead.id")).where(_may("size", "pos", "lead.size", "lead.pos", similarity))
    pairs = pairs.select("id", "lead.id").union(links(nodes.select("id", "fp"), radius)).toDF("a", "b")
    good = cut(_alike(_once(pairs, tokens, similarity), texts_, shingle, similarity, text_col), "alike")
    label = cut(components(good), "labels")
    named = tokens.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component", "rare")
    left = cut(_open(_open(named, similarity), similarity), "labelled")
    pairs = _pairs_by_token(left, similarity)
    more = cut(_alike(_once(pairs, tokens, similarity), texts_, shingle, similarity, text_col), "alike")
    label = components(good.union(more))
    named = nodes.join(label.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return each.join(named, "digest").select(KEY, "component")


def _once(pairs: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)``: of ``pairs(a, b)`` each one once whose prefixes have enough in common, written.

    Of the set whose prefix ends first in the order, all that the other one shares is in both prefixes or behind.
    """
    each = cut(pairs.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "pairs")
    one, two = (tokens.select(F.col("id").alias(c), "token", F.col("size").alias(f"{c}_size")) for c in ("src", "dst"))
    both = each.join(one, "src").join(two, ["dst", "token"]).groupBy("src", "dst").agg(F.count("*").alias("n"), F.first("src_size").alias("x"), F.first("dst_size").alias("y"))
    rest = F.greatest(*[F.ceil(F.col(c) * similarity - 1e-6) - 1 for c in ("x", "y")])
    return cut(both.where((F.col("n") + rest) * (1 + similarity) >= similarity * (F.col("x") + F.col("y")) - 1e-6).select("src", "dst"), "plausible")


def _open(named: DataFrame, similarity: float) -> DataFrame:
    """Of ``named(token, id, size, pos, label)`` the rows that may be similar to a row of another label of their shingle."""
    each = named.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("size").alias("low"), F.max(F.col("size") - F.col("pos")).alias("rest")).where("a < b")
    can = F.least(F.col("size") - F.col("pos"), F.col("rest")) * (1 + similarity) >= similarity * (F.col("size") + F.greatest(F.col("low"), F.ceil(F.col("size") * similarity - 1e-6))) - 1e-6
    return named.join(each, "token").where(can).select(*named.columns)


def _pairs_by_token(rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: pairs of ``rows`` of a shingle that have different labels and may be similar.

    A shingle with many rows left is dealt to blocks of ``BLOCK`` of them, each of which meets the shingle's rows in a
    task of its own.
    """
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sized = cut(rows.join(blocks, "token"), "sized")
    one = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    two = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    one, two = (x.select("token", "block", *[F.col(c).alias(f"{c}{k}") for c in ("id", "size", "pos", "label")]) for k, x in ((1, one), (2, two)))
    pairs = one.join(two, ["token", "block"]).where((F.col("id1") < F.col("id2")) & (F.col("label1") != F.col("label2"))).where(_may("size1", "pos1", "size2", "pos2", similarity))
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def _may(size1: str, pos1: str, size2: str, pos2: str, similarity: float):
    """Whether a pair whose first common shingle has these places can have enough common shingles from there on."""
    rest = F.least(F.col(size1) - F.col(pos1), F.col(size2) - F.col(pos2))
    return rest * (1 + similarity) >= similarity * (F.col(size1) + F.col(size2)) - 1e-6


def near_duplicates_dropped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, null ids last, and of those any one.

    Rows are told apart by a key of their own, so equal ids and null ids are rows like any other.  Two texts link if
    the Jaccard similarity of their sets of ``shingle`` words is ``similarity`` or more; texts without words are alike.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]  # so that no column of ``docs`` clashes with the names used here
    id_col, text_col = (own[docs.columns.index(c)] for c in (id_col, text_col))
    rows = cut(docs.toDF(*own).withColumn(KEY, F.monotonically_increasing_id()), "rows")  # written, so that keys stay as they are
    with scratch(docs.sparkSession) as stays:
        found = similar_groups(rows, shingle, similarity, text_col)
        first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(KEY)))
        kept = stays(rows.select(KEY, id_col).join(found, KEY).groupBy("component").agg(first.alias("first")).select(f"first.{KEY}"), "kept")
    return _of_keys(rows, kept).select(*own).toDF(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    found = groups(docs, 3, 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
