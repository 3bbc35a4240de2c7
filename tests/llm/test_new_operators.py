"""Operators 11 to 13 against brute-force versions, with nulls, empty and very long rows, ties, repeats and clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import clusters, integers, lines, negatives

BLANK = " \t\n\x0b\x0c\r"
CLASH = ["row", "key", "gone", "pos", "id", "v", "was", "distance", "shard", "n", "k1", "r1"]


def clashing(frame):
    return frame.withColumns({c: F.lit(c) for c in CLASH if c not in frame.columns})


# ---- 11


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected_lines(rows, chars=20, least=3):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    lowest = lambda i: -math.inf if i is None else i
    keeper = {k: max(ids, key=lowest) for k, ids in holders.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if keeper.get(key(x), i) == i]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return Counter(out)


def got_lines(frame, **how):
    return Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.line_dedup(frame, **how).collect())


def test_lines(spark):
    rng = random.Random(3)
    shared = [f"Common LINE number {k} of the site" for k in range(6)] + ["Ünïcode ZEILE mit Ümlauten Ä", "exactly twenty chars", "nineteen chars only", "日本語の行" * 5]
    texts = []
    for _ in range(40):
        own = [f"own line {rng.random()} in this text" for _ in range(rng.randrange(4))]
        some = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "]) for x in rng.sample(shared, rng.randrange(5))]
        both = own + some + some[:1] + rng.choice([[], [""], ["", ""]])
        rng.shuffle(both)
        texts.append("\n".join(both))
    rows = [*enumerate(texts), (40, None), (41, ""), (42, "\n"), (43, "\n\n  \n"), (3, texts[3]), (3, texts[3]), (None, texts[5]), (None, texts[6]), (None, None), (3, "another text of the id\n" + shared[0])]
    rows += [(100 + k, f"{k}\nonly in rows of two ids, twice in one") for k in (0, 0, 1)] + [(200, "\n".join(f"line {k % 900} of a very long text, with repeats" for k in range(30_000))), (201, "line 7 of a very long text, with repeats\nx"), (202, "LINE 7 OF A VERY LONG TEXT, WITH REPEATS ")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    want = expected_lines(rows)
    assert got_lines(frame) == want and any(n for _, _, n, _ in want)
    assert got_lines(frame, chars=5, least=2) == expected_lines(rows, 5, 2)
    assert lines.line_dedup(frame).select("row.*").columns == frame.columns


def test_lines_that_most_rows_share(spark):
    rows = [(k, f"a heading that each and every row has\nbody {k}") for k in range(3_000)]
    got = got_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == Counter([(k, 2, 1, f"body {k}") for k in range(2_999)] + [(2_999, 2, 0, rows[-1][1])])


def test_lines_of_nothing(spark):
    assert got_lines(spark.createDataFrame([], "doc_id long, text string")) == Counter()


def test_lines_run_without_python(spark):
    plan = lines.line_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 12


def floors(v):
    return [math.floor(256 * float(x)) for x in v]


def valid(v, width=None):
    return v is not None and (width is None or len(v) == width) and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, k, rounds, seed, width):
    """``Counter`` of (id, cluster, distance), and the centroids, from plain rounds over all vectors."""
    kept = [(i, floors(v)) for i, v in rows if valid(v, width)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(at)]
    return Counter((i, (n := nearest(v))[1], n[0]) for i, v in kept), at


def vectors(rng, n, width, groups=6):
    centres = rng.normal(size=(groups, width))
    return (centres[rng.integers(groups, size=n)] + 0.4 * rng.normal(size=(n, width))).tolist()


@pytest.mark.parametrize(("k", "rounds", "seed"), [(7, 5, 2), (40, 5, 2), (3, 12, 9), (7, 0, 2)])
def test_clusters(spark, k, rounds, seed):
    rng = np.random.default_rng(seed)
    rows = list(enumerate(vectors(rng, 150, 4)))
    rows += [(150, rows[0][1]), (4, rows[4][1]), (4, rows[4][1]), (None, rows[5][1]), (160, None), (161, []), (162, [1.0, None, 1.0, 1.0]), (163, [float("nan")] * 4), (164, [1.0, float("inf"), 0.0, 0.0]), (165, [1.0] * 3)]
    rows += [(170 + j, [0.5, 0.5, 0.5, 0.5]) for j in range(60)] + [(300, [-0.001, 0.0039, -7.0, 0.0])]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(4)
    state, at = clusters.clustered(frame, k=k, rounds=rounds, seed=seed, width=4)
    want, centres = lloyd(rows, k, rounds, seed, 4)
    assert at == centres
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()) == want


def test_clusters_of_few_and_large_vectors(spark):
    rows = [(1, [1e6, -1e6]), (2, [1e9, 3e9]), (3, [1e13, -2e13]), (4, [5.0, 5.0]), (5, [1e300, 0.0]), (6, [1e9, 3.1e9])]
    state, at = clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=4, width=2)
    want, centres = lloyd(rows[:4] + rows[5:], 3, 4, 2, 2)
    assert at == centres
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in state.collect()) == Counter((i, c, min(d, 2**63 - 1)) for i, c, d in want.elements())
    state, at = clusters.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert state.count() == 0 and at == []


def test_query_of_clusters(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = list(enumerate(vectors(rng, 90, 64)))
    for name, those in (("some", rows), ("none", [])):
        spark.createDataFrame(those, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    single = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    want, at = lloyd(single, 40, 5, 2, 64)
    inertia = defaultdict(int)
    for _, c, d in want:
        inertia[c] += d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    got = [tuple(r) for r in clusters.op12_clusters(spark, f"{tmp_path}/some").collect()]
    assert sorted(got) == sorted((i, c, d, inertia[c], sum(inertia.values()), text[c]) for i, c, d in want)
    assert clusters.op12_clusters(spark, f"{tmp_path}/none").count() == 0


# ---- 13


def mine(rows, asks, positives=5, most=3, low=50, high=95):
    kept = {}
    for i, label, v in rows:
        if i is not None and label is not None and valid(v):
            kept[i] = min(kept.get(i, (label, floors(v))), (label, floors(v)))
    out = []
    for a, (label, v) in kept.items():
        if asks(a):
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, (_, w) in kept.items() if i != a and len(w) == len(v))
            for p, i in [s for s in scores if kept[s[1]][0] == label][:positives]:
                fit = [s for s in scores if kept[s[1]][0] != label and low * -p <= 100 * -s[0] <= high * -p][:most]
                out += [(a, i, k, j, -p, -s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def odd_rows(rng, n=200, width=6):
    rows = [(i, int(rng.integers(4)), v) for i, v in enumerate(vectors(rng, n, width))]
    rows += [(300 + j, j % 3, rows[10][2]) for j in range(12)]  # equal scores
    rows += [(10, 2, rows[10][2]), (10, 2, rows[10][2]), (10, 0, rows[11][2])]  # an id of several rows
    rows += [(None, 1, rows[0][2]), (400, None, rows[0][2]), (401, 1, None), (402, 1, [1.0, None] * 3), (403, 1, [float("nan")] * 6), (404, 1, [float("-inf")] + [0.0] * 5)]
    rows += [(500 + j, j % 2, [0.0] * width) for j in range(4)]  # scores of zero
    rows += [(600 + j, j % 2, [float(j), 1.0]) for j in range(8)] + [(700, 1, []), (705, 2, [])]  # other lengths
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize(("every", "how"), [(5, {}), (3, {"positives": 2, "negatives": 1, "low": 0, "high": 100}), (1, {"positives": 50, "negatives": 400})])
def test_negatives(spark, monkeypatch, every, how):
    monkeypatch.setattr(negatives, "LEAST", 20)
    rows = odd_rows(np.random.default_rng(every))
    frame = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).repartition(3)
    got = negatives.mined(frame, F.col("id") % every == 0, **how)
    want = mine(rows, lambda i: i % every == 0, how.get("positives", 5), how.get("negatives", 3), how.get("low", 50), how.get("high", 95))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_with_scores_beyond_64_bits(spark):
    rows = [(0, 1, [1e12, 3.0]), (1, 1, [2e12, 1.0]), (2, 2, [1.5e12, 9.0]), (3, 2, [1.5e12, 9.5]), (4, 3, [1e300, 0.0])]
    got = sorted(tuple(r) for r in negatives.mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("id") == 0).collect())
    most = 2**63 - 1
    assert got == [(a, p, k, n, min(x, most), min(y, most)) for a, p, k, n, x, y in mine(rows[:4], lambda i: i == 0)] and got[0][3] == 3
    assert negatives.mined(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.col("id") == 0).count() == 0


def test_query_of_negatives(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(10)), v) for i, v in enumerate(vectors(rng, 400, 8))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.float32(v).astype(float).tolist()) for i, label, v in rows]
    assert sorted(tuple(r) for r in negatives.op13_negatives(spark, str(tmp_path)).collect()) == mine(moved, lambda i: i % 50 == 0)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for size in (100, 2**24, 2**40, 2**55):
        a, b = (np.floor(rng.uniform(-size, size, (5, 7))) for _ in range(2))
        plain = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b.tolist()] for p in a.tolist()]
        far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b.tolist()] for p in a.tolist()]
        assert integers.products(a, b).tolist() == plain and integers.distances(a, b).tolist() == far
