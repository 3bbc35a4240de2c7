"""Queries and the pipeline on the smallest tables."""

import base64
import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from crosspanel.llm import decontaminate, queries
from tests.llm.test_operators import WORD, ascii_lower, uncovered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
COLUMNS = {
    "op1_": "doc_id fingerprint component_id",
    "op2_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_": "doc_id item_id",
    "op4_": "doc_id held_out score predicted",
    "op5_": "page_id url text n_chars",
    "op6_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_": "doc_id n_words n_removed kept_sha256",
    "op8_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_": "doc_id held_out score predicted",
    "op10_": "query_id rank vec_id score",
    "op11_": "doc_id n_lines n_dropped kept_sha256",
    "op12_": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_": "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF)
    wanted = next(v for k, v in COLUMNS.items() if name.startswith(k)).split()
    assert set(wanted) <= set(got.columns)
    table = {"op5_": "pages", "op10_": None, "op3_": None, "op12_": "embeddings", "op13_": None}.get(name[: name.index("_") + 1], "documents")
    if table:
        assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def shingles(text):
    w = WORD.findall(ascii_lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def first_of_groups(docs):
    """Ids of the rows ``(id, text)`` that are the smallest of their group of near copies, from all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    group = {i: i for i in sets}
    links = [(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and len(x & y) >= 0.8 * len(x | y)]
    for _ in sets:
        before = dict(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if before == group:
            break
    return {i for i, g in group.items() if i == g}


def leaked(docs, items):
    """Ids of the rows that have a passage of an item, from a comparison at every place."""
    items = [v for v in map(decontaminate.words_of, items) if len(v)]
    found = set()
    for i, t in docs:
        v = decontaminate.words_of(t)
        if any(decontaminate.best_overlap(v, x, np.arange(1 - len(x), len(v)))[0] for x in items):
            found.add(i)
    return found


def test_pipeline_against_brute_force(spark):
    """Every stage behind the classifier, on all documents of the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    got = {r["doc_id"] for r in stage["near_dedup"](spark, docs, SF).collect()}
    assert got == first_of_groups(rows) and len(got) < len(rows)
    words = [WORD.findall(t or "") for _, t in rows]
    want = {i: t if all(keep) else " ".join(x for x, y in zip(w, keep, strict=True) if y) for (i, t), w, keep in zip(rows, words, uncovered(words, 35), strict=True)}
    stripped = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage["substring_dedup"](spark, docs, SF).collect()}
    assert {i: t for i, (t, _) in stripped.items()} == want and any(want[i] != t for i, t in rows)
    assert all(n == len(want[i]) for i, (t, n) in stripped.items() if t is not None)
    clean = {r["doc_id"] for r in stage["decontamination"](spark, docs, SF).collect()}
    assert clean == {i for i, _ in rows} - leaked(rows, items) and len(clean) < len(rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: list(r["ids"]) for r in stage["bpe"](spark, docs, SF).collect()} == {i: coder.encode_ordinary(t or "") for i, t in rows}


def test_pipeline_on_rows_that_repeat_and_clash(spark):
    plain = "the quick brown fox met a rather slow hedgehog near the old stone bridge at dawn"
    rows = [(1, None), (2, ""), (None, plain), (2, ""), (4, "日本語"), (4, "日本語"), (5, "x " * 30_000)]
    extra = ["row", "row_key", "__row", "id", "score", "kept", "block", "component", "token"]
    odd = spark.createDataFrame([(i, t, "en", *[f"{c}-{k}" for c in extra]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in extra))
    odd = odd.withColumn("n_chars", F.length("text").cast("long"))
    stage = dict(corpus_pipeline.STAGES)

    def texts(frame):
        assert frame.dtypes == odd.dtypes
        found = frame.collect()
        assert all(len({r[c].rpartition("-")[2] for c in extra}) == 1 and all(r[c].startswith(f"{c}-") for c in extra) for r in found)
        return Counter((r["doc_id"], r["text"]) for r in found)

    assert texts(stage["quality"](spark, odd, SF)) <= Counter(rows)
    assert texts(stage["near_dedup"](spark, odd, SF)) == Counter([(1, None), (None, plain), (4, "日本語"), (5, "x " * 30_000)])
    assert texts(stage["substring_dedup"](spark, odd, SF)) == Counter([*rows[:-1], (5, "")])
    assert texts(stage["decontamination"](spark, odd, SF)) == Counter(rows)
    got = stage["bpe"](spark, odd, SF).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.columns == before.columns
    assert whole >= sizes[0] > sizes[1] == sizes[2] >= sizes[3] == sizes[4] > 0.3 * whole
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "x", 0), (None, "some text", "en", "x", 9), (2, "", "en", "x", 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    every = Counter((r[0], r[1]) for r in rows)
    alike = Counter([(1, None), (None, "some text")])  # texts without words are copies of each other
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, SF), stage(spark, odd.where("false"), SF)
        assert none.count() == 0
        if name == "bpe":
            assert Counter((r["doc_id"], r["n_tokens"] > 0, len(r["ids"])) for r in got.collect()) == Counter([(1, False, 0), (2, False, 0), (2, False, 0), (None, True, 2)])
            continue
        assert got.dtypes == none.dtypes == odd.dtypes
        found = Counter((r["doc_id"], r["text"]) for r in got.collect())
        assert found <= every if name == "quality" else found == (alike if name == "near_dedup" else every)
