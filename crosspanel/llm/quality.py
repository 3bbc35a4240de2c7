"""Operator 9: quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, cut every ``PASSAGE`` words).  Each passage is encoded by figures of its
characters and words and a hidden layer; gated attention, learnt from document labels alone, weighs the passages,
and the weighted mean is scored.  The model is fitted on a bounded sample (``labelled.SAMPLE``) and applied to
every whole text; labels, language, source and id are not inputs.

Null and empty texts are a bag of one empty passage; without labels of both kinds every score is the labels' mean
(0.5 for none); repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import labelled
from crosspanel.llm._shared import table, text_bytes, texts, word_hashes

PASSAGE, HIDDEN, GATE, EPOCHS = 40, 24, 12, 40
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "|", "#", "$", "%", "&", "*", "@", "<>={}[]()/\\;:", "'\"-_?+~^`")
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_g.encode(), np.uint8)] = _i
_CLASS[128:] = len(_GROUPS) + 1
WIDTH = len(_GROUPS) + 2 + 6


def passages(text: str | None) -> np.ndarray:
    """Figures of each passage of a text, a row each."""
    raw = text_bytes(text)
    starts, ends, hashes = word_hashes(raw)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    a = np.frombuffer(raw, np.uint8)
    line = np.cumsum(np.concatenate([[0], (a == 10).astype(np.int64)]))[starts]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    within = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    cut = np.flatnonzero(within % PASSAGE == 0)
    n = np.diff(np.append(cut, len(starts)))
    of_word = np.repeat(np.arange(len(cut)), n)
    of_byte = np.repeat(np.arange(len(cut)), np.diff(np.append(np.concatenate([[0], starts[cut[1:]]]), len(a))))
    kinds = len(_GROUPS) + 2
    count = np.bincount(of_byte * kinds + _CLASS[a], minlength=len(cut) * kinds).reshape(-1, kinds)
    size = np.maximum(count.sum(1, keepdims=True), 1)
    order = np.lexsort((hashes, of_word))
    h, w = hashes[order], of_word[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    distinct = np.bincount(w[new], minlength=len(cut))
    again = np.bincount(of_word[1:][hashes[1:] == hashes[:-1]], minlength=len(cut))
    lens = (ends - starts).astype(np.float64)
    mean = np.bincount(of_word, lens, len(cut)) / n
    square = np.bincount(of_word, lens**2, len(cut)) / n
    more = np.stack([np.log1p(n), mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10, distinct / n, again / n, np.full(len(cut), np.log1p(len(cut)))], 1)
    return np.concatenate([np.sqrt(count / size), more], 1).astype(np.float32)


class Attention:
    """Gated attention over the passages of a document."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.mean, self.sd, self.constant = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p, of = self.p, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        x = (x - self.mean) / self.sd
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        return x, of, h, t, s, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        x, of, h, t, s, a, z, out = self.forward(x, starts)
        d = ((out - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = (h * dz[of]).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[of])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {"c": z.T @ d, "d": d.sum(keepdims=True), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": x.T @ du, "b": du.sum(0)}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant or 0.0)
        n = np.fromiter(map(len, bags), np.int64, len(bags))
        return self.forward(np.concatenate(bags), np.cumsum(n) - n)[-1].astype(np.float64)


def fit(rows: DataFrame, epochs: int = EPOCHS) -> Attention:
    """A model from ``rows(id, text, label)``, which are a bounded sample; passages are encoded by the tasks."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([passages(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], ["id", "label", "bag"])

    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label double, bag binary").toArrow().sort_by("id")
    y = got.column("label").to_numpy()
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got.column("bag").to_pylist()]
    model = Attention()
    if not len(y) or y.min() == y.max():
        model.constant = float((y.sum() + 1) / (len(y) + 2))
        return model
    every = np.concatenate(bags)
    model.mean, model.sd = every.mean(0), every.std(0) + 1e-3
    rng = np.random.default_rng(11)
    m = {k: np.zeros_like(w) for k, w in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) + 1e-4
        turn = rng.permutation(len(y))
        for k in range(0, len(turn), 64):
            part = turn[k : k + 64]
            n = np.array([len(bags[i]) for i in part])
            g = model.gradients(np.concatenate([bags[i] for i in part]), np.cumsum(n) - n, y[part])
            step += 1
            for key, grad in g.items():
                grad = grad + (1e-4 * model.p[key] if key not in "bd" else 0)
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad**2
                model.p[key] = (model.p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def scored(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, score double)``: all columns of each row, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        model_ = shared.value
        for b in batches:
            scores = np.concatenate([model_.scores([passages(t.as_py()) for t in b.column(1).slice(k, 64)]) for k in range(0, b.num_rows, 64)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "quality"))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", labelled.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
