"""Operator 4: toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings.  In labelled sentences identity terms are swapped
for other terms of their kind, and the squared change of the score is penalised, so that a neutral mention of a
group is not taken for toxicity.  A labelled text without identity terms has one put into a sentence of its own and
swapped there: such a term shares its beginnings with words that the labels tell something about.  The model is
fitted on a bounded sample (``labelled.SAMPLE``) and applied to every whole text; labels, language, source and id are
not inputs.

Null and empty texts get the score of a text without any known word; without labels every score is the prior
0.5; repeated rows get equal scores; an empty table gives an empty result.  A very long text is one set of words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import labelled
from crosspanel.llm._shared import table, texts

#: Identity terms by kind; a term is swapped for the next of its line.
IDENTITIES = (
    "women men girls boys",
    "woman man girl boy",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees foreigners natives",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs athées",
    "noirs blancs asiatiques arabes",
    "frauen männer mädchen jungen",
    "muslime christen juden atheisten",
    "schwarze weiße asiaten araber",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos ateos",
    "negros blancos asiáticos árabes",
)
SPACE, CHOSEN, PENALTY, RIDGE = 1 << 20, 1_200, 1.0, 3e-4
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose columns a task remembers.
KEPT = 300_000
_SWAP = {a: b for line in IDENTITIES for a, b in zip(line.split(), line.split()[1:] + line.split()[:1], strict=True)}
_TERMS = sorted(_SWAP)
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def features(words: set[str]) -> np.ndarray:
    """Numbers of the features of a set of words: the words and their first few letters."""
    seen = {"=" + w for w in words}
    for n in PREFIXES:
        seen.update(w[:n] for w in words if len(w) > n)
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % SPACE for x in seen), np.int32, len(seen)))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each sentence that has identity terms, before and after the swap.

    Without any, of the text's sentence of the least hash, into which that hash puts a term.
    """
    found, plain = [], []
    for sentence in _SENTENCE.findall((text or "").lower()):
        words = set(_WORD.findall(sentence))
        if not words.isdisjoint(_SWAP):
            found.append((features(words), features({_SWAP.get(w, w) for w in words})))
        elif words:
            plain.append((zlib.crc32(sentence.encode("utf-8", "surrogatepass")), sorted(words)))
    if plain and not found:
        at, words = min(plain)
        term = _TERMS[at % len(_TERMS)]
        found.append((features({*words, term}), features({*words, _SWAP[term]})))
    return found


@dataclass
class Model:
    index: np.ndarray  # column of each feature number, -1 if it is not used
    weight: np.ndarray
    bias: float

    def columns(self, word: str) -> tuple[int, ...]:
        parts = ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]
        at = [self.index[zlib.crc32(x.encode("utf-8", "surrogatepass")) % SPACE] for x in parts]
        return tuple(int(c) for c in at if c >= 0)

    def scores(self, texts: Iterable[str | None], known: dict[str, tuple[int, ...]]) -> list[float]:
        """``known`` keeps the columns of words from call to call."""
        found = []
        for text in texts:
            at: set[int] = set()
            for w in words_of(text):
                c = known.get(w)
                if c is None:
                    if len(known) >= KEPT:
                        known.clear()
                    c = known[w] = self.columns(w)
                if c:
                    at.update(c)
            found.append(float(1 / (1 + np.exp(-(self.bias + self.weight[sorted(at)].sum())))))
        return found


def fit(rows: DataFrame, penalty: float = PENALTY) -> Model:
    """A model from ``rows(text, label)``, which are a bounded sample; features are made by the tasks."""

    def run(batches):
        for b in batches:
            out = []
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                out.append((label, features(words_of(text.as_py())).tolist(), [x.tolist() for pair in swapped(text.as_py()) for x in pair]))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.list_(pa.int32())))], ["label", "seen", "pairs"])

    got = rows.mapInArrow(run, "label double, seen array<int>, pairs array<array<int>>").toArrow()
    y = got.column("label").to_numpy() if got.num_rows else np.zeros(0)
    index = np.full(SPACE, -1, np.int32)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(index, np.zeros(1), float(np.log(p / (1 - p))))
    seen = got.column("seen").combine_chunks()
    seen = seen.chunk(0) if isinstance(seen, pa.ChunkedArray) else seen
    flat, ends = seen.flatten().to_numpy(), np.asarray(seen.offsets)
    of = np.repeat(np.arange(len(y)), np.diff(ends))
    pos, every = np.bincount(flat, y[of], SPACE), np.bincount(flat, minlength=SPACE)
    # the most telling features by G-test; rare ones tell little
    neg, rate = every - pos, y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(pos * np.log(pos / (every * rate))) + np.nan_to_num(neg * np.log(neg / (every * (1 - rate))))
    gain[every < 3] = 0
    chosen = np.argsort(-gain, kind="stable")[:CHOSEN]
    chosen = chosen[gain[chosen] > 3.0]
    index[chosen] = np.arange(len(chosen))

    def matrix(numbers: np.ndarray, rows_: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, len(chosen) + 1), np.float32)
        at = index[numbers]
        x[rows_[at >= 0], at[at >= 0]] = 1
        x[:, -1] = 1
        return x

    x = matrix(flat, of, len(y))
    pairs = [p for row in got.column("pairs").to_pylist() for p in row or ()]
    change = np.zeros((0, x.shape[1]), np.float32)
    if pairs:
        n = np.fromiter(map(len, pairs), np.int64, len(pairs))
        both = matrix(np.array([i for p in pairs for i in p], np.int64), np.repeat(np.arange(len(pairs)), n), len(pairs))
        change = both[0::2] - both[1::2]
    w, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    ridge = np.full(x.shape[1], RIDGE, np.float32)
    ridge[-1] = 0
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y).astype(np.float32) / len(y) + ridge * w
        if len(change):
            g += 2 * penalty * change.T @ (change @ w) / len(change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(index, w[:-1] if len(chosen) else np.zeros(1), float(w[-1]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score double)`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model_, known = shared.value, {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model_.scores((t.as_py() for t in b.column(1)), known), pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    return scored(docs, model).select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
