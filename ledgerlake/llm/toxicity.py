"""Toxicity by multiple-instance learning with noisy-or.

A document is toxic if any of its sentences is: p(doc) = 1 - prod(1 - p(sentence)).
Only documents are labelled, and the sentence classifier (logistic, over hashed
words and word beginnings) is trained through that product, so it learns which
sentences carry the labels; at scoring time the same sentence scores say where
the offending passages are.

The number of sentences enters the noisy-or, so p(doc) of a very long clean text
would creep up; the bias is learned from documents of all lengths, which holds it
down, and whole texts are scored.

Classes are sampled at different rates, and the trained odds are put back to the
labels' own rates.

Defined cases: null or empty text has no sentence and scores the bias alone, as one
empty sentence would; with no labelled row every score is 0; with labels of one
kind only every score is that kind's rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, Prefix, annotate, byte_class, string_buffers, text_chunks, word_spans
from .sampling import stratified

BITS = 18
#: Word beginnings of these many bytes are features beside the whole word.
STEMS = (4, 6, 8)
PER_CLASS = 4000

_BREAK = byte_class((0x0A, 0x0A), (0x0D, 0x0D), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))

COLUMNS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("n_sentences", T.IntegerType()),
    T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
]


class Bags:
    """Words of some texts: feature ids [words, 1 + stems], the sentence of each word, the row of each sentence."""

    def __init__(self, arr: pa.Array):
        data, self.offsets = string_buffers(arr)
        self.n = len(self.offsets) - 1
        low = LOWER[data]
        starts, ends, row = word_spans(low, self.offsets)
        prefix = Prefix(low)
        top = np.uint64(64 - BITS)
        ids = [prefix.of(starts, ends) >> top]
        for k in STEMS:
            # A word no longer than the stem has none; its place goes to feature 0, which has no weight.
            ids.append(np.where(ends - starts > k, (prefix.of(starts, np.minimum(starts + k, ends)) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> top, np.uint64(0)))
        self.ids = np.stack(ids, axis=1).astype(np.int64) if len(starts) else np.zeros((0, 1 + len(STEMS)), np.int64)
        # A word said again and again in a row counts once.
        self.ids[1:][(self.ids[1:, 0] == self.ids[:-1, 0]) & (row[1:] == row[:-1])] = 0
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
        self.first = np.flatnonzero(new)
        self.sentence = np.cumsum(new) - 1
        self.row = row[self.first]
        last = np.append(self.first[1:], len(starts)) - 1
        self.starts = starts[self.first] if len(starts) else starts
        self.ends = ends[last] if len(starts) else ends


class Model:
    def __init__(self, weights: np.ndarray, bias: float, shift: float = 0.0, constant: float | None = None):
        self.weights, self.bias, self.shift, self.constant = weights.astype(np.float32), bias, shift, constant

    def sentences(self, bags: Bags) -> np.ndarray:
        if not len(bags.first):
            return np.zeros(0)
        z = np.add.reduceat(self.weights[bags.ids].sum(axis=1, dtype=np.float64), bags.first) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def annotate(self, arr: pa.Array) -> dict[str, pa.Array]:
        bags = Bags(arr)
        p = self.sentences(bags)
        per_row = np.bincount(bags.row, minlength=bags.n)
        clear = np.bincount(bags.row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=bags.n)
        clear[per_row == 0] = np.log1p(-1 / (1 + np.exp(-self.bias)))
        odds = np.log(np.maximum(-np.expm1(clear), 1e-300)) - clear + self.shift
        score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if self.constant is not None:
            score = np.full(bags.n, self.constant)
        offending: list[list[dict]] = [[] for _ in range(bags.n)]
        for i in np.flatnonzero(p >= 0.5):
            r = bags.row[i]
            offending[r].append({"start": int(bags.starts[i] - bags.offsets[r]), "end": int(bags.ends[i] - bags.offsets[r]), "score": float(p[i])})
        return {"score": pa.array(score, pa.float64()), "n_sentences": pa.array(per_row, pa.int32()), "offending": pa.array(offending, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))}


def train(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 2e-4, least: int = 5) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or log-likelihood, all documents at once; classes weigh as they come."""
    parts = [Bags(arr) for arr in text_chunks(texts)]
    sizes = np.cumsum([0, *(b.n for b in parts)])
    n = int(sizes[-1])
    row = np.concatenate([b.row + at for b, at in zip(parts, sizes, strict=False)])
    first = np.concatenate([b.first + at for b, at in zip(parts, np.cumsum([0, *(len(b.ids) for b in parts)]), strict=False)])
    ids = np.concatenate([b.ids.astype(np.int32) for b in parts])
    del parts
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    seen = np.zeros(1 << BITS, np.int64)
    for j in range(ids.shape[1]):
        seen += np.bincount(np.unique(ids[:, j] + (row[sentence] << BITS)) & (1 << BITS) - 1, minlength=1 << BITS)
    used = np.flatnonzero(seen)
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(len(used))
    ids, df = number[ids], seen[used]
    # Features of a few texts only would let the model learn texts by heart.
    live = (df >= least) & (used != 0)
    y = labels.astype(bool)
    w, bias = np.zeros(len(used)), -4.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(np.add.reduceat(sum(w[ids[:, j]] for j in range(ids.shape[1])), first) + bias, -500, 500)
        p = 1 / (1 + np.exp(-z))
        clear = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        pull = np.where(y, np.exp(clear) / np.maximum(-np.expm1(clear), 1e-9), -1.0)[row]
        g_sentence = pull * p / n
        g_word = g_sentence[sentence]
        g = sum(np.bincount(ids[:, j], weights=g_word, minlength=len(used)) for j in range(ids.shape[1])) - penalty * w
        g = np.where(live, g, 0.0)
        gb = g_sentence.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w += rate * (m / a) / (np.sqrt(v / c) + 1e-6)
        bias += rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    out = np.zeros(1 << BITS)
    out[used[live]] = w[live]
    return out, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Train on the documents of about ``per_class`` labels of 0 and of 1 (other labels are left out)."""
    known = labels.where(F.col(label_col).isin(0, 1))
    rows, counts = stratified(docs, label_col, per_class, known, id_col, text_col)
    y = np.array([r[1] for r in rows], dtype=int)
    n1, n0 = int(counts.get(1, 0)), int(counts.get(0, 0))
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(1 << BITS), -4.0, constant=n1 / max(n1 + n0, 1))
    weights, bias = train([r[0] for r in rows], y)
    shift = np.log(n1 / n0) - np.log((y == 1).sum() / (y == 0).sum())
    return Model(weights, bias, float(shift))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score, n_sentences, offending (byte spans of sentences scored 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda arr: shared.value.annotate(arr), COLUMNS, id_col, text_col)
