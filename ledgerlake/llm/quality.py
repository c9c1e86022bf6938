"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole
text is encoded (shares of byte classes and of pairs of neighbouring classes,
word lengths, repetition; then one dense layer); a gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs the encoded passages, and a
logistic layer scores their weighted mean.  All layers are learned together from
document labels alone.

Defined cases: null or empty text is one empty passage; with no labelled row every
score is 0.5; with labels of one kind only every score is that kind's rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, Prefix, annotate, spans, string_buffers, text_chunks
from .sampling import stratified

PASSAGE = 48
HIDDEN, GATE = 24, 12
PER_CLASS = 3000

#: Byte classes, each by its (inclusive) ranges; the last one is every byte that is left.
CLASSES = (
    ((0x61, 0x7A),),
    ((0x41, 0x5A),),
    ((0x30, 0x39),),
    ((0x20, 0x20), (0x09, 0x09)),
    ((0x0A, 0x0A), (0x0D, 0x0D)),
    ((0x2E, 0x2E),),
    ((0x2C, 0x2C), (0x3A, 0x3B)),
    ((0x21, 0x21), (0x3F, 0x3F)),
    ((0x7C, 0x7C), (0x3C, 0x3C), (0x3E, 0x3E), (0x2F, 0x2F)),
    ((0x23, 0x26), (0x2A, 0x2B), (0x3D, 0x3D), (0x40, 0x40), (0x5E, 0x60), (0x7E, 0x7E)),
    ((0x80, 0xFF),),
)
_N = len(CLASSES) + 1
_CLASS = np.full(256, _N - 1, dtype=np.uint8)
for _i, _ranges in enumerate(CLASSES):
    for _lo, _hi in _ranges:
        _CLASS[_lo : _hi + 1] = _i
_BLANK = np.isin(_CLASS, (3, 4))
WIDTH = _N * _N + _N + 5

COLUMNS = [T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.IntegerType()), T.StructField("top_passage", T.IntegerType())]


def encode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features [passages, WIDTH], row of each passage); every row has a passage."""
    data, offsets = string_buffers(arr)
    n = len(offsets) - 1
    starts, ends, row = spans(~_BLANK[data], offsets)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(len(starts)) - first[row]
    blocks = np.maximum(-(-count // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(blocks)])
    rows = np.repeat(np.arange(n), blocks)
    passage = base[row] + within // PASSAGE
    total = int(base[-1])
    x = np.zeros((total, WIDTH))
    if not len(starts):
        return x, rows
    # A byte belongs to the passage of the word at or before it.
    owner = np.zeros(len(data), np.int32)
    owner[starts] = 1
    owner = passage[np.maximum(np.cumsum(owner) - 1, 0)]
    kind = _CLASS[data].astype(np.int64)
    single = np.bincount(owner * _N + kind, minlength=total * _N).reshape(total, _N)
    same = owner[1:] == owner[:-1]
    pair = np.bincount((owner[1:] * _N * _N + kind[:-1] * _N + kind[1:])[same], minlength=total * _N * _N).reshape(total, -1)
    size = np.maximum(single.sum(axis=1, keepdims=True), 1)
    x[:, :_N] = single / size
    x[:, _N : _N + _N * _N] = pair / size
    words = np.bincount(passage, minlength=total)
    safe = np.maximum(words, 1)
    length = ends - starts
    h = Prefix(LOWER[data]).of(starts, ends)
    x[:, -5] = np.bincount(passage, weights=length, minlength=total) / safe / 10
    x[:, -4] = np.sqrt(np.bincount(passage, weights=length.astype(float) ** 2, minlength=total) / safe) / 10
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    x[:, -3] = np.bincount(passage, weights=again, minlength=total) / safe
    order = np.lexsort((h, row))
    seen = np.zeros(len(h), bool)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    x[:, -2] = np.bincount(passage, weights=seen, minlength=total) / safe
    x[:, -1] = np.minimum(np.log1p(words), 4) / 4
    return np.sqrt(x), rows


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray], constant: float | None = None, shift: float = 0.0):
        self.mean, self.scale, self.p, self.constant, self.shift = mean, scale, p, constant, shift

    def annotate(self, arr: pa.Array) -> dict[str, pa.Array]:
        x, rows = encode(arr)
        n = len(arr)
        first = np.searchsorted(rows, np.arange(n))
        size = np.bincount(rows, minlength=n)
        if self.constant is not None:
            return {"score": pa.array(np.full(n, self.constant), pa.float64()), "n_passages": pa.array(size, pa.int32()), "top_passage": pa.array(np.zeros(n), pa.int32())}
        out = forward((x - self.mean) / self.scale, rows, first, self.p)
        logit = out["logit"] + self.shift
        top = np.lexsort((-np.arange(len(rows)), out["a"], rows))
        top = top[np.append(first[1:], len(rows)) - 1] - first
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))), pa.float64()), "n_passages": pa.array(size, pa.int32()), "top_passage": pa.array(top, pa.int32())}


def forward(x: np.ndarray, rows: np.ndarray, first: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[rows])
    a = e / np.add.reduceat(e, first)[rows]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}


def train(texts: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 0.01, penalty: float = 1e-3, seed: int = 5) -> tuple:
    """Adam on the documents' log-likelihood, both classes weighing alike in total."""
    xs, rs, at = [], [], 0
    for arr in text_chunks(texts):
        f, r = encode(arr)
        xs.append(f)
        rs.append(r + at)
        at += len(arr)
    x, rows = np.concatenate(xs), np.concatenate(rs)
    del xs
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x -= mean
    x /= scale
    n = len(texts)
    first = np.searchsorted(rows, np.arange(n))
    rng = np.random.RandomState(seed)
    p = {
        "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)),
        "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1),
    }
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(u) for k, u in p.items()}
    for step in range(1, rounds + 1):
        o = forward(x, rows, first, p)
        g = (1 / (1 + np.exp(-o["logit"])) - y) * weight
        dz = g[:, None] * p["c"]
        da = (dz[rows] * o["h"]).sum(axis=1)
        de = o["a"] * (da - np.add.reduceat(o["a"] * da, first)[rows])
        dts = de[:, None] * p["w"]
        dt, ds = dts * o["s"] * (1 - o["t"] ** 2), dts * o["t"] * o["s"] * (1 - o["s"])
        dh = (o["a"][:, None] * dz[rows] + dt @ p["V"].T + ds @ p["U"].T) * (1 - o["h"] ** 2)
        grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": o["h"].T @ dt, "U": o["h"].T @ ds, "w": (o["t"] * o["s"]).T @ de, "c": o["z"].T @ g, "d": np.array([g.sum()])}
        for k in p:
            gk = grad[k] + (penalty * p[k] if k in ("W", "c") else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return mean, scale, p


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Train on the documents of about ``per_class`` labels of 0 and of 1 (other labels are left out)."""
    known = labels.where(F.col(label_col).isin(0, 1))
    rows, counts = stratified(docs, label_col, per_class, known, id_col, text_col)
    y = np.array([r[1] for r in rows], dtype=int)
    n1, n0 = int(counts.get(1, 0)), int(counts.get(0, 0))
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, n1 / (n1 + n0) if n1 + n0 else 0.5)
    return Model(*train([r[0] for r in rows], y), shift=float(np.log(n1 / n0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score, n_passages, top_passage (position of the one that weighs most)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda arr: shared.value.annotate(arr), COLUMNS, id_col, text_col)
