"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits.  One linear classifier for each bit
says from a text's byte n-grams on which side of that bit's split of the
languages the text lies; a text goes to the language whose codeword loses least
against all the classifiers' margins, so some of them may err.  The loss of a bit
is weighted by how well its classifier did on training texts that it didn't see.

Codewords: every split of the languages into two sides for up to ``EXHAUSTIVE``
languages, rows of a Hadamard matrix beyond that (distance: half of the bits).

Defined cases: null text, empty text and text without a letter is ``und`` with
score 0; with no labelled row at all every text is ``und``; with one language
every text with a letter is of that language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, U64, annotate, byte_class, keep_rows, string_buffers
from .sampling import stratified

BITS = 16
EXHAUSTIVE = 5
UNKNOWN = "und"
#: Expected number of training texts of each language.
PER_LANGUAGE = 1500

_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Digits and ASCII punctuation say nothing of the language and read as blanks.
_PLAIN = LOWER.copy()
_PLAIN[:0x80][~_LETTER[:0x80]] = 0x20

COLUMNS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]


def codewords(n: int) -> np.ndarray:
    """[n languages, bits] of +1/-1."""
    if n <= EXHAUSTIVE:
        bits = [[1 if m >> i & 1 else -1 for i in range(n)] for m in range(1, 1 << (n - 1))]
        return np.array(bits, dtype=np.float64).reshape(-1, n).T
    h = np.ones((1, 1))
    while len(h) < 2 * n:
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:][:, [len({*h[:n, j]}) > 1 for j in range(1, len(h))]]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(ids of the hashed 2-, 3- and 4-grams at each byte, [from, to, from, to, ...] of the rows), each row between blanks."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(data) + 4 * n + 4, 0x20, dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(4 * np.arange(n) + 1, lengths)] = _PLAIN[data]
    b = padded.astype(np.uint32)
    two = b[:-3] << np.uint32(8)
    two |= b[1:-2]
    three = two << np.uint32(8)
    three |= b[2:-1]
    four = three << np.uint32(8)
    four |= b[3:]
    ids = [((x * np.uint32(m)) >> np.uint32(32 - BITS)).astype(np.int64) for x, m in ((two, 0x9E3779B1), (three, 0x85EBCA77), (four, 0xC2B2AE3D))]
    begin = np.concatenate([[0], np.cumsum(lengths + 4)])[:-1]
    return ids, np.stack([begin, begin + lengths + 1], axis=1).reshape(-1)


def means(ids: list[np.ndarray], bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[rows, bits]: mean weight of each row's features; weights: [bits, features]."""
    out = np.zeros((len(bounds) // 2, len(weights)))
    if len(out):
        for b, w in enumerate(weights):
            v = w[ids[0]]
            for x in ids[1:]:
                v += w[x]
            out[:, b] = np.add.reduceat(v, bounds)[::2]
        out /= (bounds[1::2] - bounds[::2])[:, None] * len(ids)
    return out


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray, scale: float):
        self.languages, self.code, self.weights, self.trust, self.scale = languages, code, np.ascontiguousarray(weights, dtype=np.float32), trust, scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """[rows, languages]: trust-weighted mean of the bits' logistic losses."""
        m = margins[:, None, :] * self.code[None] * self.scale
        return (np.logaddexp(0, -m) * self.trust).sum(axis=2)

    def predict(self, arr: pa.Array) -> dict[str, np.ndarray]:
        data, offsets = string_buffers(arr)
        lettered = has_letter(arr, data, offsets)
        n = len(lettered)
        if not self.languages:
            return {"which": np.full(n, -1), "score": np.zeros(n), "ambiguous": np.zeros(n, bool)}
        if len(self.languages) == 1:
            return {"which": np.where(lettered, 0, -1), "score": lettered.astype(float), "ambiguous": np.zeros(n, bool)}
        loss = self.losses(means(*grams(data, offsets), self.weights))
        which = loss.argmin(axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        score = p.max(axis=1) / p.sum(axis=1)
        return {"which": np.where(lettered, which, -1), "score": np.where(lettered, score, 0.0), "ambiguous": lettered & (score < 0.6)}

    def annotate(self, arr: pa.Array) -> dict[str, pa.Array]:
        out = self.predict(arr)
        names = np.array([*self.languages, UNKNOWN], dtype=object)
        return {"lang_pred": pa.array(names[out["which"]], pa.string()), "score": pa.array(out["score"], pa.float64()), "ambiguous": pa.array(out["ambiguous"])}


def has_letter(arr: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def train(texts: list[str], langs: list[str], pieces: int = 400) -> Model:
    """Naive Bayes log odds for each bit, with languages weighted alike; trust from texts left out."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((len(names), 0)), np.zeros((0, 1)), np.zeros(0), 1.0)
    y = np.array([names.index(x) for x in langs])
    code = codewords(len(names))
    counts = np.zeros((2, len(names), 1 << BITS))
    for i, t in enumerate(texts):
        ids, (lo, hi) = grams(*string_buffers(pa.array([t], pa.large_string())))
        # A long text counts as ``pieces`` words at most: it is one vote more than a short one, not a thousand.
        share = min(1.0, 6 * pieces / (hi - lo))
        for x in ids:
            counts[int(i % 5 == 0), y[i]] += np.bincount(x[lo:hi], minlength=1 << BITS) * share

    def odds(c: np.ndarray) -> np.ndarray:
        share = c / np.maximum(c.sum(axis=1, keepdims=True), 1)
        floor = 0.25 / (1 << BITS)
        return np.stack([np.log(share[bit > 0].mean(axis=0) + floor) - np.log(share[bit < 0].mean(axis=0) + floor) for bit in code.T])

    part, left = odds(counts[0]), range(0, len(texts), 5)
    margins = np.concatenate([means(*grams(*string_buffers(pa.array([texts[i]], pa.large_string()))), part) for i in left])
    trust = np.maximum((np.sign(margins) == code[y[list(left)]]).mean(axis=0) - 0.5, 0.01)
    return Model(names, code, odds(counts.sum(axis=0)), trust / trust.sum(), 6.0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Train on about ``per_language`` rows of each language of ``labelled`` (rows with null lang or text are left out)."""
    rows, _ = stratified(labelled.where(F.col(text_col).isNotNull()), lang_col, per_language, id_col=id_col, text_col=text_col)
    return train([r[0] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score, ambiguous (the best codeword is hardly nearer than the next)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda arr: shared.value.annotate(arr), COLUMNS, id_col, text_col)


def identified_rows(docs: DataFrame, model: Model, text_col: str = "text", ambiguous: bool = True) -> DataFrame:
    """The rows of ``docs`` in a learned language: those without a letter go, and without ``ambiguous`` those of ambiguous prediction, too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sure(arr: pa.Array) -> np.ndarray:
        found = shared.value.predict(arr)
        return (found["which"] >= 0) & (~found["ambiguous"] | ambiguous)

    return keep_rows(docs, sure, text_col)
