"""Exact top-k search by multi-resolution segment statistics.

Each vector is summarised at several resolutions by the mean and the deviation of
each of its segments.  For two vectors,

    <q, c>  <=  sum over segments of  m * mean_q * mean_c + dev_q * dev_c

(dev: length of the segment minus its mean), that is |q|^2 + |c|^2 - 2 * bound is
a lower bound on their squared distance.  Bounds are computed coarse to fine;
whatever can't reach a query's k-th best score so far is left out of the finer
levels, and survivors get their exact integer inner product.  The first k-th best
score comes from the queries' scores among themselves, which are candidates, too.

The query set is read in blocks of at most ``block`` vectors, one after the other: a block is
broadcast to a scan of all rows, its best rows are written, and its broadcast is destroyed
before the next one is read.  A task keeps k rows for each query of the block, so memory
doesn't follow the input.

Scores are of floor(scale * x), computed exactly.  Defined cases: a vector that is
null or holds null or a non-finite component takes no part; vectors of different
lengths aren't compared; rows with the query's own id are its own and never its
candidates; of queries that repeat an id the smallest valid vector counts; candidates
that repeat an id are rows of their own; ties go to the smaller id; scores beyond
64 bits are cut to the largest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut

SEGMENTS = (1, 4, 16)
BLOCK = 8192
_EXACT = float(1 << 52)
#: Share of pairs left up to which they are bounded one by one, and pairs at a time.
DENSE, PAIRS = 0.05, 1 << 14


def rows_of(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * vectors) as float64) by length of the vectors; invalid ones are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False)), np.asarray(ids.is_valid())
    off = np.asarray(vectors.offsets)
    flat = vectors.values
    missing = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
    values = np.floor(scale * flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(values))])
    good = np.asarray(vectors.is_valid()) & (bad[off[1:]] == bad[off[:-1]]) & ids[1]
    size = np.diff(off)
    for d in np.unique(size[good]):
        at = np.flatnonzero(good & (size == d))
        yield ids[0][at], values[off[at][:, None] + np.arange(d)].reshape(len(at), d)


def bounds_features(x: np.ndarray, segments: int) -> np.ndarray:
    """[n, 2 * segments]: the product of two rows bounds the vectors' inner product from above."""
    parts = [p for p in np.array_split(np.arange(x.shape[1]), segments) if len(p)]
    out = np.zeros((len(x), 2 * len(parts)))
    for j, p in enumerate(parts):
        mean = x[:, p].mean(axis=1)
        out[:, 2 * j] = mean * math.sqrt(len(p))
        out[:, 2 * j + 1] = np.sqrt(((x[:, p] - mean[:, None]) ** 2).sum(axis=1))
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as float64."""
    top = np.sqrt((q**2).sum(axis=1)).max(initial=0) * np.sqrt((c**2).sum(axis=1)).max(initial=0)
    if top < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in c], dtype=object).reshape(c.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def pair_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``q`` with those of ``c`` beside them."""
    top = np.sqrt((q**2).sum(axis=1)).max(initial=0) * np.sqrt((c**2).sum(axis=1)).max(initial=0)
    if top < _EXACT:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)]
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in whole], dtype=np.int64)


class Queries:
    """A block of query vectors of one length, with their best rows so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [s for s in SEGMENTS if s <= x.shape[1]]
        self.features = {s: bounds_features(x, s) for s in self.levels}
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        some = x[: 4 * 512]
        if len(some) > k:
            own = products(x, some)
            own[np.arange(len(some)), np.arange(len(some))] = np.iinfo(np.int64).min
            self.least = np.sort(own, axis=1)[:, -k]
        #: Pairs offered, and those of them whose exact score was computed.
        self.pairs = self.compared = 0
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def offer(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Merge candidates into the best rows."""
        rows, live = np.arange(len(self.ids)), np.arange(len(ids))
        self.pairs += len(rows) * len(live)
        alive = np.ones((len(rows), len(live)), bool)
        levels = list(self.levels)
        while levels and alive.sum() > DENSE * alive.size:
            s = levels.pop(0)
            alive &= self.reaches(self.features[s][rows] @ bounds_features(c[live], s).T, self.least[rows][:, None])
            r, l = alive.any(axis=1), alive.any(axis=0)
            rows, live, alive = rows[r], live[l], alive[np.ix_(r, l)]
            if not len(live):
                return
        if alive.sum() > DENSE * alive.size:
            self.compared += alive.size
            scores = products(self.x[rows], c[live])
            for n, r in enumerate(rows):
                self.merge(r, ids[live[alive[n]]], scores[n][alive[n]])
            return
        # Few pairs are left: each is bounded and compared on its own.
        i, j = np.nonzero(alive)
        i, j = rows[i], live[j]
        for s in levels:
            own = bounds_features(c, s)
            fit = np.concatenate([self.reaches(np.einsum("ij,ij->i", self.features[s][i[at : at + PAIRS]], own[j[at : at + PAIRS]]), self.least[i[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
            i, j = i[fit], j[fit]
        self.compared += len(i)
        scores = np.concatenate([pair_products(self.x[i[at : at + PAIRS]], c[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
        ends = np.searchsorted(i, np.arange(len(self.ids) + 1))
        for r in np.unique(i):
            own = slice(ends[r], ends[r + 1])
            self.merge(r, ids[j[own]], scores[own])

    @staticmethod
    def reaches(high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a bound, with room for its rounding, reaches the least score that still counts."""
        return high + np.abs(high) * 1e-9 + 1 >= least

    def merge(self, r: int, names: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.least[r]) & (names != self.ids[r])
        if fit.any():
            v, s = np.concatenate([self.best[r][0], names[fit]]), np.concatenate([self.best[r][1], scores[fit]])
            order = np.lexsort((v, ~s))[: self.k]
            self.best[r] = v[order], s[order]
            if len(order) == self.k:
                self.least[r] = max(self.least[r], s[order[-1]])


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block: int = BLOCK) -> DataFrame:
    """Each query's k rows of highest score: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    unfit = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = vectors.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    asked = asked.where(F.col("v").isNotNull() & ~unfit).groupBy("i").agg(F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = "query_id long, rank int, vec_id long, score long"
    found = spark.createDataFrame([], out)
    for held in query_blocks(asked, block):
        shared = spark.sparkContext.broadcast(held)
        best = rows.mapInArrow(lambda batches, b=shared: scan(batches, b.value, k, scale), "query_id long, vec_id long, score long")
        best = cut(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        shared.destroy()
        found = found.union(best)
    return found


def query_blocks(asked: DataFrame, block: int) -> Iterator[pa.Table]:
    held: list[tuple] = []
    for r in asked.toLocalIterator():
        held.append((r.i, r.v))
        if len(held) == block:
            yield pa.table({"i": pa.array([x[0] for x in held], pa.int64()), "v": pa.array([x[1] for x in held], pa.list_(pa.float64()))})
            held = []
    if held:
        yield pa.table({"i": pa.array([x[0] for x in held], pa.int64()), "v": pa.array([x[1] for x in held], pa.list_(pa.float64()))})


def scan(batches, held: pa.Table, k: int, scale: float):
    asked = {x.shape[1]: Queries(ids, x, k) for ids, x in rows_of(held["i"].combine_chunks(), held["v"], scale)}
    for batch in batches:
        for ids, c in rows_of(batch.column(0), batch.column(1), scale):
            if q := asked.get(c.shape[1]):
                for at in range(0, len(ids), 2048):
                    q.offer(ids[at : at + 2048], c[at : at + 2048])
    for q in asked.values():
        sizes = [len(v) for v, _ in q.best]
        if sum(sizes):
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q.ids, sizes), "vec_id": np.concatenate([v for v, _ in q.best]), "score": np.concatenate([s for _, s in q.best])})
