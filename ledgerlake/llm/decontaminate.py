"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words, the ``window - k + 1`` k-grams compete and
the one of least hash is kept as a fingerprint, in documents and in benchmark
items alike.  A span of ``window`` words that both hold therefore leaves the same
fingerprint in both: joining fingerprints misses no such span.  Each joined
fingerprint is extended to the windows that contain it, and those are compared
word by word, so hash collisions don't count either.

Items shorter than ``window`` are one window of their own length; for each of the
at most ``window - 1`` such lengths every gram of that length is a fingerprint.

A benchmark of at most ``block_bytes`` of ids and text (summed before) is one broadcast, and the
join is a lookup in it.  A larger one is never on one machine: its fingerprints and
windows are tables, joined with those of the texts by shuffles; copies of a
text are extended once.  Both ways give the same rows.

Defined cases: null or empty text has no words (0, 0, no items, clean); repeated
items count once per item_id; an item_id of null counts as the item ""; rows that
repeat a doc_id or have none are judged each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import cut
from .kernels import LOWER, Prefix, annotate, chunks, keep_rows, ngrams, string_buffers, word_spans

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 16 << 20

COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
]


def words_of(arr: pa.Array):
    """Lower-cased bytes, word starts and ends, row of each word, word hashes, number of rows."""
    data, offsets = string_buffers(arr)
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    return data, starts, ends, row, Prefix(data).of(starts, ends), len(offsets) - 1


def winnow(grams: np.ndarray, row: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the fingerprints: the leftmost least k-gram of each window inside one row."""
    w = window - k + 1
    if len(grams) < w:
        return np.zeros(0, np.int64)
    whole = row[: len(grams) - w + 1] == row[window - 1 :]
    at = np.lib.stride_tricks.sliding_window_view(grams, w).argmin(axis=1) + np.arange(len(whole))
    return np.unique(at[whole])


class Block:
    """The fingerprints and windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, k: int = GRAM):
        self.window, self.k = window, k
        ids = sorted({i for i, _ in items})
        rank = {x: n for n, x in enumerate(ids)}
        self.ids = ids
        data, starts, ends, row, h, n = words_of(pa.array([t for _, t in items], pa.large_string()))
        count = np.bincount(row, minlength=n)
        begin = np.concatenate([[0], np.cumsum(count)])
        owner = np.array([rank[i] for i, _ in items], dtype=np.int64)
        raw = data.tobytes()
        self.prints = np.zeros(0, np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, list[bytes]]] = {}
        lengths = sorted({int(min(c, window)) for c in count if c})
        for size in lengths:
            grams = ngrams(h, size)
            at = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
            of = row[at]
            fit = count[of] >= window if size == window else (count[of] == size) & (begin[of] == at)
            at, of = at[fit], of[fit]
            order = np.argsort(grams[at], kind="stable")
            at, of = at[order], of[order]
            text = [b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + size)) for i in at]
            self.tables[size] = grams[at], owner[of], text
            if size == window:
                five = ngrams(h, k)
                self.prints = np.unique(five[winnow(five, row, window, k)])

    def candidates(self, h: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
        """Word positions at which a window of ``size`` may occur."""
        if len(h) < size:
            return np.zeros(0, np.int64)
        if size < self.window:
            at = np.arange(len(h) - size + 1)
        else:
            grams = ngrams(h, self.k)
            marks = winnow(grams, row, self.window, self.k)
            marks = marks[member(self.prints, grams[marks])]
            at = np.unique(marks[:, None] - np.arange(self.window - self.k + 1))
            at = at[(at >= 0) & (at <= len(h) - size)]
        return at[row[at] == row[at + size - 1]]

    def find(self, arr: pa.Array):
        """(row of each word, rows, hit flag of each word, items by row)."""
        data, starts, ends, row, h, n = words_of(arr)
        cover = np.zeros(len(h) + 1, np.int32)
        found: dict[int, set[int]] = {}
        for size, (keys, owner, text) in self.tables.items():
            at = self.candidates(h, row, size)
            if not len(at):
                continue
            acc = gram_at(h, at, size)
            lo, hi = np.searchsorted(keys, acc, "left"), np.searchsorted(keys, acc, "right")
            for j in np.flatnonzero(hi > lo):
                i = at[j]
                own = b" ".join(data[starts[x] : ends[x]].tobytes() for x in range(i, i + size))
                same = [m for m in range(lo[j], hi[j]) if text[m] == own]
                if same:
                    cover[i] += 1
                    cover[i + size] -= 1
                    found.setdefault(int(row[i]), set()).update(int(owner[m]) for m in same)
        return row, n, np.cumsum(cover[:-1]) > 0, found


def judged(arr: pa.Array, held: Block) -> dict[str, pa.Array]:
    """The columns of each text."""
    row, n, hit, found = held.find(arr)
    n_words = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    spans: list[list[list[int]]] = [[] for _ in range(n)]
    for r in found:
        spans[r] = runs(hit[first[r] : first[r + 1]])
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(np.bincount(row[hit], minlength=n), pa.int64()),
        "item_ids": pa.array([sorted(held.ids[x] for x in found.get(r, ())) for r in range(n)], pa.list_(pa.string())),
        "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
    }


def runs(flags: np.ndarray) -> list[list[int]]:
    """[from, to) of the maximal runs of true flags."""
    edge = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(edge[1:] != edge[:-1]).reshape(-1, 2).tolist()


def member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


def gram_at(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """ngrams() at some positions only."""
    return ngrams(h[at[:, None] + np.arange(size)].reshape(-1), size)[::size] if len(at) else np.zeros(0, np.uint64)


def small(items: DataFrame, block_bytes: int) -> Block | None:
    """The items as one block, if they have at most ``block_bytes`` of ids and text; items: i, t."""
    if (items.agg(F.sum(F.octet_length("i") + F.octet_length("t")).alias("n")).first().n or 0) > block_bytes:
        return None
    return Block([(r.i, r.t) for r in items.collect()])


def item_rows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def item_windows(batches, window: int, k: int):
    """Rows (size, w, fp, i): the windows of the items with their text, and their fingerprints without; batches hold i, t."""
    for batch in batches:
        for part in chunks(batch, "t"):
            block = Block(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), window, k)
            for size, (keys, owner, text) in block.tables.items():
                prints = block.prints if size == window else np.unique(keys)
                n = len(prints)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(text) + n, size), pa.int32()),
                        pa.array([*text, *[None] * n], pa.binary()),
                        pa.concat_arrays([pa.nulls(len(text), pa.int64()), pa.array(prints.view(np.int64))]),
                        pa.array([*(block.ids[x] for x in owner), *[None] * n], pa.string()),
                    ],
                    names=["size", "w", "fp", "i"],
                )


def doc_prints(batches, sizes: list[int], window: int, k: int):
    """Rows (size, fp, t1, t2, pos): the fingerprints of the texts; batches hold t1, t2, text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            _, _, _, row, h, _ = words_of(part.column(2))
            for size in sizes:
                grams = ngrams(h, k if size == window else size)
                at = winnow(grams, row, window, k) if size == window else np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
                of = row[at]
                place = at - np.searchsorted(row, of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size), pa.int32()), pa.array(grams[at].view(np.int64)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(place, pa.int32())],
                    names=["size", "fp", "t1", "t2", "pos"],
                )


def extended(batches, window: int, k: int):
    """Rows (size, w, t1, t2, at): the windows around joined fingerprints; batches hold t1, t2, text, marks (size, pos)."""
    for batch in batches:
        for part in chunks(batch, "text"):
            data, starts, ends, row, _, n = words_of(part.column(2))
            count = np.bincount(row, minlength=n)
            first = np.concatenate([[0], np.cumsum(count)])
            size, text, owner, place = [], [], [], []
            for r, marks in enumerate(part.column(3).to_pylist()):
                near = {(m["size"], m["pos"] - j) for m in marks for j in range(window - k + 1 if m["size"] == window else 1)}
                for s, i in sorted(x for x in near if 0 <= x[1] <= count[r] - x[0]):
                    j = first[r] + i
                    size.append(s)
                    text.append(b" ".join(data[starts[x] : ends[x]].tobytes() for x in range(j, j + s)))
                    owner.append(r)
                    place.append(i)
            of = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(text, pa.binary()), part.column(0).take(of), part.column(1).take(of), pa.array(place, pa.int32())], names=["size", "w", "t1", "t2", "at"])


def joined_hits(texts: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """t1, t2, items, hits (at, size) of the texts that hold a window; texts: t1, t2, text."""
    own = cut(items.mapInArrow(lambda b: item_windows(b, window, k), "size int, w binary, fp long, i string"))
    sizes = sorted(r.size for r in own.select("size").distinct().collect())
    prints = cut(own.where("fp IS NOT NULL").select("size", "fp").distinct())
    seen = texts.mapInArrow(lambda b: doc_prints(b, sizes, window, k), "size int, fp long, t1 long, t2 long, pos int")
    marks = seen.join(prints, ["size", "fp"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("size", "pos")).alias("marks"))
    # Copies are extended once: only their first text travels on.
    held = texts.join(marks.select("t1", "t2"), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text")).join(marks, ["t1", "t2"])
    near = held.select("t1", "t2", "text", "marks").mapInArrow(lambda b: extended(b, window, k), "size int, w binary, t1 long, t2 long, at int")
    hits = near.join(own.where("w IS NOT NULL").select("size", "w", "i").distinct(), ["size", "w"])
    return hits.groupBy("t1", "t2").agg(F.collect_set("i").alias("items"), F.collect_set(F.struct("at", "size")).alias("hits"))


def hit_rows(batches):
    """Rows (id, n_words, n_hit, item_ids, spans) of batches of id, text, items, hits."""
    for batch in batches:
        for part in chunks(batch, "text"):
            _, _, _, row, _, n = words_of(part.column(1))
            n_words = np.bincount(row, minlength=n)
            n_hit, spans = np.zeros(n, np.int64), []
            for r, hits in enumerate(part.column(3).to_pylist()):
                cover = np.zeros(n_words[r] + 1, np.int32)
                for x in hits or ():
                    cover[x["at"]] += 1
                    cover[x["at"] + x["size"]] -= 1
                flags = np.cumsum(cover[:-1]) > 0
                n_hit[r] = flags.sum()
                spans.append(runs(flags))
            items = pa.array([sorted(x or ()) for x in part.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit), items, pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["id", *(c.name for c in COLUMNS)])


def text_keys(text_col: str) -> list:
    return [F.xxhash64(F.lit(i), text_col).alias(f"t{i}") for i in (1, 2)]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside a shared window), item_ids, spans ([from, to) word positions)."""
    items = item_rows(benchmark, item_col, item_text_col)
    block = small(items, block_bytes)
    if block is not None:
        held = docs.sparkSession.sparkContext.broadcast(block)
        return annotate(docs, lambda arr: judged(arr, held.value), COLUMNS, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *text_keys(text_col))
    found = joined_hits(rows.select("t1", "t2", "text"), items, window, k)
    both = rows.join(found, ["t1", "t2"], "left").select("id", "text", "items", "hits")
    return both.mapInArrow(hit_rows, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *COLUMNS])).withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` of which no word is in a window shared with the benchmark."""
    items = item_rows(benchmark, item_col, item_text_col)
    block = small(items, block_bytes)
    if block is None:
        found = joined_hits(docs.select(*text_keys(text_col), F.col(text_col).alias("text")), items, WINDOW, GRAM).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
        keys = text_keys(text_col)
        return docs.join(found, (keys[0] == found["_t1"]) & (keys[1] == found["_t2"]), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(block)

    def clean(arr: pa.Array) -> np.ndarray:
        row, n, hit, _ = held.value.find(arr)
        return np.bincount(row[hit], minlength=n) == 0

    return keep_rows(docs, clean, text_col)
