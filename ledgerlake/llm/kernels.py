"""Byte-level text kernels over Arrow batches.

A batch's texts are one UTF-8 buffer plus offsets, and every kernel works on
the whole buffer at once with numpy: word boundaries from a 256-entry table,
word hashes from a prefix polynomial modulo 2**64.  Batches are cut into chunks
of about ``CHUNK`` bytes, so memory follows the chunk and not the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = ascii_lower()


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the (inclusive) ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Digits, ASCII letters and every byte of a non-ASCII character.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    size = 1 << max(12, int(n).bit_length())
    return _powers(size, base)[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(_BASE, -1, 1 << 64))


class Prefix:
    """Hashes of any substrings of a buffer from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(n), out=self.sums[1:])
        self.inverse = inverse_powers(n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``size`` text bytes; a longer text is a slice of its own."""
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_chunks(texts: list[str], size: int = CHUNK) -> Iterator[pa.Array]:
    """The texts as arrays of about ``size`` bytes."""
    for part in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())}), "text", size):
        yield part.column(0)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of true bytes; runs don't cross rows."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edges = offsets[:-1][np.diff(offsets) > 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD):
    return spans(table[data], offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ordered hashes of every ``n`` consecutive hashes (without regard to rows)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    acc = np.zeros(m, U64)
    for j in range(n):
        acc = acc * U64(_BASE) + hashes[j : j + m]
    return mix(acc)


def per_batch(spark_df, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text"):
    """mapInArrow of ``fn`` over chunks; ``fn`` gets a slice of rows and returns rows."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return spark_df.mapInArrow(run, schema)


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo ``m``, as a Column (null id: crc32 of the empty string, 0)."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def annotate(df, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], columns, id_col: str = "doc_id", text_col: str = "text"):
    """One row a document: its id and what ``fn`` computes from the texts of a slice of rows.

    Only id and text are read, so other columns of ``df`` can't clash.
    columns: the StructFields that ``fn`` gives.
    """
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *columns])
    names = [f.name for f in columns]

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        out = fn(part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), *(out[k] for k in names)], names=[id_col, *names])

    return per_batch(df.select(id_col, text_col), one, schema, text_col)


def keep_rows(df, fn: Callable[[pa.Array], np.ndarray], text_col: str = "text"):
    """The rows of ``df``, with all their columns, for whose text ``fn`` says true."""
    k = df.columns.index(text_col)
    return per_batch(df, lambda part: part.filter(pa.array(fn(part.column(k)))), df.schema, text_col)
