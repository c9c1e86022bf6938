"""Exact substring deduplication: suffixes of repeated passages in sorted order, by deep-shallow sorting.

Every byte covered by a ``length``-byte string that also starts earlier (in a smaller
document, or earlier in the same one) is removed.

A suffix array of the whole corpus needs one machine; this one is dealt out.  The
suffix that starts at s goes by the anchor of its first ``length`` bytes: the leftmost k-gram
of least hash in them.  Equal strings have equal anchors, so all suffixes that agree in
``length`` bytes are sorted in the same task, and consecutive suffixes of one anchor
travel together as one stretch of text.

Exact copies of a smaller document go whole, by two hashes and the length of the text,
before anything of them is sorted.  Texts travel compressed, and once: both
joins with them read the same exchange.

1. Anchors of all texts.  Those seen once can't belong to a repeated string and go.
   An anchor seen twice in one chunk of texts is known to repeat: one row tells the
   others, and the rest of that chunk's rows are dealt out at random, so a frequent
   passage makes no large group.
2. Stretches of the anchors that are left.  Stretches that are identical within a chunk are removed at once
   but for the first; the others are dealt by anchor.  An anchor with very many stretches (counted on a share of
   the documents, which only decides how they are dealt) is dealt suffix by suffix, by a hash of the
   ``length`` bytes, again without those that are identical within a chunk.
3. Each task sorts the suffixes of its stretches (``suffixes.sort_suffixes``), and in each
   class of equal strings all but the first start are repeats.
4. Repeated starts become byte ranges, merged by document.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; rows that repeat id and text are one document,
each judged alike; rows that repeat only the id are ordered by a hash of their text; a null id comes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import cut
from .kernels import U64, Prefix, chunks, mix, string_buffers
from .suffixes import sort_suffixes

LENGTH, GRAM = 100, 20
#: Bytes of stretches that a task sorts at a time; a larger anchor is sorted whole.
SLICE = 1 << 20
#: Stretches of an anchor from which on it is dealt suffix by suffix, and what of them a sample should hold at least.
MOST, SEEN = 1 << 13, 1 << 9
#: Suffixes in one batch.
PORTION = 1 << 16


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, position, first start, last start, row) of each anchor's run of starts; positions are in the buffer."""
    z = np.zeros(0, np.int64)
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return z.astype(U64), z, z, z, z
    n = len(data)
    at = np.arange(n - k + 1)
    h = Prefix(data).of(at, at + k)
    least = h >> U64(32) << U64(32) | at.astype(U64)
    width = 1
    w = length - k + 1
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if w > width:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    at = (least & U64((1 << 32) - 1)).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    edge[offsets[rows]] += 1
    np.add.at(edge, offsets[rows + 1] - length + 1, -1)
    inside = np.cumsum(edge[: len(at)]) > 0
    starts = np.flatnonzero(inside)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    # Two documents that touch have different anchors: an anchor lies in its own window.
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    pos = at[head]
    return h[pos], pos, starts[head], starts[tail], np.searchsorted(offsets, starts[head], side="right") - 1


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is the first of its kind, number of its kind)."""
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    head = np.zeros(len(keys), bool)
    head[first] = True
    return head, count[inverse.reshape(-1)]


def anchor_rows(batches, length: int):
    """Rows (key, known, id, t, pos): see step 1.  Batches hold id, t, text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            data, offsets = string_buffers(part.column(2))
            h, pos, _, _, row = anchors(data, offsets, length)
            head, count = first_of_each(h)
            key = np.where(head, h, mix(h + pos.astype(U64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(count > 1), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((pos - offsets[row]).astype(np.int32))],
                names=["key", "known", "id", "t", "pos"],
            )


def repeated(batches):
    """Of rows sorted by key those that are known to repeat or share their key with others; gives id, t, pos."""
    kept_key, held = None, None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
            held = None
        if not batch.num_rows:
            continue
        key, known = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        number = np.cumsum(new) - 1
        good = np.bincount(number, weights=known) > 0
        good |= np.bincount(number) > 1
        if kept_key is not None and key[0] == kept_key:
            good[0] = True
        keep = good[number]
        if not keep[-1]:
            held = batch.slice(len(key) - 1, 1)
        kept_key = key[-1] if keep[-1] else None
        yield batch.filter(pa.array(keep)).select([2, 3, 4])


def anchor_counts(batches, length: int):
    """Rows (key, n): anchors and their stretches in a chunk; batches hold text."""
    for batch in batches:
        for part in chunks(batch, "text"):
            key, n = np.unique(anchors(*string_buffers(part.column(0)), length)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])


def hot_anchors(text: DataFrame, length: int, most: int = MOST) -> np.ndarray:
    """Hashes, in order, of the anchors with about ``most`` stretches or more, by a share of the documents; text holds id, t, text."""
    share = max(1, most // SEEN)
    part = text.where(F.pmod(F.xxhash64("id", "t"), F.lit(share)) == 0).select("text")
    counts = part.mapInArrow(lambda b: anchor_counts(b, length), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in counts.where(F.col("n") >= most // share).select("key").collect()], np.int64).view(U64))


def packed(batches):
    """id, t, z: the text compressed."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [press.compress((x.as_py() or "").encode()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["id", "t", "z"])


def unpacked(batches, rows: int = 512):
    """The batches with their third column as text again, some rows at a time."""
    open_ = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            text = pa.array([open_.decompress(x.as_py()).decode() for x in batch.column(2)], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, *batch.columns[3:]], names=["id", "t", "text", *batch.schema.names[3:]])


def stretches(batches, length: int, hot: np.ndarray):
    """Rows (key, text, id, t, lo, hi): starts lo..hi of a document with their text, or a removed run without; batches hold id, t, text, pos."""

    def rows(part: pa.RecordBatch, offsets: np.ndarray, key: np.ndarray, text: list[bytes | None], lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        gone = np.array([x is None for x in text], bool)
        key = np.where(gone, mix(key + lo.astype(U64)), key)
        at, base = pa.array(row), offsets[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(text, pa.binary()), part.column(0).take(at), part.column(1).take(at), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
            names=["key", "s", "id", "t", "lo", "hi"],
        )

    for batch in unpacked(batches):
        for part in chunks(batch, "text"):
            data, offsets = string_buffers(part.column(2))
            h, pos, lo, hi, row = anchors(data, offsets, length)
            if not len(h):
                continue
            lists = part.column(3)
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            wanted = owner.astype(np.int64) << 40 | np.asarray(lists.flatten()).astype(np.int64)
            pick = np.isin(row.astype(np.int64) << 40 | (pos - offsets[row]), wanted)
            h, pos, lo, hi, row = (x[pick] for x in (h, pos, lo, hi, row))
            raw = data.tobytes()
            text = [raw[a : b + length] for a, b in zip(lo, hi, strict=True)]
            order = rank_rows(part.column(0), part.column(1))
            base = offsets[row]
            by = np.lexsort((lo - base, order[row]))
            seen: dict[tuple[int, bytes], tuple[int, int]] = {}
            for i in by:
                place = int(order[row[i]]), int(lo[i] - base[i])
                earliest = seen.setdefault((int(pos[i] - lo[i]), text[i]), place)
                # At the same place again it is a repeated row, which keeps what the first keeps.
                if earliest != place:
                    text[i] = None
            split = np.isin(h, hot) & np.array([x is not None for x in text], bool)
            plain = np.flatnonzero(~split)
            yield rows(part, offsets, h[plain], [text[i] for i in plain], lo[plain], hi[plain], row[plain])
            if not split.any():
                continue
            first: dict[bytes, tuple[int, int]] = {}
            prefix = Prefix(data)
            # In order of place, so that the first of each kind is the earliest.
            for s, r in portions(*(x[by[split[by]]] for x in (lo, hi, row))):
                suffix: list[bytes | None] = [raw[a : a + length] for a in s.tolist()]
                places = zip(order[r].tolist(), (s - offsets[r]).tolist(), strict=True)
                if len(first) > 4 * PORTION:
                    # Memory is bounded; what is sent twice is compared again where it is sorted.
                    first.clear()
                for i, place in enumerate(places):
                    if first.setdefault(suffix[i], place) != place:
                        suffix[i] = None
                yield rows(part, offsets, mix(prefix.of(s, s + length)), suffix, s, s, r)


def portions(lo: np.ndarray, hi: np.ndarray, row: np.ndarray, size: int = PORTION):
    """(start, row) of every start of the stretches, about ``size`` at a time."""
    ends = np.cumsum(hi - lo + 1)
    at = 0
    while at < len(lo):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)), at + 1)
        n = hi[at:to] - lo[at:to] + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(lo[at:to], n) + nth, np.repeat(row[at:to], n)
        at = to


def rank_rows(ids: pa.Array, t: pa.Array) -> np.ndarray:
    """Rank of each row by (id, t), nulls first; equal rows share one."""
    if pa.types.is_integer(ids.type):
        a = ids.fill_null(0).cast(pa.int64()).to_numpy()
        null = ~np.asarray(ids.is_valid())
    else:
        held = [x.as_py() for x in ids]
        names = {x: i for i, x in enumerate(sorted({x for x in held if x is not None}))}
        a = np.array([names.get(x, 0) for x in held], np.int64)
        null = np.array([x is None for x in held], bool)
    b = t.to_numpy()
    by = np.lexsort((b, a, ~null))
    new = np.zeros(len(a), np.int64)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]) | (null[by][1:] != null[by][:-1])
    out = np.zeros(len(a), np.int64)
    out[by] = np.cumsum(new)
    return out


def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with 64-bit offsets: only so do columns of any size combine to one chunk."""
    large = {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}
    return batch.cast(pa.schema([f.with_type(large.get(f.type, f.type)) for f in batch.schema]))


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    (out,) = pa.Table.from_batches([wide(b) for b in batches]).combine_chunks().to_batches()
    return out


def repeats(batches, length: int, size: int = SLICE):
    """Removed ranges (id, t, start, end) from stretches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in map(wide, batches):
        direct = batch.filter(batch.column(1).is_null())
        if direct.num_rows:
            yield ranges(direct, np.asarray(direct.column(4)), np.asarray(direct.column(5)), np.arange(direct.num_rows), length)
        batch = batch.filter(batch.column(1).is_valid())
        start = 0
        while start < batch.num_rows:
            off = np.frombuffer(batch.column(1).buffers()[1], np.int64)[batch.column(1).offset + start : batch.column(1).offset + batch.num_rows + 1]
            stop = start + max(int(np.searchsorted(off, off[0] + size)), 1)
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            start = stop
            if sum(b.num_rows and b.column(1).nbytes for b in held) >= size:
                done, rest = split_last_key(held)
                held = rest
                if done is not None:
                    yield sort_slice(done, length)
    if held:
        yield sort_slice(joined(held), length)


def split_last_key(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
    """(rows of all keys but the last, the last key's rows): the last one may go on in the next batch."""
    if held[0].column(0)[0] == held[-1].column(0)[-1]:
        return None, held
    whole = joined(held)
    key = whole.column(0).to_numpy()
    cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
    return whole.slice(0, cut), [whole.slice(cut)]


def sort_slice(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    text = rows.column(1)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    count = np.diff(off) - length + 1
    owner = np.repeat(np.arange(len(text)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = off[owner] + nth
    order, group = sort_suffixes(data, starts, length)
    doc = rank_rows(rows.column(2), rows.column(3))[owner]
    place = doc << 40 | np.asarray(rows.column(4)).astype(np.int64)[owner] + nth
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    earliest = np.minimum.reduceat(place[order], heads)
    later = np.zeros(len(owner), bool)
    later[order] = place[order] > earliest[group]
    at = np.flatnonzero(later)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(at) else head
    of = owner[at[head]]
    base = np.asarray(rows.column(4)).astype(np.int64)[of]
    return ranges(rows, base + nth[at[head]], base + nth[at[tail]], of, length)


def ranges(rows: pa.RecordBatch, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, length: int) -> pa.RecordBatch:
    pick = pa.array(of, pa.int64())
    ids = rows.column(2).take(pick)
    if pa.types.is_large_string(ids.type):
        ids = ids.cast(pa.string())
    elif pa.types.is_large_binary(ids.type):
        ids = ids.cast(pa.binary())
    return pa.RecordBatch.from_arrays([ids, rows.column(3).take(pick), pa.array(lo.astype(np.int32)), pa.array((hi + length).astype(np.int32))], names=["id", "t", "start", "end"])


def kept(batches):
    """Rows (id, n_bytes, spans, kept bytes' digest) from id, t, text, ranges."""
    for batch in unpacked(batches):
        spans, digest, sizes = [], [], []
        for text, own in zip(batch.column(2), batch.column(3), strict=True):
            raw = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for r in sorted((x["start"], x["end"]) for x in own.as_py() or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            at, out = 0, hashlib.sha256()
            for a, b in merged:
                out.update(raw[at:a])
                at = b
            out.update(raw[at:])
            spans.append(merged)
            digest.append(out.hexdigest())
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(digest)], names=["id", "n_bytes", "spans", "kept_sha256"])


def copied(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """id, t, n (bytes) of the documents of at least ``length`` bytes whose whole text is that of a smaller document."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.xxhash64(F.lit(length), text_col).alias("t2"), F.octet_length(text_col).alias("n")).where(F.col("n") >= length)
    # Written first: then both sides of the join are plain exchanges, and adaptive execution splits a large group of copies.
    first = cut(rows.groupBy("t", "t2", "n").agg(F.min(F.struct("id")).alias("a"), F.max(F.struct("id")).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).drop("b"))
    return rows.join(first, ["t", "t2", "n"]).where(~F.struct("id").eqNullSafe(F.col("a"))).select("id", "t", "n").distinct()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """Per document: id, n_bytes, spans (removed [from, to) byte ranges, merged), kept_sha256.

    most: stretches of an anchor from which on it is dealt suffix by suffix; the result is the same with any.
    """
    kind = docs.schema[id_col].dataType
    ident = [T.StructField("id", kind), T.StructField("t", T.LongType())]

    def fields(*more: tuple[str, T.DataType]) -> list[T.StructField]:
        return [T.StructField(k, v) for k, v in more]

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    seen = text.mapInArrow(lambda b: anchor_rows(b, length), T.StructType([*fields(("key", T.LongType()), ("known", T.BooleanType())), *ident, *fields(("pos", T.IntegerType()))]))
    again = seen.repartition("key").sortWithinPartitions("key").mapInArrow(repeated, T.StructType([*ident, *fields(("pos", T.IntegerType()))]))
    copies = copied(docs, id_col, text_col, length)
    places = again.groupBy("id", "t").agg(F.collect_set("pos").alias("pos"))
    named = places.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "pos")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    named = named.join(copies.select("id", "t"), same, "left_anti")
    # t is declared without nulls: else one of the joins would filter it, and their exchanges would differ.
    bodies = text.mapInArrow(packed, T.StructType([ident[0], T.StructField("t", T.LongType(), False), *fields(("z", T.BinaryType()))]))
    found = bodies.join(named, same).select("id", "t", "z", "pos")
    hot = hot_anchors(text, length, most)
    pieces = found.mapInArrow(lambda b: stretches(b, length, hot), T.StructType([*fields(("key", T.LongType()), ("s", T.BinaryType())), *ident, *fields(("lo", T.IntegerType()), ("hi", T.IntegerType()))]))
    gone = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: repeats(b, length), T.StructType([*ident, *fields(("start", T.IntegerType()), ("end", T.IntegerType()))]))
    gone = gone.union(copies.select("id", "t", F.lit(0).alias("start"), F.col("n").alias("end")))
    by_doc = gone.groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("own")).select(F.col("id").alias("_id"), F.col("t").alias("_t"), "own")
    whole = bodies.join(by_doc, same, "left").select("id", "t", "z", "own")
    out = T.StructType([T.StructField("id", kind), *fields(("n_bytes", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), ("kept_sha256", T.StringType()))])
    return whole.mapInArrow(kept, out).withColumnRenamed("id", id_col)
