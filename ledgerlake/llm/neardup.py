"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its 5-word shingles with their numbers of occurrences.
An element of weight w, any positive number, owns the region [0, w) of the (weight, rank) plane, and every
unit cell of the plane holds a Poisson number of darts, each at a place of its own, that depend on the element
and the cell alone.  A signature coordinate is the dart of least rank among those
that fall into the document's regions and carry that coordinate's number, so two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.
Only ranks up to about k ln k / total weight are thrown, which makes a signature cost
words + k log k and not words * k; documents that still miss a coordinate are thrown on.

1. Texts of the same words are one node (map-side aggregation; copies never meet again).
2. Nodes with a common band (``rows`` coordinates alike) meet in a bucket.  Each
   member is compared with the bucket's most central member, and links give components.
3. In buckets with members of several components, the pairs across components that were not
   compared yet are, so no link between candidates is lost.
4. In a bucket of more than ``CROWD`` nodes most such pairs can't be links, and an exact count
   says so before they meet.  Two nodes that share a strip of at most ``RARE`` crowded nodes
   are paired by that strip, a short list.  Two that share none have at most as many strips in
   common as either has frequent ones, and a link of n and m strips needs t / (1 + t) * (n + m).
   Copies with many edits of their own fall under that against everyone, so a large group of near copies
   doesn't cost its square.
5. Every comparison is exact on the documents' shingles.

Defined cases: words are those of ``kernels.WORD``, A-Z lower-cased; a text of one to
four words is one shingle; null and empty texts and texts without a word are each alone; rows that repeat a
doc_id are one document of several texts, which links them; rows with a null doc_id
take no part and have a null class.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components, cut
from .kernels import LOWER, U64, Prefix, annotate, mix, ngrams, powers, string_buffers, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 all bands miss with probability (1 - 0.8**5)**24 < 0.0001.
BANDS, ROWS = 24, 5
#: Nodes in a bucket from which on pairs are counted out before they are made; nodes that hold a strip at which those that share it are paired directly.
CROWD, RARE = 64, 8
#: Strips held at a time, and the least number of parts that strips and nodes are dealt to.
MANY, LEAST_PARTS = 1 << 22, 64

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_STEP = U64(0xD1B54A32D192ED03)


def weighted(arr: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle of each row, sorted in each row; its number of occurrences; row of each; two hashes of each row's words; words of each row)."""
    data, offsets = string_buffers(arr)
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    h = Prefix(data).of(starts, ends)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    whole = np.zeros((n, 2), dtype=U64)
    some = np.flatnonzero(count)
    if len(some):
        p = powers(int(count.max()) + 1)[np.arange(len(h)) - first[row]]
        whole[some, 0] = np.add.reduceat(h * p, first[some])
        whole[some, 1] = np.add.reduceat(mix(h + _STEP) * (p * p), first[some])
        whole = mix(whole + count.astype(U64)[:, None])
    grams = ngrams(h, shingle)
    at = np.flatnonzero(row[: len(grams)] == row[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < shingle))
    g, r = np.concatenate([grams[at], whole[short, 0]]), np.concatenate([row[at], short])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    run = np.flatnonzero(new)
    return g[run], np.diff(np.append(run, len(g))), r[run], whole, count


def columns(g: np.ndarray, weight: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit columns [c, c + 1) of the elements' regions that their weights reach into: (hash, row, how much of the column is inside)."""
    n = np.ceil(weight).astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(g, n) + nth.astype(U64) * _STEP), np.repeat(row, n), np.minimum(np.repeat(weight, n) - nth, 1.0)


def elements(arr: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit strips: hash of shingle and occurrence, sorted in each row; row of each; two hashes of each row's words; words of each row)."""
    g, weight, row, whole, count = weighted(arr, shingle)
    u, r, _ = columns(g, weight, row)
    order = np.lexsort((u, r))
    return u[order], r[order], whole, count


def darts(u: np.ndarray, row: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """[n, k] signatures of the rows that have elements; other rows are 0.

    weight: of each element, any positive number (1 if None).  An element's region is [0, weight) of the weight axis:
    darts are thrown at the unit columns it reaches into, and those that fall beyond it are not its own.
    """
    inside = None
    if weight is not None:
        u, row, inside = columns(u, np.asarray(weight, float), row)
        if (inside == 1.0).all():
            inside = None
    total = np.bincount(row, weights=inside, minlength=n)
    out = np.zeros((n, k), dtype=U64)
    reach = k * (math.log(k) + 3) / np.maximum(total, 1e-9)
    todo = total > 0
    while todo.any():
        pick = todo[row]
        e, r = u[pick], row[pick]
        cells = np.ceil(reach[r]).astype(np.int64)
        i = np.repeat(np.arange(len(e)), cells)
        cell = np.arange(len(i)) - np.repeat(np.cumsum(cells) - cells, cells)
        v = mix(e[i] + cell.astype(U64) * _STEP)
        thrown = np.searchsorted(_POISSON, (v >> U64(11)) * 2.0**-53, side="right")
        j = np.repeat(np.arange(len(i)), thrown)
        nth = np.arange(len(j)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        w = mix(v[j] ^ ((nth + 1).astype(U64) * U64(0xA0761D6478BD642F)))
        rank = cell[j] + (w >> U64(11)) * 2.0**-53
        at = r[i[j]]
        near = rank <= reach[at]
        if inside is not None:
            across = (mix(w ^ _STEP) >> U64(11)) * 2.0**-53
            near &= across < inside[pick][i[j]]
        w, rank, at = mix(w[near]), rank[near], at[near]
        slot = at * k + (w % U64(k)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, w = slot[order], w[order]
        head = np.ones(len(slot), bool)
        head[1:] = slot[1:] != slot[:-1]
        full = np.bincount(slot[head] // k, minlength=n) == k
        done = full[slot // k] & head
        out.reshape(-1)[slot[done]] = w[done]
        todo &= ~full
        reach[todo] *= 2
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[n, bands] of band hashes that differ between bands."""
    out = np.zeros((len(signature), bands), dtype=U64)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, dtype=U64)
        for x in range(rows):
            acc = mix(acc + signature[:, b * rows + x])
        out[:, b] = acc
    return out


SKETCH = [T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def sketch(arr: pa.Array, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> dict[str, pa.Array]:
    g, weight, row, whole, count = weighted(arr, shingle)
    n = len(count)
    keys = bands_of(darts(g, row, n, bands * rows, weight), bands, rows).view(np.int64)
    return {
        "c1": pa.array(whole[:, 0].view(np.int64)),
        "c2": pa.array(np.ascontiguousarray(whole[:, 1]).view(np.int64)),
        "n_words": pa.array(count, pa.int32()),
        "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1))),
    }


def element_rows(arr: pa.Array) -> dict[str, pa.Array]:
    u, row, _, _ = elements(arr)
    ends = np.searchsorted(row, np.arange(len(arr) + 1))
    raw = u.astype(">u8").tobytes()
    return {"e": pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())}


def ranks(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each id in order, the distinct ids in order)."""
    coded = ids.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def slots(ids: pa.Array, n: int) -> np.ndarray:
    """A number below ``n`` for each id."""
    if pa.types.is_integer(ids.type):
        return (mix(ids.cast(pa.int64()).to_numpy().view(U64)) % U64(n)).astype(np.int64)
    return np.array([zlib.crc32(str(x).encode()) % n for x in ids.to_pylist()], np.int64)


def lists(keys: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs that begin at ``starts``."""
    return list(zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))


def strips(batches, n_ranges: int, rare: int = RARE):
    """Rows (part, x, node, often): the unit strips of some nodes, packed by ranges of x; batches hold node, e.

    A strip that more than ``rare`` nodes of these have is said to be frequent in ``often``, without its nodes.
    """
    for batch in batches:
        ends = np.cumsum([len(x.as_py()) // 8 for x in batch.column(1)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MANY // 4, side="right")))
            part, sizes = batch.slice(at, to - at), np.diff(np.append(ends[at - 1] if at else 0, ends[at:to]))
            ids, at = part.column(0), to
            x = np.frombuffer(b"".join(v.as_py() for v in part.column(1)), dtype=">u8").astype(U64)
            owner = np.repeat(np.arange(len(ids)), sizes)
            by = np.lexsort((owner, x))
            x, owner = x[by], owner[by]
            head = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(x)))
            often, few = x[head[count > rare]], np.repeat(count <= rare, count)
            x, owner = x[few], owner[few]
            # x is in order, and so are its ranges.
            cut_at = [0, *(((r << 64) // n_ranges) for r in range(1, n_ranges))]
            for r, (lo, hi) in enumerate(zip(cut_at, [*cut_at[1:], None], strict=True)):
                a, c = (np.searchsorted(v, U64(lo)) for v in (x, often))
                b, d = (np.searchsorted(v, U64(hi)) if hi is not None else len(v) for v in (x, often))
                if a < b or c < d:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r], pa.int64()),
                            pa.array([x[a:b].view(np.int64)], pa.list_(pa.int64())),
                            pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.take(pa.array(owner[a:b]))),
                            pa.array([often[c:d].view(np.int64)], pa.list_(pa.int64())),
                        ],
                        names=["part", "x", "node", "often"],
                    )


def one_range(batches, kind: pa.DataType, n_slots: int, rare: int = RARE):
    """Of each range the pairs (a, b) of nodes that share a strip of at most ``rare`` nodes, and how many such strips each node has, packed by slots of nodes.

    Batches hold rows of strips in order of part.  Strips that turn out to be frequent are dropped as the range is read, so memory
    follows the strips of few nodes.
    """
    empty = np.zeros(0, U64)
    part, xs, ids, often, held = None, [], [], [empty], 0

    def compact() -> tuple[np.ndarray, pa.Array, np.ndarray]:
        x = np.concatenate([empty, *xs])
        nodes = pa.concat_arrays([pa.array([], kind), *ids])
        known = np.unique(np.concatenate(often))
        order = np.argsort(x, kind="stable")
        x = x[order]
        head = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(x)))
        known = np.union1d(known, x[head[count > rare]])
        few = ~np.isin(x, known)
        return x[few], nodes.take(pa.array(order[few])), known

    def closed():
        x, nodes, _ = compact()
        if not len(x):
            return
        code, names = ranks(nodes)
        order = np.lexsort((code, x))
        x, code = x[order], code[order]
        slot = slots(names, n_slots)
        number = np.bincount(code, minlength=len(names))
        by = np.argsort(slot, kind="stable")
        runs = lists(slot[by], np.flatnonzero(np.append(True, slot[by][1:] != slot[by][:-1])))
        offsets = pa.array([0, *(to for _, _, to in runs)], pa.int32())
        none = pa.nulls(len(runs), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in runs], pa.int64()), pa.ListArray.from_arrays(offsets, names.take(pa.array(by))), pa.ListArray.from_arrays(offsets, pa.array(number[by])), none, none],
            names=["slot", "nodes", "counts", "a", "b"],
        )
        pairs = []
        for d in range(1, rare):
            both = x[d:] == x[:-d]
            both &= code[d:] != code[:-d]
            pairs.append(np.stack([code[:-d][both], code[d:][both]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        for at in range(0, len(pairs), 1 << 16):
            a, b = pairs[at : at + (1 << 16)].T
            n = len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.list_(pa.int64())), names.take(pa.array(a)), names.take(pa.array(b))], names=["slot", "nodes", "counts", "a", "b"]
            )

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if row.column(0)[0].as_py() != part:
                yield from closed()
                part, xs, ids, often, held = row.column(0)[0].as_py(), [], [], [empty], 0
            xs.append(row.column(1).flatten().to_numpy().view(U64))
            ids.append(row.column(2).flatten())
            often.append(row.column(3).flatten().to_numpy().view(U64))
            held += len(xs[-1])
            if held > MANY:
                x, nodes, known = compact()
                xs, ids, often, held = [x], [nodes], [known], 0
    yield from closed()


def added(batches, kind: pa.DataType):
    """Rows (node, own): the counts of each node added up; batches hold slot, nodes, counts in order of slot."""
    slot, ids, counts = None, [], []

    def closed():
        if ids:
            code, names = ranks(pa.concat_arrays(ids))
            total = np.bincount(code, weights=np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(total)], names=["node", "own"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if row.column(0)[0].as_py() != slot:
                yield from closed()
                slot, ids, counts = row.column(0)[0].as_py(), [], []
            ids.append(row.column(1).flatten())
            counts.append(row.column(2).flatten().to_numpy())
    yield from closed()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two documents' sorted unit strips."""
    x, y = np.frombuffer(a, dtype=">u8").astype(U64), np.frombuffer(b, dtype=">u8").astype(U64)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
    return both / max(len(x) + len(y) - both, 1)


def linked(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of at least this similarity; held: node, e."""
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("e").alias("ea")), "a").join(held.select(F.col("node").alias("b"), F.col("e").alias("eb")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            yield batch.select([0, 1]).filter(pa.array([similarity(x.as_py(), y.as_py()) >= least for x, y in zip(a, b, strict=True)], pa.bool_()))

    return both.select("a", "b", "ea", "eb").mapInArrow(run, both.select("a", "b").schema)


def can_link(least: float):
    """Whether the counts of two nodes that meet leave room for a link; counts hold in crowded buckets only."""
    return ~F.col("crowded") | (F.least("common", "common_b") * (1 + least) + 1e-6 >= (F.col("size") + F.col("size_b")) * least)


def candidates(meet: DataFrame, sizes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """key, node, crowded, root, size, common of the buckets that hold several components; without the nodes that no partner of theirs can be linked with."""
    placed = meet.select("key", "node", "crowded").join(found, "node", "left").select("key", "node", "crowded", F.coalesce("root", "node").alias("root")).join(sizes, "node", "left")
    placed = placed.where(~F.col("crowded") | (F.col("common") + 1e-6 >= F.col("size") * least))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    return cut(placed.join(mixed, "key"))


def more_leaders(meet: DataFrame, sizes: DataFrame, links: DataFrame, found: DataFrame, held: DataFrame, least: float, rounds: tuple[int, ...] = (3,)) -> tuple[DataFrame, DataFrame]:
    """Compare the members of buckets of several components with a few more leaders each, drawn by hash; gives all links and their components.

    A node that has links at all in a large group soon meets one of them, in some bucket; few are left for the comparison across components.
    """
    salt = 0
    for n in rounds:
        placed = candidates(meet, sizes, found, least)
        drawn = [F.min(F.struct(F.xxhash64("node", "key", F.lit(salt + j)), "node", "root", "size", "common")).alias(f"l{j}") for j in range(n)]
        salt += n
        leaders = placed.groupBy("key").agg(*drawn).select("key", F.explode(F.array_distinct(F.array(*(F.col(f"l{j}").dropFields("col1") for j in range(n))))).alias("l"))
        leaders = leaders.select("key", F.col("l.node").alias("b"), F.col("l.root").alias("root_b"), F.col("l.size").alias("size_b"), F.col("l.common").alias("common_b"))
        pairs = placed.join(leaders, "key").where((F.col("root") != F.col("root_b")) & can_link(least)).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        fresh = cut(linked(pairs, held, least))
        links = links.union(fresh)
        found = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(fresh))
    return links, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY) -> DataFrame:
    """Per document: id, cluster_id (the least id of its class), cluster_size (documents in it)."""
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    each = cut(annotate(known, lambda arr: sketch(arr, bands, rows), SKETCH, "_id", "_text"))
    worded = each.where("n_words > 0")
    nodes = cut(worded.groupBy("c1", "c2").agg(F.min("_id").alias("node"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words")))

    at = nodes.select("node", F.explode("bands").alias("key"))
    shared = at.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meet = at.join(shared, "key")
    central = meet.groupBy("node").agg(F.sum("n").alias("c"))
    meet = cut(meet.join(central, "node").select("key", "node", "c", (F.col("n") > CROWD).alias("crowded")).distinct())

    leader = meet.groupBy("key").agg(F.max(F.struct("c", "node")).getField("node").alias("b"))
    pairs = meet.join(leader, "key").where(F.col("node") != F.col("b")).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    pairs = cut(pairs)
    met = meet.select(F.col("node").alias("_id")).distinct()
    held = known.join(met, "_id", "left_semi").dropDuplicates(["_id", "_text"])
    held = cut(annotate(held, element_rows, [T.StructField("e", T.BinaryType())], "_id", "_text").withColumnRenamed("_id", "node"))
    links = cut(linked(pairs, held, least))

    found = connected_components(links)
    crowded = meet.where("crowded").select("node").distinct()
    kind = held.schema["node"].dataType
    size = F.greatest(F.col("n_words") - SHINGLE + 1, F.lit(1)).cast("long")
    sizes = cut(nodes.select("node", size.alias("size")).groupBy("node").agg(F.max("size").alias("size")).join(crowded, "node", "left_semi"))
    n_nodes, n_strips = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Ranges and slots grow with what they hold, so that each is a task's worth.
    n_ranges, n_slots = max(LEAST_PARTS, n_strips // (MANY // 8)), max(LEAST_PARTS, n_nodes // (MANY // 8))
    arrow = to_arrow_type(kind)
    packed = T.StructType([T.StructField("part", T.LongType()), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("node", T.ArrayType(kind)), T.StructField("often", T.ArrayType(T.LongType()))])
    each_strip = held.join(crowded, "node", "left_semi").mapInArrow(lambda b: strips(b, n_ranges), packed)
    listed = T.StructType([T.StructField("slot", T.LongType()), T.StructField("nodes", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("a", kind), T.StructField("b", kind)])
    ranged = cut(each_strip.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: one_range(b, arrow, n_slots), listed))
    counts = ranged.where("slot IS NOT NULL").select("slot", "nodes", "counts").repartition("slot").sortWithinPartitions("slot")
    own = counts.mapInArrow(lambda b: added(b, arrow), T.StructType([T.StructField("node", kind), T.StructField("own", T.LongType())]))
    few = ranged.where("slot IS NULL").select("a", "b").distinct()
    sizes = sizes.join(own, "node", "left")
    sizes = sizes.select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"))
    links, found = more_leaders(meet, sizes, links, found, held, least)
    placed = candidates(meet, sizes, found, least)
    other = placed.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("common").alias("common_b"))
    across = placed.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & can_link(least)).select(F.col("node").alias("a"), "b")
    of = found.select(F.col("node").alias("a"), F.col("root").alias("ra")), found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    few = few.join(of[0], "a", "left").join(of[1], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    across = across.union(few).distinct()
    more = cut(linked(across.join(pairs, ["a", "b"], "left_anti"), held, least))

    # Of a doc_id with several texts each text is a node of its own name or the name of a copy; its documents tie them.
    named = worded.select("_id", "c1", "c2").join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).select("_id", "node").distinct()
    ties = named.groupBy("_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("a", "b")
    roots = connected_components(links.union(more).union(ties))
    named = named.groupBy("_id").agg(F.min("node").alias("node"))
    classes = named.join(roots, "node", "left").select("_id", F.coalesce("root", "node").alias("cluster_id"))
    sizes = classes.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    alone = each.where("n_words = 0").select("_id").distinct().join(classes, "_id", "left_anti").select("_id", F.col("_id").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_size"))
    placed = classes.join(sizes, "cluster_id").select("_id", "cluster_id", "cluster_size").union(alone)
    return docs.select(id_col).join(placed, F.col(id_col).eqNullSafe(F.col("_id")), "left").select(id_col, "cluster_id", "cluster_size")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row of least id stays, and of rows that repeat an id one.

    Rows with a null id are in no class and stay.
    """
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    mark = F.xxhash64(*(F.col(f"`{x}`") for x in plain))
    classes = near_duplicates(docs, id_col, text_col)
    gone = classes.where(F.col("cluster_id") != F.col(id_col)).select(F.col(id_col).alias("_gone"))
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).agg(F.min(mark).alias("_mark"), F.count("*").alias("_n")).where("_n > 1")
    leave = gone.union(several.select("_again")).distinct()
    once = docs.join(leave, docs[id_col] == leave["_gone"], "left_anti")
    first = docs.join(several, (docs[id_col] == several["_again"]) & (mark == several["_mark"]), "left_semi")
    return once.unionByName(first.join(gone, first[id_col] == gone["_gone"], "left_anti").dropDuplicates(plain))
