"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Sizes in words, summed by source; the targets fill up by weight and stop at
   ``max_repeat`` times their source's size.  The water level is found by sums over the table of
   sources, which stays a table: sources may be as many as web domains.
2. Documents are dealt to shards of about ``shard_words`` words by a seeded hash.  A source is
   dealt over as many shards as leave it ``least_blocks`` blocks in each, so a small one
   lies in few and its quotas there are no matter of rounding.
3. Inside a shard each source is one stream of words in seeded order, cut into equal blocks of
   at most ``block_words`` words, and into ``least_blocks`` at least where it has the words.
   The blocks to take go to the sources by highest quotients votes / (2 * seats + 1), where
   votes are the blocks that the source's ratio target / size asks for: integer quotas for
   each source and shard.
4. Seeded order of a source's blocks says which are taken once more than the
   others when the quota is no multiple of the number of blocks.

A shard holds a fixed number of words, so a source with a third of all rows is spread over a
third of every shard.  Rows that repeat id, source and text are one entry of a shard with
its number of copies, so they don't fill one either, and rows without words aren't dealt at all.

Defined cases: null or empty text has size 0 and takes 0; a null source is a
source, after all others; repeated rows are documents of their own, whose words taken differ by one at
most; a doc_id may be null; an empty table gives no rows.  Equal inputs give equal results.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .kernels import mix

WEIGHTS = (5, 2, 1)
TOKEN = r"[^\x20\x09-\x0D]+"


#: Bytes of source names up to which the table of sources is sent to all tasks; beyond, it is joined by salted shuffle.
SOURCE_BYTES = 4 << 20
SALTS = 32


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """source, size, target from source, size: all words shared by weight, none above max_repeat * size.

    A level, words for each unit of weight, rises as full sources leave; every round is one sum over the table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = cut(sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))))
    most = F.col("size") * float(max_repeat)
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level > most
        r = weighed.agg(F.sum("size"), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if r[3] == full or not r[2]:
            break
        level, full = (r[0] - (r[1] or 0.0)) / r[2], r[3]
    return weighed.select("source", "size", F.least(F.col("weight") * level, most).alias("target"))


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Lague: the seats go one by one to the highest votes / (2 * held + 1); ties to the earlier entry."""
    votes = np.asarray(votes, dtype=float)
    held = np.zeros(len(votes), dtype=np.int64)
    if not seats or not (votes > 0).any():
        return held
    held = np.floor(votes * (seats / votes.sum()) + 0.5).astype(np.int64)
    while held.sum() < seats:
        held[np.argmax(votes / (2 * held + 1))] += 1
    while held.sum() > seats:
        last = np.where(held > 0, votes / np.maximum(2 * held - 1, 1), np.inf)
        held[len(last) - 1 - np.argmin(last[::-1])] -= 1
    return held


def n_blocks(words: int, block_words: int, least_blocks: int) -> int:
    """Into how many equal blocks a stream is cut."""
    return max(-(-words // block_words), min(words, least_blocks))


def select_blocks(sizes: np.ndarray, quota: int, n: int, seed: int) -> np.ndarray:
    """Words taken of each entry of one stream of ``n`` blocks."""
    total = int(sizes.sum())
    if not n:
        return np.zeros(len(sizes), np.int64)
    each = np.full(n, quota // n, dtype=np.int64)
    order = np.argsort(mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)), kind="stable")
    each[order[: quota % n]] += 1
    # Blocks begin at these words; their lengths differ by one at most.
    begin = np.arange(n + 1, dtype=np.int64) * (total // n) + np.minimum(np.arange(n + 1), total % n)
    taken = np.concatenate([[0], np.cumsum(np.diff(begin) * each)])
    ends = np.cumsum(sizes)

    def upto(x: np.ndarray) -> np.ndarray:
        b = np.minimum(np.searchsorted(begin, x, side="right") - 1, n - 1)
        return taken[b] + (x - begin[b]) * each[b]

    return upto(ends) - upto(ends - sizes)


def shard_quotas(votes: np.ndarray, blocks: np.ndarray, max_repeat: int) -> np.ndarray:
    """Blocks to take of each stream: by highest quotients, none more than ``max_repeat`` times its blocks."""
    quota = apportion(votes, int(round(votes.sum())))
    return np.minimum(quota, max_repeat * blocks)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_repeat: int = 3,
    block_words: int = 64,
    shard_words: int = 2_000_000,
    seed: int = 17,
    least_blocks: int = 64,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken; and the columns in ``keep`` under ``_keep_`` names."""
    keys = [F.xxhash64(F.lit(seed + i), id_col, source_col, text_col) for i in range(2)]
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(TOKEN)).cast("long")
    sized = docs.select(F.col(source_col).alias("source"), keys[0].alias("h"), keys[1].alias("h2"), size.alias("size"))
    entries = cut(sized.groupBy("h", "h2").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies")))
    sizes = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"))
    goals = cut(targets(sizes, weights, max_repeat).select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target"))
    words, n_bytes = goals.agg(F.sum("source_size"), F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 24)).first()
    shards = max(1, math.ceil((words or 0) / shard_words))
    own = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / (block_words * least_blocks)))).cast("long")
    goals = goals.withColumn("_own", own)
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS))
    if (n_bytes or 0) <= SOURCE_BYTES:
        aimed = entries.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("_source")))
    else:
        spread = goals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        aimed = entries.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (salt == F.col("_salt"))).drop("_salt")
    # A source's shards follow each other from a place of its own.
    home = F.xxhash64(F.lit(seed), "source")
    aimed = aimed.withColumn("_shard", F.pmod(F.pmod(home, F.lit(shards)) + F.pmod("h", F.col("_own")), F.lit(shards))).drop("_own", "_source")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "h2"], kind="stable").reset_index(drop=True)
        names = sorted(set(pdf["source"].dropna())) + [None]
        rank = {s: i for i, s in enumerate(names)}
        which = np.array([rank[None if pd.isna(s) else s] for s in pdf["source"]], dtype=np.int64)
        copies = pdf["copies"].to_numpy(np.int64)
        words = pdf["size"].to_numpy(np.int64) * copies
        local = np.bincount(which, weights=words, minlength=len(names)).astype(np.int64)
        ratio = np.zeros(len(names))
        ratio[which] = pdf["target"].to_numpy(float) / pdf["source_size"].to_numpy(float)
        blocks = np.array([n_blocks(int(x), block_words, least_blocks) for x in local], dtype=np.int64)
        quota = shard_quotas(blocks * ratio, blocks, max_repeat)
        taken = np.zeros(len(pdf), np.int64)
        shard = int(pdf["_shard"].iloc[0])
        for i in np.unique(which):
            at = np.flatnonzero(which == i)
            stream = zlib.crc32(f"{seed}/{shard}/{names[i]}".encode())
            taken[at] = select_blocks(words[at], int(quota[i]), int(blocks[i]), stream)
        return pd.DataFrame({"h": pdf["h"], "h2": pdf["h2"], "size": pdf["size"], "source_size": pdf["source_size"], "target": pdf["target"], "each": taken // copies, "more": taken % copies})

    schema = "h long, h2 long, size long, source_size long, target double, each long, more long"
    dealt = aimed.where("size > 0").groupBy("_shard").applyInPandas(one, schema)
    none = F.lit(0).cast("long")
    mixed = dealt.union(aimed.where("size = 0").select("h", "h2", "size", "source_size", "target", none, none))
    mixed = mixed.select(*(F.col(x).alias(f"_m_{x}") for x in ("h", "h2", "size", "source_size", "target", "each", "more")))
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"), keys[0].alias("_h"), keys[1].alias("_h2"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    both = rows.join(mixed, (F.col("_h") == F.col("_m_h")) & (F.col("_h2") == F.col("_m_h2")))
    # Of copies the first ``more`` take a word more than the rest; copies are alike, so any order does.
    nth = F.row_number().over(Window.partitionBy("_h", "_h2").orderBy("source"))
    taken = F.col("_m_each") + F.when(F.col("_m_more") > 0, (nth <= F.col("_m_more")).cast("long")).otherwise(none)
    return both.select(id_col, "source", F.col("_m_size").alias("size"), *(f"_keep_{c}" for c in keep), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), taken.alias("taken"))
