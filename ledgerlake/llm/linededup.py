"""Line deduplication over overlapping windows of consecutive lines, in DataFrame operations only.

1. Every ``window`` consecutive lines of a document are hashed (two independent 64-bit hashes).
2. Windows are grouped by hash over all documents; map-side aggregation leaves one row a
   task for a window however often it repeats.
3. Every occurrence but the first (least document, then position) is a later one; the join that finds
   them is a plain equi-join, so adaptive execution splits it where one window is very frequent.
4. A document's later windows are merged to covered line ranges, and the lines
   between the ranges are kept.

Windows are judged on the input, not on what is left, and windows of blank lines only don't count.

Defined cases: null text stays null with no lines; a text of fewer than ``window``
lines is never touched; rows that repeat both id and text are one document, and each of
them keeps what the first keeps; rows that repeat only the id are documents of their own, ordered by a hash
of their text; a null id comes first; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """_id, _t (hash of the text), _pos (from 0), _h1, _h2 of each window."""
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.split(text_col, "\n", -1).alias("_l")).where(F.size("_l") >= window)
    n = F.size("_l") - window + 1
    zipped = F.arrays_zip(*(F.slice("_l", i + 1, n).alias(f"x{i}") for i in range(window)))
    rows = lines.select("_id", "_t", F.posexplode(zipped).alias("_pos", "_w"))
    parts = [F.col("_w").getField(f"x{i}") for i in range(window)]
    blank = reduce(lambda a, b: a & b, (F.trim(p) == "" for p in parts))
    return rows.where(~blank).select("_id", "_t", "_pos", F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(window), *parts).alias("_h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, stats_col: str = "_dedup") -> DataFrame:
    """The rows of ``docs`` with text_col replaced by the kept lines, and n_lines, n_removed, n_spans (of removed lines) under ``stats_col``."""
    rows = windows(docs, id_col, text_col, window)
    at = F.struct("_id", "_t", "_pos")
    first = rows.groupBy("_h1", "_h2").agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where(~F.col("_first").eqNullSafe(F.col("_last"))).drop("_last")
    later = rows.join(first, ["_h1", "_h2"]).where(~at.eqNullSafe(F.col("_first"))).select("_id", "_t", "_pos")
    order = Window.partitionBy("_id", "_t").orderBy("_pos")
    start = F.coalesce(F.lag("_pos").over(order) + window, F.lit(0))
    runs = later.withColumn("_from", start)
    gap = F.when(F.col("_pos") > F.col("_from"), F.struct(F.col("_from").alias("a"), (F.col("_pos") - F.col("_from")).alias("n")))
    covered = runs.groupBy("_id", "_t").agg(
        F.array_sort(F.collect_list(gap)).alias("_gaps"),
        (F.max("_pos") + window).alias("_tail"),
        F.count(F.when((F.col("_pos") > F.col("_from")) | (F.col("_from") == 0) & (F.col("_pos") == 0), 1)).alias("_spans"),
    )
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.xxhash64(text_col).alias("_th"), F.split(text_col, "\n", -1).alias("_l"))
    joined = whole.join(covered, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t")), "left")
    n = F.when(F.col("_l").isNull(), 0).otherwise(F.size("_l"))
    rest = F.greatest(n - F.col("_tail"), F.lit(0))
    kept = F.concat(F.flatten(F.transform("_gaps", lambda g: F.slice(F.col("_l"), g.a + 1, g.n))), F.slice(F.col("_l"), F.col("_tail") + 1, rest))
    n_kept = F.aggregate("_gaps", F.lit(0), lambda s, g: s + g.n) + rest
    stats = F.struct(
        n.cast("long").alias("n_lines"),
        F.when(F.col("_tail").isNull(), 0).otherwise(n - n_kept).cast("long").alias("n_removed"),
        F.coalesce("_spans", F.lit(0)).cast("long").alias("n_spans"),
    ).alias(stats_col)
    text = F.when(F.col("_tail").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return joined.select(*(text if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names), stats)
