"""Bounded, deterministic samples of labelled rows for training on the driver."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of any training sample: rows in all classes together, and bytes of text.
MOST_ROWS, MOST_BYTES = 12_000, 8 << 20


def stratified(
    docs: DataFrame,
    label: str,
    per_class: int,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_rows: int = MOST_ROWS,
    most_bytes: int = MOST_BYTES,
) -> tuple[list[tuple], dict]:
    """(rows of (text, label), counts by class): about ``per_class`` rows of each class, all of a smaller one.

    A row is taken if its hash falls under its class's share, so nothing is sorted or
    grouped but the ids, lengths and labels of the sample itself, and equal inputs give equal samples.
    Each class has its share of ``most_bytes``: its texts are whole and are taken in the order of their
    hashes as long as they fit; a text of over a sixteenth of the share is left out, so that one
    text can't shut out others.  Only then are the texts of the sample fetched.

    labels: a table of (id, label) beside ``docs``; None if ``label`` is a column of ``docs``.
    Null labels are no labels; a null text is an empty one; rows that repeat id, text and label count once.
    """
    source = (docs if labels is None else labels).where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in source.groupBy(label).count().collect()}
    if not counts:
        return [], counts
    per_class = max(1, min(per_class, most_rows // len(counts)))
    hashed = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    below = F.lit(False)
    for k, n in sorted(counts.items(), key=lambda x: str(x[0])):
        below = below | ((F.col(label) == F.lit(k)) & (hashed < int(min(1.0, per_class / n) * (1 << 30))))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    picked = source.where(below)
    if labels is None:
        sample = picked.select(F.col(id_col).alias("_id"), text, F.col(label).alias("_label"))
    else:
        ids = picked.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
        sample = docs.select(F.col(id_col).alias("_id"), text).join(F.broadcast(ids.distinct()), "_id")
    share = most_bytes // len(counts)
    sizes = sample.select("_id", "_label", F.xxhash64("_text").alias("_t"), F.octet_length("_text").alias("_n")).where(F.col("_n") <= share // 16).distinct()
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id", F.lit("order")), "_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.withColumn("_sum", F.sum("_n").over(order)).where(F.col("_sum") <= share).select("_id", "_label", "_t")
    fitting = F.broadcast(fitting.select(F.col("_id").alias("_a"), F.col("_label").alias("_b"), F.col("_t").alias("_c")))
    same = F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_label") == F.col("_b")) & (F.xxhash64("_text") == F.col("_c"))
    rows = {(r["_text"], r["_label"], r["_id"]): None for r in sample.join(fitting, same, "left_semi").collect()}
    ordered = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode()), str(r[2]), str(r[1]), r[0]))
    return [(t, y) for t, y, _ in ordered], counts
