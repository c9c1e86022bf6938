"""Streaming import of transfers and windowed sums over event streams (an extension beyond batch import)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSFER = "`from` string, `to` string, amount decimal(38,0), block_number long, tx_hash string, seen timestamp"


def transfer_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Transfers from JSON files that arrive in a folder; a tx_hash within the watermark counts once."""
    rows = spark.readStream.schema(TRANSFER).json(folder)
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["tx_hash"])


def flow_sums(transfers: DataFrame, every: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Sums by receiver and tumbling window."""
    rows = transfers.withWatermark("seen", late) if late else transfers
    return rows.groupBy(F.window("seen", every), "to").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
