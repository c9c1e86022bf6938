"""The corpus pipeline: five stages over ``documents``, each by one operator of ``ledgerlake.llm``.

Each stage takes what its predecessor kept and returns rows with the columns of
``documents``; ``text`` and ``n_chars`` follow the line deduplication.  The last one
adds how many words of each document the mix takes.

Defined cases: documents with null or empty text or without a letter go in the first stage; null lang,
source or n_chars stay as they are, and a null source is a source; rows with a null doc_id are near
duplicates of nothing; of rows that repeat a doc_id one stays after the third stage; extra columns are kept by
the first four stages, whatever their names; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.components import shared_folder
from ledgerlake.llm.decontaminate import clean_rows
from ledgerlake.llm.langid import fit, identified_rows
from ledgerlake.llm.linededup import dedup_lines
from ledgerlake.llm.mixing import mix_sources
from ledgerlake.llm.neardup import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose codeword is ambiguous.  The classifier learns from the documents' own lang."""
    return identified_rows(docs, fit(docs), ambiguous=False)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document of which nothing is left goes, too."""
    stats = max(docs.columns, key=len) + "_lines"
    found = dedup_lines(docs, stats_col=stats)
    n_removed = F.col(f"`{stats}`").getField("n_removed")
    left = found.where((n_removed == 0) | (n_removed < F.col(f"`{stats}`").getField("n_lines")))
    n_chars = F.when(n_removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*(f"`{c}`" for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of least doc_id."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in a window shared with the benchmark go."""
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with taken, size, source_size and target."""
    found = mix_sources(docs, keep=("text", "lang", "n_chars"))
    kept = [F.col(f"_keep_{c}").alias(c) for c in ("text", "lang", "n_chars")]
    return found.where("taken > 0").select("doc_id", *kept, "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
]

#: Codes, darts and seeded hashes are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
