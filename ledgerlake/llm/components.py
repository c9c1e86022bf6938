"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """See to a checkpoint folder: the session's spark.checkpoint.dir; a folder of its own only in local mode without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: later steps survive a lost executor without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Small edge tables are dealt to few tasks: rounds are many, and each task of each shuffle leaves files.
EDGES_A_TASK = 200_000


def measure(e: DataFrame) -> tuple:
    """(number, sum of hashes) of the edges: equal if a round changed nothing."""
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root: the least node of the component, for every node of an edge.

    Each round joins and aggregates the edge table only, and leaves at most as many edges as before;
    rounds go with the logarithm of the longest path, not with its length.  A hub's edges
    are aggregated before they are shuffled, and adaptive execution splits the joins on it.
    Null ends and loops are left out.
    """
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where((F.col(a) != F.col(b))).distinct())
    mark = measure(e)
    for _ in range(most_rounds):
        tasks = max(1, mark[0] // EDGES_A_TASK)
        e = e.coalesce(tasks)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks).distinct().coalesce(tasks))
        now = measure(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
