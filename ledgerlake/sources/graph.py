"""A property graph as two DataFrames."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_KEYS = ("id", "label", "src", "dst")


def shared_folder(spark: SparkSession) -> None:
    """See to a checkpoint folder: spark.checkpoint.dir, or in local mode a folder of our own."""
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
    """``df`` computed once into the shared checkpoint folder, for loops whose plans would grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``df`` for a loop that reads it again and again: as it is if only files are scanned, filtered and projected; written once if it takes joins, windows or sums."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return cut(df) if re.search(r"^[\s:+-]*(Join|Window|Aggregate|Sort|Distinct|Generate|Deduplicate)", plan, re.M) else df


@dataclass(frozen=True)
class Graph:
    """vertices: id, label and properties; edges: id, label, src, dst and properties; schema: declared types by label."""

    vertices: DataFrame
    edges: DataFrame
    schema: object = field(default=None, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    # -- scans ----------------------------------------------------------------
    def vertex(self, vid: int) -> DataFrame:
        return self.vertices.where(F.col("id") == vid)

    def vertex_by_address(self, address: str) -> DataFrame:
        return self.vertices.where(F.col("address") == address)

    def vertices_by_label(self, *labels: str) -> DataFrame:
        return self.vertices.where(F.col("label").isin(*labels))

    def edge(self, eid: int) -> DataFrame:
        return self.edges.where(F.col("id") == eid)

    def edges_by_label(self, *labels: str) -> DataFrame:
        return self.edges.where(F.col("label").isin(*labels))

    def outgoing(self, vid: int) -> DataFrame:
        return self.edges.where(F.col("src") == vid)

    def incoming(self, vid: int) -> DataFrame:
        return self.edges.where(F.col("dst") == vid)

    def edges_between(self, src: int, dst: int) -> DataFrame:
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst))

    # -- changes: each gives a new graph ---------------------------------------
    def add_vertices(self, rows: DataFrame) -> Graph:
        """Rows with label and properties; ids continue after the largest, or are kept if given."""
        return replace(self, vertices=self.vertices.unionByName(self._numbered(rows, self.vertices), allowMissingColumns=True))

    def add_edges(self, rows: DataFrame, check: bool = True) -> Graph:
        """Rows with label, src, dst and properties; both ends have to exist."""
        if check:
            ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            if not ends.join(self.vertices, "id", "left_anti").isEmpty():
                raise ValueError("an edge ends at a vertex that doesn't exist")
        return replace(self, edges=self.edges.unionByName(self._numbered(rows, self.edges), allowMissingColumns=True))

    def remove_vertices(self, ids: DataFrame) -> Graph:
        """Without the vertices of ``ids`` (column id) and their edges."""
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(ids.select(F.col("id").alias(end)), end, "left_anti").select(*self.edges.columns)
        return replace(self, vertices=self.vertices.join(ids.select("id"), "id", "left_anti").select(*self.vertices.columns), edges=e)

    def remove_edges(self, ids: DataFrame) -> Graph:
        return replace(self, edges=self.edges.join(ids.select("id"), "id", "left_anti").select(*self.edges.columns))

    def update(self, which: str, changed: DataFrame) -> Graph:
        """Rows of ``changed`` (id and all columns to replace) take the place of vertices or edges of the same id."""
        old = getattr(self, which)
        kept = old.join(changed.select("id"), "id", "left_anti")
        return replace(self, **{which: kept.unionByName(changed, allowMissingColumns=True)})

    @staticmethod
    def _numbered(rows: DataFrame, old: DataFrame) -> DataFrame:
        if "id" in rows.columns:
            return rows
        # Ids rise without a global sort; one partition's rows get consecutive ones.
        last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
        return cut(rows.withColumn("_n", F.monotonically_increasing_id()).crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_n") + 1).drop("_n", "_last"))

    # -- storage --------------------------------------------------------------
    def write(self, folder: str) -> None:
        """Parquet by label, so that label scans read only their own files; edges sorted by source within a file."""
        self.vertices.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/vertices")
        self.edges.repartition("label", "src").sortWithinPartitions("src").write.mode("overwrite").partitionBy("label").parquet(f"{folder}/edges")

    @staticmethod
    def read(spark: SparkSession, folder: str, schema=None) -> Graph:
        v, e = (labelled(spark, f"{folder}/{kind}") for kind in ("vertices", "edges"))
        return Graph(v.select("id", "label", *(c for c in v.columns if c not in ("id", "label"))), e.select(*EDGE_KEYS, *(c for c in e.columns if c not in EDGE_KEYS)), schema)

    def repeated_ids(self) -> DataFrame:
        """kind, id, n of the ids that several vertices or several edges have; a sound graph has none."""
        parts = [df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "id", "n") for kind, df in (("vertex", self.vertices), ("edge", self.edges))]
        return parts[0].union(parts[1])


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """A table stored by label, with labels as strings whatever they look like; no session setting is touched."""
    found = spark.read.parquet(folder)
    kinds = [T.StructField("label", T.StringType()) if f.name == "label" else f for f in found.schema]
    return spark.read.schema(T.StructType(kinds)).parquet(folder)


def empty_graph(spark: SparkSession, schema=None) -> Graph:
    vertices = "id long, label string, address string, name string"
    edges = "id long, label string, src long, dst long, amount decimal(38,0), block_number long"
    return Graph(spark.createDataFrame([], vertices), spark.createDataFrame([], edges), schema)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
