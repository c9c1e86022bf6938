"""Bulk import of transfers, transactions and generic vertex and edge files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import AMOUNT, tx_hash
from .graph import Graph, cut


@dataclass
class Imported:
    """A graph and what its import counted: two vertices a row (not distinct), edges and rejected lines."""

    graph: Graph
    vertices: int
    edges: int
    errors: int


def transfers_csv(spark: SparkSession, path: str, strict: bool = False) -> Imported:
    """from, to, amount, block by position; a header line; plain commas without quoting.

    Numbers that can't be read are 0 (strict: an error); lines of fewer than four fields are counted and left out.
    """
    lines = spark.read.option("header", True).schema("line string").option("sep", "\u0001").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    f = F.split("line", ",", -1)
    parsed = lines.where(F.trim("line") != "").select(
        (F.size(f) >= 4).alias("ok"), F.trim(F.get(f, F.lit(0))).alias("from"), F.trim(F.get(f, F.lit(1))).alias("to"), whole(F.get(f, F.lit(2)), AMOUNT, strict).alias("amount"),
        whole(F.get(f, F.lit(3)), T.LongType(), strict).alias("block_number"),
    )
    return transfers(parsed)


def whole(col, kind: T.DataType, strict: bool):
    """A non-negative 64-bit number of digits alone; else 0, or an error if strict."""
    text = F.trim(col)
    value = F.when(text.rlike("^[0-9]{1,20}$") & (text.cast("decimal(38,0)") <= F.lit("18446744073709551615").cast("decimal(38,0)")), text.try_cast(kind))
    return F.coalesce(value, F.raise_error(F.concat(F.lit("no number: "), F.coalesce(text, F.lit("")))) if strict else F.lit(0)).cast(kind)


def transfers_jsonl(spark: SparkSession, path: str) -> Imported:
    """Objects of from, to, value (digits as a string), block_number; lines that lack one or don't parse are errors."""
    schema = "from string, to string, value string, block_number long, tx_hash string, token_address string, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull() & F.col("from").isNotNull() & F.col("to").isNotNull() & F.col("value").isNotNull() & F.col("block_number").isNotNull()
    return transfers(rows.select(ok.alias("ok"), "from", "to", F.coalesce(F.col("value").try_cast(AMOUNT), F.lit(0)).cast(AMOUNT).alias("amount"), "block_number"))


def transfers(parsed: DataFrame) -> Imported:
    """Accounts by exact address, numbered in order of first appearance; edges in order of the rows.

    Order numbers come from one pass over the partitions' sizes, so ids are the same on every run and nothing is sorted in one task.
    """
    seen = Observation()
    counted = parsed.observe(seen, F.count_if("ok").alias("edges"), F.count_if(~F.col("ok")).alias("errors"))
    rows = cut(numbered(counted.where("ok").drop("ok"), "id"))
    ends = rows.select(F.explode(F.array(F.struct((2 * F.col("id")).alias("n"), F.col("from").alias("a")), F.struct((2 * F.col("id") + 1).alias("n"), F.col("to").alias("a")))).alias("x"))
    first = ends.groupBy(F.col("x.a").alias("address")).agg(F.min("x.n").alias("n"))
    accounts = cut(numbered(first.orderBy("n").drop("n"), "id"))
    vertices = accounts.select("id", F.lit("Account").alias("label"), "address")
    edges = rows.join(accounts.select(F.col("address").alias("from"), F.col("id").alias("src")), "from").join(accounts.select(F.col("address").alias("to"), F.col("id").alias("dst")), "to")
    edges = edges.select("id", F.lit("Transfer").alias("label"), "src", "dst", "amount", "block_number")
    stats = seen.get
    return Imported(Graph(vertices, edges), 2 * stats["edges"], stats["edges"], stats["errors"])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` in its order with numbers from 1: positions inside partitions plus the partitions' offsets."""
    part, at = F.shiftright(F.col("_m"), 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    marked = cut(df.withColumn("_m", F.monotonically_increasing_id()))
    offsets, offset = [], 0
    for p, n in sorted((r[0], r[1]) for r in marked.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, offset))
        offset += n
    # One row a partition.
    table = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return marked.join(F.broadcast(table), part == F.col("_p")).withColumn(name, at + F.col("_o") + 1).drop("_m", "_p", "_o")


def import_etherscan_csv(spark: SparkSession, path: str) -> Imported:
    """An explorer's export: transfers_csv under the name that its users know."""
    return transfers_csv(spark, path)


def import_jsonl(spark: SparkSession, path: str) -> Imported:
    return transfers_jsonl(spark, path)


def imported(spark: SparkSession, path: str, kind: str) -> Imported:
    """By the name of a format: csv, jsonl or json."""
    if kind not in ("csv", "jsonl", "json"):
        raise ValueError(f"unknown format {kind}")
    return transfers_csv(spark, path) if kind == "csv" else transfers_jsonl(spark, path)


def transactions_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(Transaction vertices: hash, block_number; one row of counts) from tx_hash, block, and at least one more field."""
    f = F.split("line", ",", -1)
    lines = spark.read.option("header", True).schema("line string").option("sep", "\u0001").option("quote", "").csv(path)
    parsed = lines.where(F.trim("line") != "").select(F.when(F.size(f) >= 3, tx_hash(F.get(f, F.lit(0)))).alias("hash"), whole(F.get(f, F.lit(1)), T.LongType(), False).alias("block_number"))
    good = parsed.where("hash is not null").select(F.lit("Transaction").alias("label"), "hash", "block_number")
    return good, parsed.agg(F.count("hash").alias("vertices"), F.count_if(F.col("hash").isNull()).alias("errors"))


def vertices_csv(spark: SparkSession, path: str) -> DataFrame:
    """address, label, balance, nonce with a header."""
    rows = spark.read.option("header", True).schema("address string, label string, balance string, nonce long").csv(path)
    return rows.withColumn("balance", F.col("balance").try_cast(AMOUNT))


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """from_address, to_address, label, amount, tx_hash, block_number with a header."""
    rows = spark.read.option("header", True).schema("from_address string, to_address string, label string, amount string, tx_hash string, block_number long").csv(path)
    return rows.withColumn("amount", F.col("amount").try_cast(AMOUNT))


def graph_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: label, address, ext; edges: label, from, to, ext) from objects of type vertex or edge."""
    rows = spark.read.schema("type string, label string, address string, `from` string, `to` string, properties map<string,string>").json(path)
    vertices = rows.where("type = 'vertex'").select("label", "address", F.col("properties").alias("ext"))
    return vertices, rows.where("type = 'edge'").select("label", "from", "to", F.col("properties").alias("ext"))


def assemble(vertices: DataFrame, edges: DataFrame, from_col: str, to_col: str) -> Graph:
    """A graph from addressed rows: one vertex an address, ids by address, edges that name unknown addresses add Accounts."""
    named = edges.select(F.explode(F.array(from_col, to_col)).alias("address")).distinct().join(vertices.select("address"), "address", "left_anti").withColumn("label", F.lit("Account"))
    every = vertices.dropDuplicates(["address"]).unionByName(named, allowMissingColumns=True)
    v = cut(numbered(every.orderBy("address"), "id"))
    e = edges.join(v.select(F.col("address").alias(from_col), F.col("id").alias("src")), from_col).join(v.select(F.col("address").alias(to_col), F.col("id").alias("dst")), to_col).drop(from_col, to_col)
    e = cut(numbered(e, "id"))
    order = ["id", "label", "src", "dst"]
    return Graph(v.select("id", "label", *(x for x in v.columns if x not in ("id", "label"))), e.select(*order, *(x for x in e.columns if x not in order)))


def roll_up_transfers(edges: DataFrame, token: str = "token_address", time: str = "block_number") -> DataFrame:
    """Aggregated transfers: src, dst, token, first_time, last_time, sum, tx_count."""
    return edges.groupBy("src", "dst", token).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.sum("amount").alias("sum"), F.count("*").alias("tx_count"))
