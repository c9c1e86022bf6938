"""Graphs derived from relational tables: a payment ledger, hand-offs between users, trade between nations."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import AMOUNT
from .graph import Graph

SUPPLIER, PART, ORDER = 1_000_000_000, 2_000_000_000, 3_000_000_000


def ledger(spark: SparkSession, sf_dir: str) -> Graph:
    """customer -> Account, supplier -> Contract, part -> Token, order -> Transaction; Transfer per line item, TxRel per order, Call per line item from order to part."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    null = lambda kind: F.lit(None).cast(kind)

    def vertices(df, vid, label, name, balance):
        return df.select(vid.cast("long").alias("id"), F.lit(label).alias("label"), F.concat(F.lit(f"{label[0].lower()}:"), (vid).cast("string")).alias("address"), name.alias("name"), balance.alias("balance"))

    cents = lambda x: F.round(F.col(x) * 100).cast("long")
    v = (
        vertices(t("customer"), F.col("c_custkey"), "Account", F.col("c_name"), cents("c_acctbal"))
        .union(vertices(t("supplier"), F.col("s_suppkey") + SUPPLIER, "Contract", F.col("s_name"), cents("s_acctbal")))
        .union(vertices(t("part"), F.col("p_partkey") + PART, "Token", F.col("p_name"), cents("p_retailprice")))
        .union(vertices(t("orders"), F.col("o_orderkey") + ORDER, "Transaction", null("string"), cents("o_totalprice")))
    )
    orders = t("orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("block_number"))
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Lines that share order and number are told apart by their rank; lines of equal part, supplier and price make equal edges.
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey", "l_extendedprice")
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.row_number().over(same) - 1
    transfer = lines.select((number * 3).alias("id"), F.lit("Transfer").alias("label"), F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIER).alias("dst"), F.round(F.col("l_extendedprice") * 100).cast(AMOUNT).alias("amount"), "block_number")
    call = lines.select((number * 3 + 1).alias("id"), F.lit("Call").alias("label"), (F.col("l_orderkey") + ORDER).alias("src"), (F.col("l_partkey") + PART).alias("dst"), null(AMOUNT).alias("amount"), "block_number")
    rel = orders.select((F.col("o_orderkey") * 30 + 2).alias("id"), F.lit("TxRel").alias("label"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") + ORDER).alias("dst"), null(AMOUNT).alias("amount"), "block_number")
    return Graph(v, transfer.union(call).union(rel))


def handoff(spark: SparkSession, sf_dir: str) -> Graph:
    """Users as Accounts; an edge from each purchase's user to the next one's, in time order.

    The order is global, so consecutive days are numbered in one window each and joined at their borders.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day"))
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    marked = e.withColumn("next", F.lead("user_id").over(within))
    first = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    # One row a day: the only window without a key.
    days = first.withColumn("after", F.lead("first_user").over(Window.orderBy("day"))).select("day", "after")
    edges = marked.join(days, "day").withColumn("dst", F.coalesce("next", "after")).where("dst is not null and dst <> user_id")
    edges = edges.select(F.col("event_id").alias("id"), F.lit("Transfer").alias("label"), F.col("user_id").alias("src"), "dst", F.round(F.col("value") * 100).cast(AMOUNT).alias("amount"), F.lit(0).cast("long").alias("block_number"))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()
    return Graph(users.select("id", F.lit("Account").alias("label"), F.concat(F.lit("u:"), F.col("id").cast("string")).alias("address")), edges)


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; capacity from customers' to suppliers' nation: summed quantity."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("l_quantity").cast(AMOUNT).alias("amount"))
    v = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("Account").alias("label"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("address"), F.col("n_name").alias("name"))
    return Graph(v, pairs.select((F.col("src") * 1000 + F.col("dst")).alias("id"), F.lit("Transfer").alias("label"), "src", "dst", "amount", F.lit(0).cast("long").alias("block_number")))
