"""Registered queries on what the first list leaves out: sources and sinks, reuse of variables, metadata, certificates of flows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import values
from .operators import flow
from .queries import _SIMPLE, _TEXT, HANDOFF, LEDGER, QUERIES, SQL, _levels, _weighed, after, handoff, ledger
from .sources import importers, sinks
from .sources import testgraphs as G
from .sources.graph import Graph, shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def on_ledger(name: str, build: Callable[[Graph], DataFrame], sql: str) -> None:
    """A query on the ledger's tables."""
    QUERIES[name] = lambda spark, sf_dir: build(G.ledger(spark, sf_dir))
    SQL[name] = f"WITH RECURSIVE {LEDGER} {sql}"


# -- mentions of a variable bound before, outer variables -----------------------
_TWO = "FROM E t JOIN E u ON t.dst = u.dst AND t.src = u.src JOIN V ON V.id = t.src WHERE t.label = 'Transfer' AND u.label = 'Transfer'"
ledger("reuse_props", "MATCH (a)-[t:Transfer]->(c)<-[u:Transfer]-(a {name: 'Customer#000000007'}) RETURN c.id AS c, count(*) AS n", f"SELECT t.dst AS c, count(*) AS n {_TWO} AND name = 'Customer#000000007' GROUP BY t.dst")
ledger("reuse_props_none", "MATCH (a)-[t:Transfer]->(c)<-[u:Transfer]-(a {name: 'nope'}) RETURN count(*) AS n", "SELECT 0::BIGINT AS n")
ledger("reuse_label", "MATCH (a)-[t:Transfer]->(c)<-[u:Transfer]-(a:Contract) RETURN count(*) AS n", "SELECT 0::BIGINT AS n")
ledger("reuse_label_kept", "MATCH (a)-[t:Transfer]->(c)<-[u:Transfer]-(a:Account|Token) RETURN count(*) AS n, count(DISTINCT a) AS k", f"SELECT count(*) AS n, count(DISTINCT t.src) AS k {_TWO} AND V.label IN ('Account', 'Token')")
ledger("reuse_in_comma", "MATCH (a)-[t:Transfer]->(c), (a:Account {name: 'Customer#000000007'})-[r:TxRel]->(o) RETURN c.id AS c, o.id AS o", "SELECT t.dst AS c, r.dst AS o FROM E t JOIN E r ON t.src = r.src JOIN V ON V.id = t.src WHERE t.label = 'Transfer' AND r.label = 'TxRel' AND name = 'Customer#000000007'")
ledger(
    "optional_outer",
    "MATCH (a:Account) OPTIONAL MATCH (a)-[t:Transfer]->(c) WHERE t.amount > a.balance * 10 RETURN a.id AS a, count(t) AS n, min(c.id) AS lo",
    "SELECT V.id AS a, count(E.id) AS n, min(E.dst) AS lo FROM V LEFT JOIN E ON V.id = src AND E.label = 'Transfer' AND amount > balance * 10 WHERE V.label = 'Account' GROUP BY V.id",
)
_RICH = "SELECT 1 FROM E JOIN V s ON s.id = E.dst WHERE E.src = a.id AND E.label = 'Transfer' AND s.balance > a.balance"
ledger("exists_outer", "MATCH (a:Account) WHERE EXISTS { (a)-[t:Transfer]->(s) WHERE s.balance > a.balance } RETURN a.id AS a", f"SELECT id AS a FROM V a WHERE label = 'Account' AND EXISTS ({_RICH})")
ledger("not_exists_outer", "MATCH (a:Account) WHERE NOT EXISTS { (a)-[t:Transfer]->(s) WHERE s.balance > a.balance } RETURN a.id AS a", f"SELECT id AS a FROM V a WHERE label = 'Account' AND NOT EXISTS ({_RICH})")
ledger("exists_outer_in_or", "MATCH (a:Account) WHERE a.balance < 0 OR EXISTS { (s:Contract) WHERE s.balance > a.balance } RETURN a.id AS a", "SELECT id AS a FROM V a WHERE label = 'Account' AND (balance < 0 OR EXISTS (SELECT 1 FROM V s WHERE s.label = 'Contract' AND s.balance > a.balance))")

# -- arguments that hit rows -----------------------------------------------------
ledger("edge_by_id_hit", "MATCH (a)-[t]->(b) WHERE t.id = 32 RETURN a.id AS a, b.id AS b, t.label AS label", "SELECT src AS a, dst AS b, label FROM E WHERE id = 32")
ledger("edge_props_hit", "MATCH (a)-[t:Transfer {block_number: 9500}]->(b) RETURN t.id AS t, a.id AS a, b.id AS b", "SELECT id AS t, src AS a, dst AS b FROM E WHERE label = 'Transfer' AND block_number = 9500")
ledger("not_exists_hit", "MATCH (o:Transaction) WHERE NOT EXISTS { (o)-[:Call]->() } RETURN o.id AS o", "SELECT id AS o FROM V WHERE label = 'Transaction' AND id NOT IN (SELECT src FROM E WHERE label = 'Call')")
ledger("edge_ids_are_unique", "MATCH (a)-[t]->(b) RETURN count(*) AS n, count(DISTINCT t.id) AS k", "SELECT count(*) AS n, count(*) AS k FROM E")

# -- patterns and projections ------------------------------------------------------
ledger("wave_in", "MATCH (o:Transaction)<~[t:TxRel]~(a) RETURN o.id AS o, a.id AS a", "SELECT dst AS o, src AS a FROM E WHERE label = 'TxRel'")
ledger("wave_out", "MATCH (a)~[t:TxRel]~>(o) RETURN a.id AS a, count(*) AS n, max(o.id) AS top", "SELECT src AS a, count(*) AS n, max(dst) AS top FROM E WHERE label = 'TxRel' GROUP BY src")
QUERIES["return_star"] = lambda spark, sf_dir: Engine(spark, G.ledger(spark, sf_dir)).gql("MATCH (a:Contract) RETURN *").select("a.*")
SQL["return_star"] = f"WITH {LEDGER} SELECT * FROM V WHERE label = 'Contract'"
ledger("minus_digits", "MATCH (a:Account) RETURN a.id -5 AS x, a.id-5 AS y, a.id - -5 AS z", "SELECT id - 5 AS x, id - 5 AS y, id + 5 AS z FROM V WHERE label = 'Account'")
ledger("map_literal", "MATCH (a:Contract) LET m = {k: a.id, n: a.name} RETURN m.k AS k, m.n AS n, m.none IS NULL AS missing", "SELECT id AS k, name AS n, true AS missing FROM V WHERE label = 'Contract'")
ledger("path_values", "MATCH p = (a:Account)-[:TxRel]->(o)-[:Call]->(t) RETURN id(a) AS a, count(*) AS n, max(length(p)) AS l, max(size(nodes(p))) AS k, min(size(edges(p))) AS e", "SELECT x.src AS a, count(*) AS n, 2 AS l, 3 AS k, 2 AS e FROM E x JOIN E y ON x.dst = y.src WHERE x.label = 'TxRel' AND y.label = 'Call' GROUP BY x.src")
ledger(
    "distinct_aggregates",
    "MATCH (a)-[t:Transfer]->(b) RETURN b.id AS b, count(DISTINCT t.block_number) AS n, sum(DISTINCT t.block_number) AS s, round(avg(DISTINCT t.block_number), 4) AS m, min(DISTINCT t.block_number) AS lo, round(stddev(DISTINCT t.block_number), 3) AS sd, round(var_pop(DISTINCT t.block_number), 3) AS v",
    "SELECT dst AS b, count(DISTINCT block_number) AS n, sum(DISTINCT block_number)::BIGINT AS s, round(avg(DISTINCT block_number), 4) AS m, min(block_number) AS lo, round(stddev_samp(DISTINCT block_number), 3) AS sd, round(var_pop(DISTINCT block_number), 3) AS v FROM E WHERE label = 'Transfer' GROUP BY dst",
)
QUERIES["approximate_aggregates"] = lambda spark, sf_dir: Engine(spark, G.ledger(spark, sf_dir)).gql(
    "MATCH (a)-[t:Transfer]->(b) RETURN b.label AS label, approx_count_distinct(t.block_number) AS about, count(DISTINCT t.block_number) AS n, percentile_approx(t.amount, 0.5) AS mid, min(t.amount) AS lo, max(t.amount) AS hi"
).select("label", "n", (F.abs(F.col("about") - F.col("n")) <= 0.2 * F.col("n")).alias("near"), F.col("mid").between(F.col("lo"), F.col("hi")).alias("between"))
SQL["approximate_aggregates"] = f"WITH {LEDGER} SELECT 'Contract' AS label, count(DISTINCT block_number) AS n, true AS near, true AS \"between\" FROM E WHERE label = 'Transfer'"
ledger(
    "more_functions",
    "MATCH (a:Account) RETURN a.id AS id, abs(a.balance) AS ab, sign(a.balance) AS sg, greatest(a.id, 50) AS g, least(a.id, 50) AS l, coalesce(a.nothing, 'x') AS co, lower(a.name) AS lo, length(a.name) AS len, substring(a.name, 1, 4) AS sub, replace(a.name, '#', '-') AS rep, reverse(a.name) AS rev, lpad(a.name, 20, '*') AS pad, size(split(a.name, '#')) AS parts, array_max([a.id, 7]) AS am, round(sqrt(a.id), 6) AS sq, mod(a.id, 7) AS md",
    "SELECT id, abs(balance) AS ab, sign(balance)::DOUBLE AS sg, greatest(id, 50) AS g, least(id, 50) AS l, 'x' AS co, lower(name) AS lo, length(name)::INT AS len, name[1:4] AS sub, replace(name, '#', '-') AS rep, reverse(name) AS rev, lpad(name, 20, '*') AS pad, len(string_split(name, '#'))::INT AS parts, greatest(id, 7) AS am, round(sqrt(id), 6) AS sq, id % 7 AS md FROM V WHERE label = 'Account'",
)
on_ledger("edges_between", lambda g: g.edges_between(*g.edges.groupBy("src", "dst").count().orderBy(F.desc("count"), "src", "dst").first()[:2]).select("id", "label", "src", "dst"), "SELECT id, label, src, dst FROM E JOIN (SELECT src, dst FROM E GROUP BY ALL ORDER BY count(*) DESC, src, dst LIMIT 1) USING (src, dst)")


# -- value types -------------------------------------------------------------------
def hex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, hashes and amounts from spellings with and without prefix, in either case, and from broken ones."""
    n = F.col("c_custkey")
    digits = F.upper(F.hex(n))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(n, F.lpad(digits, 40, "0").alias("a"), F.concat(F.lit("0X"), F.lpad(digits, 64, "0")).alias("h"), F.concat(F.lit("0x"), digits).alias("x"))
    return rows.select("c_custkey", values.address(F.col("a")).alias("address"), values.tx_hash(F.col("h")).alias("hash"), values.address(F.col("h")).alias("too_long"), values.amount(F.col("x"), 16).cast("long").alias("amount"), values.amount(F.lit("12x")).cast("long").alias("broken"))


QUERIES["hex_values"] = hex_values
SQL["hex_values"] = "SELECT c_custkey, '0x' || lpad(lower(hex(c_custkey)), 40, '0') AS address, '0x' || lpad(lower(hex(c_custkey)), 64, '0') AS hash, NULL::VARCHAR AS too_long, c_custkey AS amount, NULL::BIGINT AS broken FROM customer"
on_ledger("edge_weights", lambda g: g.edges.groupBy("label").agg(F.sum(values.weight(F.col("amount"))).cast("long").alias("w")), "SELECT label, sum(coalesce(amount, 1))::BIGINT AS w FROM E GROUP BY label")


# -- sources and sinks --------------------------------------------------------------
def _transfers(g: Graph) -> DataFrame:
    name = lambda end: F.concat(F.lit("v"), F.col(end).cast("string"))
    return g.edges_by_label("Transfer").select(name("src").alias("from"), name("dst").alias("to"), F.col("amount").cast("string").alias("value"), "block_number")


def _sums(g: Graph) -> DataFrame:
    named = g.vertices.select(F.col("id").alias("dst"), "address")
    return g.edges.join(named, "dst").groupBy("address").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("total"), F.max("block_number").alias("last"))


_SUMS = "SELECT 'v' || dst AS address, count(*) AS n, sum(amount)::BIGINT AS total, max(block_number) AS last FROM E WHERE label = 'Transfer' GROUP BY dst"


def import_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "jsonl")
    _transfers(G.ledger(spark, sf_dir)).write.json(folder)
    return _sums(importers.import_jsonl(spark, folder).graph)


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imports count, with two broken lines for each supplier."""
    t, each = _transfers(G.ledger(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    jsonl = scratch(spark, "counted")
    sinks.json_rows(t).union(each.select(F.lit("broken"))).union(each.select(F.lit('{"from": "a"}'))).write.text(jsonl)
    got = importers.imported(spark, jsonl, "json")
    return spark.createDataFrame([("jsonl", got.vertices, got.edges, got.errors)], "kind string, vertices long, edges long, errors long")


def import_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "transactions")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digits = F.when(F.col("o_orderkey") % 10 == 0, F.lit("none")).otherwise(F.lpad(F.hex("o_orderkey"), 64, "0"))
    orders.select(digits.alias("hash"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("block"), F.lit("x").alias("more")).write.option("header", True).csv(folder)
    good, counts = importers.transactions_csv(spark, folder)
    return good.groupBy("label").agg(F.countDistinct("hash").alias("n"), F.sum("block_number").alias("blocks")).crossJoin(F.broadcast(counts))


def import_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed vertex and edge files; receivers that no vertex file names become Accounts."""
    g = G.ledger(spark, sf_dir)
    v, e = scratch(spark, "vertices"), scratch(spark, "edges")
    name = lambda end: F.concat(F.lit("v"), F.col(end).cast("string"))
    g.vertices_by_label("Account").select(name("id").alias("address"), F.lit("Payer").alias("label"), F.col("balance").cast("string").alias("balance"), F.lit(1).alias("nonce")).write.option("header", True).csv(v)
    g.edges_by_label("Transfer").select(name("src").alias("from_address"), name("dst").alias("to_address"), F.lit("Transfer").alias("label"), F.col("amount").cast("string").alias("amount"), F.lit("").alias("tx_hash"), "block_number").write.option("header", True).csv(e)
    made = importers.assemble(importers.vertices_csv(spark, v), importers.edges_csv(spark, e), "from_address", "to_address")
    return Engine(spark, made).gql("MATCH (a:Payer)-[t:Transfer]->(b:Account) RETURN b.address AS address, count(*) AS n, sum(t.amount) AS total, sum(a.balance) AS held")


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by label and read again."""
    folder = scratch(spark, "graph")
    G.ledger(spark, sf_dir).write(folder)
    return Engine(spark, Graph.read(spark, folder)).gql("MATCH (a:Account)-[t:Transfer]->(b) RETURN a.name AS name, count(*) AS n, sum(t.amount) AS total")


def flushed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog in a folder, flushed, and opened by another engine."""
    folder = scratch(spark, "catalog")
    e = Engine(spark, folder=folder)
    e.gql("CREATE GRAPH g { NODE P {id INT64 PRIMARY KEY, name STRING}, EDGE K (P)-[{since INT}]->(P) }")
    e.gql("USE g")
    e.gql("INSERT (a:P {name: 'x'})-[:K {since: 3}]->(b:P {name: 'y'})")
    e.catalog.flush()
    return Engine(spark, folder=folder).gql("MATCH (a:P)-[k:K]->(b) RETURN a.name AS a, k.since AS since, b.name AS b")


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON lines, read back."""
    folder = scratch(spark, "json")
    sinks.json_rows(Engine(spark, G.ledger(spark, sf_dir)).gql("MATCH (a:Account) RETURN a.id AS id, a.name AS name, a.nothing AS nothing")).write.text(folder)
    return spark.read.schema("id long, name string, nothing string").json(folder)


def text_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as a box, as vertical rows and as an envelope."""
    df = Engine(spark, G.ledger(spark, sf_dir)).gql("MATCH (a:Account) RETURN a.id AS id, a.nothing AS x ORDER BY id LIMIT 1")
    return spark.createDataFrame([(sinks.table_text(df), sinks.vertical_text(df), json.dumps(json.loads(sinks.envelope(df))))], "box string, vertical string, envelope string")


for _f, _sql in (
    (import_jsonl_roundtrip, f"WITH {LEDGER} {_SUMS}"),
    (import_counts, f"WITH {LEDGER} SELECT 'jsonl' AS kind, 2 * count(*) AS vertices, count(*) AS edges, (SELECT 2 * count(*) FROM supplier) AS errors FROM E WHERE label = 'Transfer'"),
    (import_transactions, "SELECT 'Transaction' AS label, count(*) FILTER (o_orderkey % 10 <> 0) AS n, sum(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) FILTER (o_orderkey % 10 <> 0)::BIGINT AS blocks, count(*) FILTER (o_orderkey % 10 <> 0) AS vertices, count(*) FILTER (o_orderkey % 10 = 0) AS errors FROM orders"),
    (import_generic, f"WITH {LEDGER} SELECT 'v' || dst AS address, count(*) AS n, sum(amount)::BIGINT AS total, sum(balance)::BIGINT AS held FROM E JOIN V ON E.src = V.id WHERE E.label = 'Transfer' GROUP BY dst"),
    (stored_graph, f"WITH {LEDGER} SELECT name, count(*) AS n, sum(amount)::BIGINT AS total FROM E JOIN V ON E.src = V.id WHERE E.label = 'Transfer' GROUP BY name, V.id"),
    (flushed_catalog, "SELECT 'x' AS a, 3 AS since, 'y' AS b"),
    (json_sink, f"WITH {LEDGER} SELECT id, name, NULL::VARCHAR AS nothing FROM V WHERE label = 'Account'"),
    (text_sinks, "SELECT concat_ws(chr(10), '+----+------+', '| id | x    |', '+----+------+', '| 0  | NULL |', '+----+------+', '1 rows') AS box, concat_ws(chr(10), '-- row 1', 'id: 0', ' x: NULL') AS vertical, '{\"success\": true, \"data\": [{\"id\": 0, \"x\": null}], \"error\": null}' AS envelope"),
):
    QUERIES[_f.__name__], SQL[_f.__name__] = _f, _sql

# -- changes by API, catalog, session -------------------------------------------------
on_ledger(
    "add_elements",
    lambda g: Engine(g.spark, g.add_vertices(g.vertices_by_label("Contract").select(F.lit("Copy").alias("label"), F.concat(F.lit("n"), "address").alias("address"), "name")).add_edges(g.vertices_by_label("Account").select(F.lit("Self").alias("label"), F.col("id").alias("src"), F.col("id").alias("dst")))).gql(
        "MATCH (a) RETURN a.label AS label, count(*) AS n, count(DISTINCT a.id) AS k, count(a.balance) AS held"
    ),
    "SELECT label, count(*) AS n, count(*) AS k, count(balance) AS held FROM (SELECT label, balance FROM V UNION ALL SELECT 'Copy', NULL FROM V WHERE label = 'Contract') GROUP BY label",
)
on_ledger("update_elements", lambda g: g.update("vertices", g.vertices_by_label("Contract").withColumn("balance", F.lit(5).cast("long"))).vertices.groupBy("label").agg(F.count("*").alias("n"), F.sum("balance").alias("s")), "SELECT label, count(*) AS n, sum(CASE label WHEN 'Contract' THEN 5 ELSE balance END)::BIGINT AS s FROM V GROUP BY label")
on_ledger("remove_elements", lambda g: g.remove_vertices(g.vertices_by_label("Token")).edges.groupBy("label").agg(F.count("*").alias("n")), "SELECT label, count(*) AS n FROM E WHERE label <> 'Call' GROUP BY label")
_DECLARED = "CREATE GRAPH g { NODE P {id INT64 PRIMARY KEY, name STRING}, EDGE K (P)-[{since INT}]->(P) }"
for _name, _statements, _result, _sql in (
    ("create_graph", (_DECLARED, "USE g", "INSERT (a:P {name: 'x'})-[:K {since: 3}]->(b:P {name: 'y'})"), "MATCH (a:P)-[k:K]->(b) RETURN a.name AS a, k.since AS since, b.name AS b", "SELECT 'x' AS a, 3 AS since, 'y' AS b"),
    ("drop_graph", (_DECLARED, "DROP GRAPH g", "DROP GRAPH IF EXISTS g"), "SHOW GRAPHS", f"WITH {LEDGER} SELECT 'default' AS name, 'Closed' AS type, (SELECT count(*) FROM V) AS vertex_count, (SELECT count(*) FROM E) AS edge_count"),
    ("use_graph", (_DECLARED,), "USE g", "SELECT 'g' AS current_graph"),
    ("describe_graph", (), "DESCRIBE GRAPH default", f"WITH {LEDGER} SELECT 'default' AS name, 'Closed' AS type, (SELECT count(*) FROM V) AS vertex_count, (SELECT count(*) FROM E) AS edge_count"),
    ("describe_declared", (_DECLARED, "USE g"), "DESCRIBE LABEL P", "SELECT * FROM (VALUES ('id', 'INT64', true), ('name', 'STRING', false)) AS t(property, type, primary_key)"),
    ("describe_edge_type", (), "DESCRIBE EDGE TYPE __Call", "SELECT * FROM (VALUES ('method', 'STRING', false), ('tx_hash', 'STRING', false), ('block_number', 'INT64', false), ('success', 'BOOL', false)) AS t(property, type, primary_key)"),
    ("describe_graph_type", (), "DESCRIBE GRAPH TYPE __tron", "SELECT 'node' AS kind, '__' || unnest(['Account', 'Transaction', 'Block', 'Token', 'Contract']) AS name UNION ALL SELECT 'edge', '__' || unnest(['Transfer', 'TxRel', 'Call', 'Approval', 'TokenTransfer'])"),
    ("template_graph", ("CREATE GRAPH g { NODE __bsc }", "USE g"), "SHOW CONSTRAINTS", "SELECT * FROM (VALUES ('__Account', 'address', 'PRIMARY KEY'), ('__Transaction', 'hash', 'PRIMARY KEY'), ('__Block', 'number', 'PRIMARY KEY'), ('__Token', 'address', 'PRIMARY KEY'), ('__Contract', 'address', 'PRIMARY KEY')) AS t(label, property, kind)"),
    ("session_value", ("SESSION SET $floor = 5000000",), "MATCH (a)-[t:Transfer]->(b) WHERE t.amount > $floor RETURN count(*) AS n", f"WITH {LEDGER} SELECT count(*) AS n FROM E WHERE label = 'Transfer' AND amount > 5000000"),
    ("rolled_back", ("START TRANSACTION", "MATCH (c:Contract) DETACH DELETE c", "ROLLBACK"), "MATCH (c:Contract) RETURN count(*) AS n", f"WITH {LEDGER} SELECT count(*) AS n FROM V WHERE label = 'Contract'"),
    ("committed", ("START TRANSACTION", "MATCH (c:Contract) DETACH DELETE c", "COMMIT"), "MATCH (c:Contract) RETURN count(*) AS n", "SELECT 0::BIGINT AS n"),
    ("labels_in_use", (), "CALL db.labels()", f"WITH {LEDGER} SELECT DISTINCT label FROM V"),
):
    QUERIES[_name], SQL[_name] = after(*_statements, result=_result), _sql
SQL["show_indexes"] = "SELECT * FROM (VALUES ('vertices', 'label', 'partition'), ('edges', 'label', 'partition'), ('edges', 'src', 'sort')) AS t(\"table\", \"column\", kind)"
SQL["show_constraints"] = SQL["template_graph"]
SQL["show_graph_types"] = "SELECT unnest(['__ethereum', '__tron', '__bsc', '__polygon']) AS name, '__Account, __Transaction, __Block, __Token, __Contract' AS node_types, '__Transfer, __TxRel, __Call, __Approval, __TokenTransfer' AS edge_types"
SQL["show_labels"] = "SELECT * FROM (VALUES ('__Transaction', 'hash: STRING, block_number: INT64, block_timestamp: INT64, value: STRING, gas_used: INT64, gas_price: STRING, status: INT', 'Blockchain transaction'), ('__Token', 'address: STRING, name: STRING, symbol: STRING, decimals: INT, total_supply: STRING', 'Token')) AS t(label, properties, description)"
SQL["show_edge_types"] = """SELECT * FROM (VALUES
('__Transfer', '__Account', '__Account', 'token_address: STRING, first_time: INT64, last_time: INT64, sum: STRING, tx_count: INT64', 'Aggregated transfers'),
('__TxRel', '__Account', '__Transaction', 'type: STRING, value: STRING', 'Account and its transaction'),
('__Call', '__Account', '__Contract', 'method: STRING, tx_hash: STRING, block_number: INT64, success: BOOL', 'Contract call'),
('__Approval', '__Account', '__Account', 'token_address: STRING, amount: STRING, tx_hash: STRING', 'Token approval'),
('__TokenTransfer', '__Account', '__Account', 'token_address: STRING, amount: STRING, tx_hash: STRING, log_index: INT', 'Single token transfer')) AS t(type, source, target, properties, description)"""

# -- procedures and flows ---------------------------------------------------------------
SQL["call_shortest_path"] = f"WITH RECURSIVE {HANDOFF} {_weighed(4)} SELECT {_TEXT} AS path, d::INT AS length, tw AS total_weight FROM w WHERE d >= 1 AND cur = (SELECT t FROM ends) ORDER BY d, es LIMIT 1"
handoff(
    "call_shortest_path_whole",
    lambda e, s, t: e.call("shortest_path", s, t).where("length >= 1"),
    """, r(v, d, vs, es, tw) USING KEY (v) AS (
  SELECT s, 0, [s], []::BIGINT[], 0::DOUBLE FROM ends
  UNION SELECT E.dst, r.d + 1, arg_min(list_append(vs, E.dst), list_append(es, E.id)), min(list_append(es, E.id)), arg_min(tw + E.amount, list_append(es, E.id))
  FROM r JOIN E ON r.v = E.src WHERE E.dst NOT IN (SELECT v FROM recurring.r) GROUP BY E.dst, r.d) """
    + f"SELECT {_TEXT} AS path, d::INT AS length, tw AS total_weight FROM r WHERE d >= 1 AND v = (SELECT t FROM ends)",
)
handoff("call_yield", lambda e, s, t: e.gql("CALL neighbors($s) YIELD direction AS dir, neighbor_id AS v RETURN dir, count(*) AS n, count(DISTINCT v) AS k", {"s": s}), "SELECT dir, count(*) AS n, count(DISTINCT v) AS k FROM (SELECT 'out' AS dir, dst AS v FROM E, ends WHERE src = s UNION ALL SELECT 'in', src FROM E, ends WHERE dst = s) GROUP BY dir")
handoff("optional_call", lambda e, s, t: e.gql("OPTIONAL CALL degree($s) YIELD out_degree AS o RETURN o", {"s": s}), "SELECT count(*) AS o FROM E, ends WHERE src = s")
handoff("path_to_itself", lambda e, s, t: e.call("shortest_path", s, s), "SELECT s::VARCHAR AS path, 0 AS length, 0::DOUBLE AS total_weight FROM ends")
handoff(
    "shortest_to_target",
    lambda e, s, t: e.gql("MATCH p = ALL SHORTEST (a WHERE a.id = $s)-[:Transfer]->{1,4}(b WHERE b.id = $t) RETURN b.id AS b, length(p) AS d, count(*) AS n", {"s": s, "t": t}),
    _levels(4, _SIMPLE) + "SELECT cur AS b, d::INT AS d, count(*) AS n FROM w WHERE d >= 1 AND cur = (SELECT t FROM ends) AND d = (SELECT min(d) FROM w WHERE d >= 1 AND cur = (SELECT t FROM ends)) GROUP BY ALL",
)


def certificate(graph: Graph, source: int, target: int, most_edges: int = flow.MOST_EDGES) -> DataFrame:
    """One row on a maximum flow: whether it keeps within the capacities, whether vertices pass on what they get, and whether a cut is as small as it is large."""
    found = flow.solved(graph, source, target, most_edges)
    caps = flow.capacities(graph)
    used = found.where("kind = 'flow'").select("src", "dst", "flow")
    bounded = used.join(caps, ["src", "dst"], "left").agg(F.coalesce(F.bool_and(F.coalesce(F.col("flow") <= F.col("cap"), F.lit(False))), F.lit(True)).alias("bounded"))
    net = used.select(F.col("src").alias("v"), F.col("flow").alias("x")).union(used.select("dst", -F.col("flow"))).groupBy("v").agg(F.sum("x").alias("x"))
    conserved = net.agg(F.coalesce(F.bool_and((F.col("x") == 0) | F.col("v").isin(source, target)), F.lit(True)).alias("conserved"), F.coalesce(F.max(F.when(F.col("v") == source, F.col("x"))), F.lit(0)).alias("out"))
    side = flow.min_cut(graph, source, target, most_edges).select(F.col("id").alias("s"))
    crossing = caps.join(side, F.col("src") == F.col("s"), "left_semi").join(side, F.col("dst") == F.col("s"), "left_anti").agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cut"))
    value = found.where("kind = 'value'").select(F.col("flow").alias("value"))
    row = value.crossJoin(bounded).crossJoin(conserved).crossJoin(crossing)
    return row.select("bounded", "conserved", (F.col("value") == F.col("out")).alias("leaves_source"), (F.col("value") == F.col("cut")).alias("equals_cut"))


QUERIES["max_flow_certificate"] = lambda spark, sf_dir: certificate(G.nation_trade(spark, sf_dir), 1, 2)
SQL["max_flow_certificate"] = "SELECT true AS bounded, true AS conserved, true AS leaves_source, true AS equals_cut"


def multi_flow_is_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow of two pairs beside the flows of each."""
    g = G.nation_trade(spark, sf_dir)
    both = flow.multi_source_sink_max_flow(g, [(1, 2), (3, 4)])
    one, two = (flow.max_flow(g, s, t).withColumnRenamed("value", f"v{s}") for s, t in ((1, 2), (3, 4)))
    return both.crossJoin(one).crossJoin(two).select((F.col("value") == F.col("v1") + F.col("v3")).alias("is_sum"), (F.col("value") > 0).alias("positive"))


def bottlenecks_are_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the pairs that a flow fills stand to the least cut: all pairs that cross it are among them."""
    g = G.nation_trade(spark, sf_dir)
    full = flow.find_bottleneck_edges(g, 1, 2)
    side = flow.min_cut(g, 1, 2)
    caps = flow.capacities(g)
    crossing = caps.join(side, F.col("src") == F.col("id"), "left_semi").join(side, F.col("dst") == F.col("id"), "left_anti")
    return crossing.join(full.withColumnRenamed("cap", "full"), ["src", "dst"], "left").agg(F.coalesce(F.bool_and(F.coalesce(F.col("cap") == F.col("full"), F.lit(False))), F.lit(True)).alias("all_full"))


for _f, _sql in ((multi_flow_is_sum, "SELECT true AS is_sum, true AS positive"), (bottlenecks_are_full, "SELECT true AS all_full")):
    QUERIES[_f.__name__], SQL[_f.__name__] = _f, _sql

# -- what SHOW lists, spelled out -------------------------------------------------------
SQL["show_procedures"] = """SELECT * FROM (VALUES
('shortest_path', 'source, target', 'Shortest directed path'), ('all_paths', 'source, target [, depth [, limit]]', 'Simple directed paths'),
('k_shortest_paths', 'source, target, k [, depth]', 'The k shortest simple paths'), ('trace', 'vertex [, direction [, depth [, limit]]]', 'Simple paths from a vertex'),
('trace_fund_flow', 'vertex [, depth [, limit]]', 'Forward over Transfer edges'), ('trace_fund_source', 'vertex [, depth [, limit]]', 'Backward over Transfer edges'),
('n_hop_neighbors', 'vertex, n', 'Vertices at a distance of n'), ('neighbors', 'vertex [, direction]', 'Adjacent vertices, an edge each'), ('degree', 'vertex', 'In- and out-degree'),
('connected', 'source, target', 'Directed reachability'), ('max_flow', 'source, target [, limit]', 'Maximum flow and its edges'), ('min_cut', 'source, target', 'Source side of the least minimum cut'),
('bottleneck_edges', 'source, target', 'Pairs that a maximum flow fills'), ('multi_max_flow', 'source, target [, source, target ...]', 'Sum of the pairs'' maximum flows'),
('db.labels', '', 'Vertex labels in use')) AS t(name, parameters, description)"""
SQL["show_property_keys"] = """SELECT split_part(x, ' ', 1) AS property, split_part(x, ' ', 2) AS type, defined_by FROM (SELECT unnest(string_split(props, ', ')) AS x, defined_by FROM (VALUES
('address STRING, entity_label STRING, risk_label STRING, first_seen_block INT64, last_active_block INT64', '__Account'),
('hash STRING, block_number INT64, block_timestamp INT64, value STRING, gas_used INT64, gas_price STRING, status INT', '__Transaction'),
('number INT64, hash STRING, parent_hash STRING, timestamp INT64, miner STRING, tx_count INT64', '__Block'),
('address STRING, name STRING, symbol STRING, decimals INT, total_supply STRING', '__Token'),
('address STRING, name STRING, creator STRING, creation_block INT64, is_verified BOOL, bytecode_hash STRING', '__Contract'),
('token_address STRING, first_time INT64, last_time INT64, sum STRING, tx_count INT64', '__Transfer'),
('type STRING, value STRING', '__TxRel'),
('method STRING, tx_hash STRING, block_number INT64, success BOOL', '__Call'),
('token_address STRING, amount STRING, tx_hash STRING', '__Approval'),
('token_address STRING, amount STRING, tx_hash STRING, log_index INT', '__TokenTransfer')) AS t(props, defined_by))"""
SQL["show_functions"] = """SELECT name, CASE WHEN name IN ('COUNT', 'SUM', 'AVG', 'MIN', 'MAX', 'COLLECT', 'STDDEV', 'STDDEV_SAMP', 'STDDEV_POP', 'VARIANCE', 'VAR_SAMP', 'VAR_POP', 'APPROX_COUNT_DISTINCT', 'PERCENTILE_APPROX') THEN 'aggregate' ELSE 'scalar' END AS kind
FROM (SELECT unnest(string_split('COUNT SUM AVG MIN MAX COLLECT STDDEV STDDEV_SAMP STDDEV_POP VARIANCE VAR_SAMP VAR_POP APPROX_COUNT_DISTINCT PERCENTILE_APPROX ID LABEL TOSTRING TOINTEGER TOFLOAT SIZE RANGE NODES EDGES PATH_LENGTH ABS CEIL FLOOR ROUND SQRT EXP LN LOG10 SIGN SIN COS TAN GREATEST LEAST COALESCE NULLIF LENGTH CHAR_LENGTH OCTET_LENGTH LOWER UPPER TRIM LTRIM RTRIM SUBSTRING REPLACE REVERSE SPLIT CONCAT CONCAT_WS LPAD RPAD REGEXP_EXTRACT REGEXP_REPLACE ELEMENT_AT ARRAY_DISTINCT ARRAY_UNION ARRAY_INTERSECT ARRAY_MAX ARRAY_MIN ARRAY_SORT SLICE FLATTEN MAP_KEYS MAP_VALUES GET_JSON_OBJECT TO_JSON CURRENT_DATE CURRENT_TIMESTAMP DATE_TRUNC DATEDIFF YEAR MONTH DAY HEX UNHEX CONV MOD POWER', ' ')) AS name)"""
