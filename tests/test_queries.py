"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

from ledgerlake import queries as Q  # noqa: E402
from ledgerlake.engine import Engine  # noqa: E402
from ledgerlake.sources import testgraphs  # noqa: E402

SOME = [
    "label_scan", "label_negation", "expand_any", "two_hop", "inline_where", "comma_join", "shared_var_cycle", "optional_match", "exists_in_or", "path_union", "order_topk", "select_group_having",
    "agg_all", "arith_ops", "list_quantifiers", "for_range", "except_all", "otherwise_q", "var_len_trail", "var_len_simple", "quantified_paren", "all_shortest", "shortest_k_groups", "trace_backward", "max_flow_layered",
    "set_properties", "import_csv_roundtrip",
]


#: Queries with a small, fixed answer.  They name a few ids, so that the registry does not hold them; it has each one over whole tables.
BOUNDED: dict = {}


def bounded(name, text, sql):
    BOUNDED[name] = (lambda spark, sf_dir: Engine(spark, testgraphs.ledger(spark, sf_dir)).gql(text), f"WITH RECURSIVE {Q.LEDGER} {sql}")


bounded("expand_any", "MATCH (a)-[t:Transfer]-(b) WHERE a.id < 50 RETURN a.id AS a, b.id AS b, t.id AS t", "SELECT src AS a, dst AS b, id AS t FROM E WHERE label = 'Transfer' AND src < 50 UNION ALL SELECT dst, src, id FROM E WHERE label = 'Transfer' AND dst < 50")
bounded(
    "different_edges",
    "MATCH DIFFERENT EDGES (a:Account)-[t:Transfer]->(c)<-[u:Transfer]-(b:Account) WHERE a.id < 20 AND b.id < 20 RETURN count(*) AS n",
    "SELECT count(*) AS n FROM E t JOIN E u ON t.dst = u.dst AND t.id <> u.id WHERE t.label = 'Transfer' AND u.label = 'Transfer' AND t.src < 20 AND u.src < 20",
)
bounded(
    "path_union",
    "MATCH (a:Account {address: 'a:3'})-[:Transfer]->(b) | (a:Account {address: 'a:3'})-[:TxRel]->(b) RETURN b.id AS b",
    "SELECT b FROM (SELECT DISTINCT V.id AS b, E.id AS e FROM V JOIN E ON V.id = dst WHERE src = 3 AND E.label IN ('Transfer', 'TxRel'))",
)
bounded("multiset_union", "MATCH (a:Account {address: 'a:3'})-[t:Transfer]->(b) |+| (a:Account {address: 'a:3'})-[t:Transfer]->(b) RETURN count(*) AS n", "SELECT 2 * count(*) AS n FROM E WHERE src = 3 AND label = 'Transfer'")
bounded("return_vertex", "MATCH (a:Contract) WHERE a.id < 1000000010 RETURN a.id AS id, label(a) AS l, a.nothing IS NULL AS missing", "SELECT id, label AS l, true AS missing FROM V WHERE label = 'Contract' AND id < 1000000010")
bounded("order_nulls", "MATCH (a) WHERE a.id < 3000000005 RETURN a.id AS id, a.name AS name ORDER BY name NULLS FIRST, id DESC LIMIT 12", "SELECT id, name FROM V WHERE id < 3000000005 ORDER BY name NULLS FIRST, id DESC LIMIT 12")
_A = "MATCH (a:Account) WHERE a.id < 30 RETURN a.id % 7 AS k"
_B = "MATCH (a:Account) WHERE a.id > 20 AND a.id < 45 RETURN a.id % 5 AS k"
_SA = "SELECT id % 7 AS k FROM V WHERE label = 'Account' AND id < 30"
_SB = "SELECT id % 5 AS k FROM V WHERE label = 'Account' AND id > 20 AND id < 45"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("except_q", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect_q", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):
    bounded(_name, f"{_A} {_op} {_B}", f"{_SA} {_op} {_SB}")
bounded("otherwise_q", f"MATCH (a:Nothing) RETURN a.id AS k OTHERWISE {_B}", _SB)
bounded("otherwise_first", f"{_A} OTHERWISE {_B}", _SA)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [*SOME, *(b for b in BOUNDED if b not in SOME)])
def test_query(spark, con, name):
    query, sql = BOUNDED.get(name) or (Q.QUERIES[name], Q.SQL[name])
    got = query(spark, SF)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


WHOLE = [
    "different_edges", "expand_any", "union_all", "union_distinct", "except_q", "except_all", "intersect_q", "intersect_all", "otherwise_q", "otherwise_first", "return_vertex", "order_nulls", "multiset_union", "path_union",
]


@pytest.mark.parametrize("name", WHOLE)
def test_query_over_whole_tables(spark, con, name):
    test_query(spark, con, f"{name}_whole")
    assert not any(x in Q.SQL[f"{name}_whole"].removeprefix(f"WITH RECURSIVE {Q.LEDGER}") for x in ("id <", "src <", "src =", "id >"))


@pytest.mark.parametrize("name", BOUNDED)
def test_bounded_queries_are_not_registered(name):
    assert name not in Q.QUERIES and f"{name}_whole" in Q.QUERIES


def test_every_sql_has_a_query():
    assert set(Q.SQL) <= set(Q.QUERIES)
