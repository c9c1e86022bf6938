"""Hand-computed fixtures for algorithms, changes, catalog and import."""

from decimal import Decimal

import pytest

from ledgerlake.engine import Engine
from ledgerlake.operators import flow, paths
from ledgerlake.operators.expressions import GqlError
from ledgerlake.sources.graph import Graph

LEDGER = [
    (1, 1, 2, 100), (2, 2, 3, 100), (3, 3, 4, 100), (4, 1, 5, 100), (5, 5, 4, 100),
]


def graph(spark, edges, label="Transfer"):
    ids = sorted({x for _, a, b, _ in edges for x in (a, b)})
    v = spark.createDataFrame([(i, "Account", f"a{i}", f"n{i}") for i in ids], "id long, label string, address string, name string")
    e = spark.createDataFrame([(i, label, a, b, Decimal(w), 0) for i, a, b, w in edges], "id long, label string, src long, dst long, amount decimal(38,0), block_number long")
    return Graph(v, e)


@pytest.fixture(scope="module")
def diamond(spark):
    return graph(spark, LEDGER)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_shortest_path(diamond):
    assert rows(paths.rendered(paths.shortest_path(diamond, 1, 4))) == [("1 -> 5 -> 4", 2, 200.0)]
    assert rows(paths.shortest_path(diamond, 4, 1)) == []
    assert rows(paths.shortest_path(diamond, 9, 9)) == [([9], [], 0, 0.0)]


def test_all_paths_and_trace(diamond):
    assert sorted(rows(paths.rendered(paths.all_paths(diamond, 1, 4, 5)))) == [("1 -> 2 -> 3 -> 4", 3, 300.0), ("1 -> 5 -> 4", 2, 200.0)]
    assert sorted(r[0] for r in rows(paths.rendered(paths.trace(diamond, 1, "forward", 3)))) == ["1 -> 2", "1 -> 2 -> 3", "1 -> 2 -> 3 -> 4", "1 -> 5", "1 -> 5 -> 4"]
    assert [r[0] for r in rows(paths.rendered(paths.k_shortest_paths(diamond, 1, 4, 1)))] == ["1 -> 5 -> 4"]


def test_n_hop(diamond):
    got = [sorted(r[0] for r in rows(paths.n_hop_neighbors(diamond, 1, n))) for n in (1, 2, 3)]
    assert got == [[2, 5], [3, 4], []]


@pytest.mark.parametrize(
    ("edges", "s", "t", "value"),
    [
        ([(1, 1, 2, 10), (2, 1, 3, 5), (3, 2, 5, 10), (4, 3, 4, 10), (5, 4, 2, 5), (6, 4, 5, 10)], 1, 5, 15),
        ([(1, 1, 2, 10), (2, 2, 3, 5)], 1, 3, 5),
        ([(1, 1, 2, 5), (2, 2, 4, 5), (3, 1, 3, 10), (4, 3, 4, 10)], 1, 4, 15),
        (LEDGER, 1, 4, 200),
        (LEDGER, 4, 1, 0),
    ],
)
def test_max_flow(spark, edges, s, t, value):
    g = graph(spark, edges)
    solved = rows(flow.solved(g, s, t))
    assert [r[3] for r in solved if r[0] == "value"] == [value]
    side = {r[1] for r in solved if r[0] == "side"}
    caps = {(a, b): w for _, a, b, w in edges}
    assert s in side and (value == 0 or t not in side)
    assert sum(w for (a, b), w in caps.items() if a in side and b not in side) == value
    used = {(r[1], r[2]): int(r[3]) for r in solved if r[0] == "flow"}
    assert all(used[k] <= caps[k] for k in used)
    for v in {x for k in caps for x in k} - {s, t}:
        assert sum(w for (a, b), w in used.items() if b == v) == sum(w for (a, b), w in used.items() if a == v)


def test_changes(spark, diamond):
    e = Engine(spark, diamond)
    assert rows(e.gql("INSERT (a:Contract {address: 'new'})-[:Call {amount: 5}]->(b:Account {address: 'a1'})")) == [(3,)]
    assert rows(e.gql("MATCH (a:Contract)-[t:Call]->(b) RETURN a.address, t.amount, b.id")) == [("new", Decimal(5), 1)]
    e.gql("MATCH (a {address: 'new'}) SET a.name = 'x', a.score = 7")
    assert rows(e.gql("MATCH (a:Contract) RETURN a.name, a.score, a.nothing")) == [("x", 7, None)]
    with pytest.raises(GqlError):
        e.gql("MATCH (a:Contract) DELETE a")
    assert rows(e.gql("MATCH (a:Contract) DETACH DELETE a")) == [(1,)]
    assert rows(e.gql("MATCH (a)-[t:Call]->(b) RETURN count(*) AS n")) == [(0,)]


def test_catalog(spark, tmp_path):
    folder = f"file://{tmp_path}/graphs"
    e = Engine(spark, folder=folder)
    e.gql("CREATE GRAPH g { NODE P {id INT64 PRIMARY KEY, name STRING}, EDGE K (P)-[{since INT}]->(P) }")
    e.gql("USE g")
    e.gql("INSERT (a:P {name: 'x'})-[:K {since: 3}]->(b:P {name: 'y'})")
    e.catalog.flush()
    again = Engine(spark, folder=folder)
    assert rows(again.gql("MATCH (a:P)-[k:K]->(b) RETURN a.name, k.since, b.name")) == [("x", 3, "y")]
    assert rows(again.gql("DESCRIBE LABEL P")) == [("id", "INT64", True), ("name", "STRING", False)]
    for bad in ("CREATE GRAPH h { NODE __Mine {id INT PRIMARY KEY} }", "CREATE GRAPH h { NODE A {x INT} }", "CREATE GRAPH h { NODE A {x INT PRIMARY KEY, x INT} }", "CREATE GRAPH h { EDGE E (A)-[]->(B) }", "CREATE GRAPH g"):
        with pytest.raises(ValueError):
            again.gql(bad)
    again.gql("CREATE GRAPH IF NOT EXISTS g")
    again.gql("DROP GRAPH g")
    assert rows(again.gql("SHOW GRAPHS")) == []


def test_import(spark, tmp_path):
    from ledgerlake.sources.importers import transactions_csv, transfers_csv, transfers_jsonl

    f = tmp_path / "t.csv"
    f.write_text("from,to,amount,block\n b , a ,5,1\na,c,x,2\nshort,line\nb,c,7,y,extra\n")
    got = transfers_csv(spark, str(f))
    assert (got.vertices, got.edges, got.errors) == (6, 3, 1)
    assert sorted(rows(got.graph.vertices.select("id", "address"))) == [(1, "b"), (2, "a"), (3, "c")]
    assert sorted(rows(got.graph.edges.select("id", "src", "dst", "amount", "block_number"))) == [(1, 1, 2, 5, 1), (2, 2, 3, 0, 2), (3, 1, 3, 7, 0)]
    j = tmp_path / "t.jsonl"
    j.write_text('{"from":"a","to":"b","value":"9","block_number":4}\nnonsense\n{"from":"a"}\n')
    got = transfers_jsonl(spark, str(j))
    assert (got.edges, got.errors) == (1, 2)
    x = tmp_path / "x.csv"
    x.write_text(f"hash,block,more\n0x{'A' * 64},7,z\nbad,1,z\n{'b' * 64},q,z\n")
    good, stats = transactions_csv(spark, str(x))
    assert sorted(rows(good.select("hash", "block_number"))) == [("0x" + "a" * 64, 7), ("0x" + "b" * 64, 0)]
    assert rows(stats) == [(2, 1)]
