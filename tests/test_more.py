"""Sinks, command line, distributed flows, and some of the further queries against their SQL."""

import json

import pytest
from test_engine import LEDGER, graph, rows
from test_queries import con, test_query  # noqa: F401

from ledgerlake import queries_more  # noqa: F401  registers its queries
from ledgerlake.engine import Engine
from ledgerlake.operators import flow

SOME = [
    "reuse_props", "reuse_label_kept", "reuse_in_comma", "optional_outer", "exists_outer", "exists_outer_in_or", "edge_ids_are_unique", "wave_in", "wave_out", "distinct_aggregates", "more_functions", "import_jsonl_roundtrip", "import_counts",
    "import_transactions", "import_generic", "stored_graph", "json_sink", "add_elements", "session_value", "rolled_back", "show_labels", "describe_graph_type", "max_flow_certificate", "bottlenecks_are_full", "delete_elements",
]


@pytest.mark.parametrize("name", SOME)
def test_further_query(spark, con, name):  # noqa: F811
    test_query(spark, con, name)


@pytest.mark.parametrize(
    ("edges", "s", "t"),
    [
        ([(1, 1, 2, 10), (2, 1, 3, 5), (3, 2, 5, 10), (4, 3, 4, 10), (5, 4, 2, 5), (6, 4, 5, 10)], 1, 5),
        ([(1, 1, 2, 1000), (2, 1, 3, 1000), (3, 2, 3, 1), (4, 2, 4, 1000), (5, 3, 4, 1000)], 1, 4),
        (LEDGER, 4, 1),
    ],
)
def test_flow_of_a_network_that_stays_distributed(spark, edges, s, t):
    g = graph(spark, edges)
    small, large = (flow.solved(g, s, t, most).cache() for most in (1000, 0))
    for kind in ("value", "side"):
        assert sorted(map(str, rows(small.where(f"kind = '{kind}'")))) == sorted(map(str, rows(large.where(f"kind = '{kind}'"))))
    assert set(queries_more.certificate(g, s, t, 0).first()) == {True}


def test_least_cut_holds_dead_ends(spark):
    g = graph(spark, [(1, 1, 2, 5), (2, 2, 3, 2), (3, 2, 7, 9), (4, 7, 8, 1), (5, 3, 9, 1), (6, 10, 3, 1)])
    assert sorted(r.id for r in flow.min_cut(g, 1, 3).collect()) == [1, 2, 7, 8]
    assert sorted(r.id for r in flow.min_cut(g, 9, 1).collect()) == [9]
    assert sorted(r.id for r in flow.min_cut(g, 1, 10).collect()) == [1, 2, 3, 7, 8, 9]
    assert sorted(r.id for r in flow.min_cut(g, 1, 3, most_edges=0).collect()) == [1, 2, 7, 8]


def test_repeated_ids_are_found(spark):
    g = graph(spark, [(1, 1, 2, 5), (1, 2, 3, 5), (2, 1, 3, 5)])
    assert rows(g.repeated_ids()) == [("edge", 1, 2)]


def test_distinct_spread_needs_a_property(spark):
    from ledgerlake.operators.expressions import GqlError

    e = Engine(spark, graph(spark, LEDGER))
    assert rows(e.gql("MATCH (a)-[t]->(b) RETURN avg(DISTINCT t.amount) AS m, stddev(DISTINCT t.src) AS s"))[0][0] == 100
    with pytest.raises(GqlError):
        e.gql("MATCH (a)-[t]->(b) RETURN stddev(DISTINCT t.src + 1) AS s")


def test_command_line(spark, tmp_path):
    from ledgerlake.cli import main

    (tmp_path / "t.csv").write_text("from,to,amount,block\na,b,5,1\nb,c,7,2\nbad\n")
    (tmp_path / "s.gql").write_text("# receivers\n\nMATCH (a)-[t:Transfer]->(b) RETURN b.address AS b, t.amount AS x ORDER BY x\nMATCH (a RETURN\n")
    said = []
    data, show = str(tmp_path / "g"), said.append
    assert main(["import", "-i", str(tmp_path / "t.csv"), "-f", "xml", "-d", data], spark, show) == 1
    assert main(["import", "-i", str(tmp_path / "t.csv"), "-d", data], spark, show) == 0
    assert said[0] == "unknown format xml" and said[1].startswith("4 vertices, 2 edges, 1 errors")
    del said[:]
    assert main(["query", "-d", data, "-s", str(tmp_path / "s.gql"), "--format", "json", "--tee", str(tmp_path / "out")], spark, show) == 1
    first, second = map(json.loads, said)
    assert first == {"success": True, "data": [{"b": "b", "x": 5}, {"b": "c", "x": 7}], "error": None}
    assert not second["success"] and second["data"] is None
    assert (tmp_path / "out").read_text() == "\n".join(said) + "\n"
    del said[:]
    assert main(["query", "-d", data, "-e", "MATCH (a) RETURN a.address AS a ORDER BY a LIMIT 1", "--format", "vertical"], spark, show) == 0
    assert main(["stats", "-d", data], spark, show) == 0
    assert said[0] == "-- row 1\na: a" and "| default | Closed | 3            | 2          |" in said[1]


@pytest.mark.parametrize("name", ["call_shortest_path", "call_shortest_path_whole"])
@pytest.mark.parametrize(("users", "steps"), [(1, 0), (2, 0), (6, 4), (7, 5)])
def test_shortest_path_has_the_length_its_sql_walks(spark, tmp_path, name, users, steps):
    """Users who hand on in a row: the last to hand on is so many steps from the first."""
    import datetime

    import duckdb
    from test_queries import Q, plain

    start = datetime.datetime(2024, 1, 1, 20)
    events = [(i, start + datetime.timedelta(hours=i), i, "purchase", 1.0 + i, None) for i in range(users)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = Q.QUERIES[name](spark, str(tmp_path)), c.sql(Q.SQL[name])
    found = got.collect()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(found, got.columns) == plain(want.fetchall(), want.columns)
    assert [r.length for r in found] == ([steps] if steps and (steps <= 4 or name.endswith("_whole")) else [])


def test_long_shortest_path_among_cycles(spark):
    from ledgerlake.operators import paths

    chain = [(i, i, i + 1, 1) for i in range(1, 19)]
    back = [(100 + i, i, i - 2, 1) for i in range(3, 20)]
    g = graph(spark, [*chain, *back, (200, 1, 2, 5), (0, 18, 1, 1)])
    assert rows(paths.shortest_path(g, 1, 19)) == [(list(range(1, 20)), list(range(1, 19)), 18, 18.0)]
    assert rows(paths.shortest_path(g, 1, 20)) == []
