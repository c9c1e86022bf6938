"""Statements that have to parse, and ones that must not."""

import pytest

from ledgerlake.plans import ast as A
from ledgerlake.plans.parser import GqlSyntaxError, parse


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n) RETURN n",
        "MATCH (N:Account {address: '0x1', k: 1.5}) WHERE n.a >= 1 RETURN N AS x LIMIT 3;",
        "MATCH p = TRAIL SHORTEST 2 GROUPS (a)-[e:T|U WHERE e.x > 1]->{1,3}(b) KEEP ANY SHORTEST RETURN p",
        "MATCH (a)-->(b)<--(c)--(d)~[x]~(e)<~[y]~(f)~[z]~>(g)<-[w]->(h)->(i)<-(j)-(k)~(l) RETURN *",
        "MATCH DIFFERENT EDGES (a)-[:T]-(b), (b)-[:U]->(c) RETURN count(*) AS n ORDER BY n DESC NULLS LAST SKIP 1 LIMIT 2",
        "OPTIONAL MATCH ((a)-[e]->(b) WHERE e.x = 1){1,5} RETURN a",
        "MATCH (a)-[:X]->(b) |+| (a)<-[:Y]-(b) RETURN a-5, -2^2, a.x || 'q'",
        "SELECT DISTINCT a, count(*) AS n FROM g WHERE a > 1 GROUP BY a HAVING count(*) > 2 ORDER BY n LIMIT 20 OFFSET 40",
        "FOR x, i IN [1, 2] RETURN x UNION ALL LET y = {a: 1} RETURN y EXCEPT FOR z IN range(1, 3) RETURN z",
        "CALL algo.shortest_path(1, -5) YIELD path AS p, length",
        "CREATE GRAPH IF NOT EXISTS g { NODE A {id STRING PRIMARY KEY, s SET<INT>}, EDGE E (A)-[{x INT}]->(A), NODE __Account }",
        "INSERT (a:Account {address: 'x'})-[:Transfer {amount: 5}]->(b)",
        "MATCH (a) SET a.x = 1, a:L, a += {y: 2}",
        "MATCH (a) DETACH DELETE a",
        "SHOW LABELS LIKE '__%'",
        "DESCRIBE GRAPH TYPE __ethereum",
        "SESSION SET TIME ZONE 'UTC'",
        "START TRANSACTION READ ONLY",
        "// note\nMATCH (a) /* more */ RETURN a",
        "-- note\nMATCH (a) RETURN CASE WHEN a.x IS NULL THEN 1 ELSE 2 END",
        "MATCH (a) WHERE ALL(x IN [1] WHERE x > 0) AND NOT EXISTS { (a)-[]->() } RETURN a",
    ],
)
def test_parses(text):
    parse(text)


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "MATCH (a) RETURN a trailing nonsense", "RETURN 99999999999999999999", "MATCH (a)-[e]->{3,1}(b) RETURN a", "", "SHOW NOTHING", "RETURN 'open"])
def test_rejects(text):
    with pytest.raises(GqlSyntaxError):
        parse(text)


def test_precedence():
    item = parse("RETURN 1 + 2 * 3 ^ 2").result.items[0].expr
    assert item == A.Binary("+", A.Lit(1), A.Binary("*", A.Lit(2), A.Binary("^", A.Lit(3), A.Lit(2))))
    assert parse("RETURN a OR b AND NOT c = 1").result.items[0].expr.op == "OR"


def test_edge_directions():
    path = parse("MATCH (a)-[]->(b)<-[]-(c)-[]-(d)<~[]~(e)~[]~>(f) RETURN a").steps[0].pattern.paths[0]
    assert [x.direction for x in path.terms[0][1::2]] == ["out", "in", "any", "in", "out"]
