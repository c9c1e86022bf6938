"""HTTP service, console and metrics over a small graph."""

import io
import json
import sys
import threading
import urllib.error
import urllib.request

import pytest
from test_engine import LEDGER, graph

from ledgerlake.console import Console
from ledgerlake.engine import Engine
from ledgerlake.metrics import Metrics, prometheus
from ledgerlake.service import LONGEST, Service


@pytest.fixture(scope="module")
def service(spark):
    return Service(Engine(spark, graph(spark, LEDGER)))


def asked(service, method, path, body=None):
    status, _, text = service.answer(method, path, json.dumps(body).encode() if body is not None else b"")
    return status, json.loads(text)


def test_metrics_count_by_outcome_and_time():
    now = [0.0]
    m = Metrics(clock=lambda: now[0])
    assert m.snapshot()["avg_duration_ms"] == 0
    for took in (0.5, 1.0):
        with m.query():
            now[0] += took
    with pytest.raises(KeyError), m.query():
        now[0] += 1.5
        raise KeyError
    got = m.snapshot()
    assert (got["total"], got["success"], got["failed"], got["slow_queries"]) == (3, 2, 1, 2)
    assert got["avg_duration_ms"] == 1000 and got["qps"] == 1 and got["uptime_seconds"] == 3
    assert "# TYPE ledgerlake_queries_total counter\nledgerlake_queries_total 3\n" in prometheus(got)


def test_lookups(service):
    assert asked(service, "GET", "/health") == (200, {"status": "ok"})
    assert asked(service, "GET", "/vertices/2")[1]["data"] == [{"id": 2, "label": "Account", "address": "a2", "name": "n2"}]
    assert asked(service, "GET", "/vertices/address/a%33")[1]["data"][0]["id"] == 3
    assert asked(service, "GET", "/edges/4")[1]["data"][0]["dst"] == 5
    assert [e["id"] for e in sorted(asked(service, "GET", "/vertices/1/outgoing")[1]["data"], key=lambda e: e["id"])] == [1, 4]
    assert sorted(e["id"] for e in asked(service, "GET", "/vertices/4/incoming")[1]["data"]) == [3, 5]
    assert asked(service, "GET", "/vertices/4/outgoing") == (200, {"success": True, "data": [], "error": None})
    for path in ("/vertices/77", "/vertices/address/x", "/edges/77", "/nothing", "/vertices/-1"):
        status, got = asked(service, "GET", path)
        assert status == 404 and not got["success"] and got["error"]


def test_statements_and_their_faults(service):
    assert asked(service, "POST", "/query", {"query": "MATCH (a)-[t]->(b) RETURN count(*) AS n"})[1]["data"] == [{"n": 5}]
    assert asked(service, "POST", "/query", {"query": "MATCH (a) WHERE a.id = $x RETURN a.name AS n", "params": {"x": 3}})[1]["data"] == [{"n": "n3"}]
    for body in ({"query": "MATCH (a RETURN"}, {"query": 5}, {}, [1], {"query": "RETURN 1", "params": 1}):
        assert asked(service, "POST", "/query", body)[0] == 400
    assert service.answer("POST", "/query", b"{")[0] == 400
    assert asked(service, "GET", "/query")[0] == 405


def test_algorithms(service):
    assert asked(service, "POST", "/algorithm/shortest-path", {"source": 1, "target": 4})[1]["data"][0]["length"] == 2
    assert asked(service, "POST", "/algorithm/shortest-path", {"source": 4, "target": 1}) == (200, {"success": False, "data": None, "error": "no path"})
    assert len(asked(service, "POST", "/algorithm/all-paths", {"source": 1, "target": 4, "k": 3})[1]["data"]) == 2
    assert len(asked(service, "POST", "/algorithm/all-paths", {"source": 1, "target": 4, "max_depth": 2})[1]["data"]) == 1
    assert asked(service, "POST", "/algorithm/max-flow", {"source": 1, "sink": 4})[1]["data"][0]["flow"] == 200
    assert asked(service, "POST", "/algorithm/trace", {"start": 1})[1]["data"]
    assert asked(service, "POST", "/algorithm/trace", {"start": 4, "direction": "backward", "max_depth": 1})[1]["data"]
    for path, body in (("shortest-path", {"source": 1}), ("max-flow", {"source": 1, "sink": "4"}), ("trace", {"start": True}), ("trace", {"start": 1, "direction": "up"}), ("all-paths", {"source": 1, "target": 4, "max_depth": -1})):
        assert asked(service, "POST", f"/algorithm/{path}", body)[0] == 400


def test_over_a_socket(spark):
    service = Service(Engine(spark, graph(spark, LEDGER)))
    with service.server(port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_address[1]}"
        try:
            ask = urllib.request.Request(f"{at}/query", json.dumps({"query": "MATCH (a) RETURN count(*) AS n"}).encode())
            assert json.load(urllib.request.urlopen(ask, timeout=120))["data"] == [{"n": 5}]
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(f"{at}/edges/99", timeout=120)
            assert e.value.code == 404
            big = urllib.request.Request(f"{at}/query", headers={"Content-Length": str(LONGEST + 1)}, method="POST")
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(big, timeout=120)
            assert e.value.code == 413
            told = urllib.request.urlopen(f"{at}/metrics", timeout=120)
            assert told.headers["Content-Type"].startswith("text/plain") and b"ledgerlake_queries_total 2\n" in told.read()
            stats = json.load(urllib.request.urlopen(f"{at}/stats", timeout=120))
            assert stats["query"]["success"] == 2 and stats["graph"] == {"vertices_queried": 0, "edges_queried": 1} and stats["storage"]["most_bytes"] > 0
        finally:
            server.shutdown()


def test_console(spark, tmp_path):
    said = []
    c = Console(Engine(spark, graph(spark, LEDGER)), said.append)
    one, out = "MATCH (a) WHERE a.id = 1 RETURN a.name AS n", str(tmp_path / "out")
    c.run(["", "# note", ":help", f":tee -o {out}", one, f"{one} \\G", ":notee", ":sleep 0", ":nope", ":sleep x", ":timeout -1", ":pager cat", "MATCH (a RETURN", ":flush", ":clear", ":q", one])
    assert said[0].startswith(":help")
    assert said[1].endswith("1 rows") and "n1" in said[1] and said[2] == "-- row 1\nn: n1"
    assert said[3:7] == ["error: unknown command :nope, see :help", "error: usage: :sleep SECONDS", "error: usage: :timeout SECONDS", "error: usage: :pager COMMAND ROWS"]
    assert said[7].startswith("error: ") and said[8] == "\x1b[2J\x1b[1;1H" and len(said) == 9
    assert open(out).read() == said[1] + "\n" + said[2] + "\n"
    assert c.metrics.snapshot()["failed"] == 1 and c.metrics.snapshot()["success"] == 2


def test_console_pager_and_timeout(spark, tmp_path):
    said = []
    c = Console(Engine(spark, graph(spark, LEDGER)), said.append)
    out = tmp_path / "paged"
    assert c.line(f":pager tee {out} 1") and c.line("MATCH (a) WHERE a.id = 1 RETURN a.name AS n") and len(said) == 1
    c.line("MATCH (a) RETURN a.name AS n")
    assert len(said) == 1 and "5 rows" in out.read_text()
    c.line(":nopager")
    c.line(":timeout 0.01")
    c.line("MATCH (a)-[t]->(b)-[u]->(d) RETURN count(*) AS n")
    assert said[-1] == "error: stopped after 0.01 seconds"
    c.line(":timeout 0")
    c.line("MATCH (a) RETURN count(*) AS n")
    assert said[-1].endswith("1 rows")


def test_console_and_server_from_the_command_line(spark, tmp_path, monkeypatch):
    from ledgerlake.cli import main

    data, said = str(tmp_path / "g"), []
    graph(spark, LEDGER).write(data)
    monkeypatch.setattr(sys, "stdin", io.StringIO("MATCH (a) RETURN count(*) AS n\n:q\n"))
    assert main(["console", "-d", data], spark, said.append) == 0
    assert "| 5 |" in said[0]
    monkeypatch.setattr("http.server.ThreadingHTTPServer.serve_forever", lambda self: None)
    assert main(["serve", "-d", data, "--port", "0"], spark, said.append) == 0
    assert said[1].startswith("http://127.0.0.1:")
