"""Command line: import files into a stored graph, run statements, show statistics, open a console, serve over HTTP.

    python -m ledgerlake.cli import -i transfers.csv -d FOLDER [-f csv|jsonl|json]
    python -m ledgerlake.cli query -d FOLDER [-e STATEMENT] [-s SCRIPT] [--format table|vertical|json] [--tee FILE]
    python -m ledgerlake.cli stats -d FOLDER
    python -m ledgerlake.cli console -d FOLDER
    python -m ledgerlake.cli serve -d FOLDER [--host HOST] [--port PORT]
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .console import Console
from .engine import Engine
from .service import Service
from .sources import sinks
from .sources.graph import Graph
from .sources.importers import imported


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="ledgerlake")
    commands = top.add_subparsers(dest="command", required=True)
    into = commands.add_parser("import")
    into.add_argument("-i", "--input", required=True)
    into.add_argument("-f", "--format", default="csv")
    ask = commands.add_parser("query")
    ask.add_argument("-e", "--execute", action="append", default=[])
    ask.add_argument("-s", "--script")
    ask.add_argument("--format", choices=("table", "vertical", "json"), default="table")
    ask.add_argument("--tee")
    serve = commands.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    for p in (into, ask, serve, commands.add_parser("stats"), commands.add_parser("console")):
        p.add_argument("-d", "--data", required=True)
    return top.parse_args(argv)


def statements(args: argparse.Namespace, spark: SparkSession) -> list[str]:
    """Those given one by one, then the script's, one a line; blank lines and # comments don't count."""
    lines = spark.read.text(args.script, wholetext=True).first()[0].splitlines() if args.script else []
    return [*args.execute, *(x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#"))]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, show=print) -> int:
    """0, or 1 if a format is unknown or a statement fails."""
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("ledgerlake").getOrCreate()
    out = sinks.Tee(show)
    if args.command == "import":
        began = time.time()
        try:
            got = imported(spark, args.input, args.format)
        except ValueError as e:
            out(str(e))
            return 1
        got.graph.write(args.data)
        out(f"{got.vertices} vertices, {got.edges} edges, {got.errors} errors, {int(1000 * (time.time() - began))} ms")
        return 0
    graph = Graph.read(spark, args.data)
    if args.command == "stats":
        out(sinks.table_text(Engine(spark, graph).gql("SHOW GRAPHS")))
        return 0
    engine, failed = Engine(spark, graph), 0
    if args.command == "console":
        Console(engine, show).run(sys.stdin)
        return 0
    if args.command == "serve":
        with Service(engine).server(args.host, args.port) as server:
            out(f"http://{server.server_address[0]}:{server.server_address[1]}")
            server.serve_forever()
        return 0
    if args.tee:
        out.open(args.tee)
    render = {"table": sinks.table_text, "vertical": sinks.vertical_text, "json": sinks.envelope}[args.format]
    for text in statements(args, spark):
        try:
            out(render(engine.gql(text)))
        except ValueError as e:
            failed = 1
            out(sinks.envelope(None, str(e)) if args.format == "json" else f"error: {e}")
    out.close()
    return failed


if __name__ == "__main__":
    sys.exit(main())
