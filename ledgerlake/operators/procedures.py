"""CALL procedures by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from . import flow, paths
from .expressions import GqlError

#: Most rows of path and flow listings unless a last argument says otherwise.
PATH_ROWS, FLOW_ROWS = 100, 20


def _shortest(g: Graph, s: int, t: int, depth: int | None = None) -> DataFrame:
    """Of any length, or of at most ``depth`` edges; the listing of procedures, fixed by its SQL, names the two ends only."""
    return paths.rendered(paths.shortest_path(g, s, t, depth))


def _listed(found: DataFrame, limit: int | None) -> DataFrame:
    return paths.rendered(found.orderBy("length", "edges").limit(limit) if limit is not None else found)


def _all_paths(g: Graph, s: int, t: int, depth: int = 10, limit: int | None = PATH_ROWS) -> DataFrame:
    return _listed(paths.all_paths(g, s, t, depth), limit)


def _k_shortest(g: Graph, s: int, t: int, k: int, depth: int = 10) -> DataFrame:
    return paths.rendered(paths.k_shortest_paths(g, s, t, k, depth))


def _trace(g: Graph, v: int, direction: str = "forward", depth: int = 5, limit: int | None = PATH_ROWS) -> DataFrame:
    return _listed(paths.trace(g, v, direction, depth), limit)


def _labelled(direction: str) -> Callable[..., DataFrame]:
    def call(g: Graph, v: int, depth: int = 5, limit: int | None = PATH_ROWS) -> DataFrame:
        return _listed(paths.trace(g, v, direction, depth, ["Transfer"]), limit)

    return call


def _max_flow(g: Graph, s: int, t: int, limit: int | None = FLOW_ROWS) -> DataFrame:
    """A row with the value, then the positive flows by (src, dst)."""
    found = flow.solved(g, s, t).where("kind <> 'side'")
    rows = found.select(
        (F.col("kind") == "flow").alias("o"), "src", "dst", F.when(F.col("kind") == "value", F.lit("max_flow")).otherwise(F.concat_ws(" -> ", F.col("src").cast("string"), F.col("dst").cast("string"))).alias("edge"), "flow"
    ).orderBy("o", "src", "dst")
    return (rows if limit is None else rows.limit(limit + 1)).select("edge", "flow")


def _pairs(g: Graph, *ids: int) -> DataFrame:
    if len(ids) % 2:
        raise GqlError("sources and sinks come in pairs")
    return flow.multi_source_sink_max_flow(g, list(zip(ids[::2], ids[1::2], strict=True)))


def _labels(g: Graph) -> DataFrame:
    return g.vertices.select("label").distinct()


PROCEDURES: dict[str, tuple[Callable[..., DataFrame], str, str]] = {
    "shortest_path": (_shortest, "source, target", "Shortest directed path"),
    "all_paths": (_all_paths, "source, target [, depth [, limit]]", "Simple directed paths"),
    "k_shortest_paths": (_k_shortest, "source, target, k [, depth]", "The k shortest simple paths"),
    "trace": (_trace, "vertex [, direction [, depth [, limit]]]", "Simple paths from a vertex"),
    "trace_fund_flow": (_labelled("forward"), "vertex [, depth [, limit]]", "Forward over Transfer edges"),
    "trace_fund_source": (_labelled("backward"), "vertex [, depth [, limit]]", "Backward over Transfer edges"),
    "n_hop_neighbors": (paths.n_hop_neighbors, "vertex, n", "Vertices at a distance of n"),
    "neighbors": (paths.neighbors, "vertex [, direction]", "Adjacent vertices, an edge each"),
    "degree": (paths.degree, "vertex", "In- and out-degree"),
    "connected": (paths.is_reachable, "source, target", "Directed reachability"),
    "max_flow": (_max_flow, "source, target [, limit]", "Maximum flow and its edges"),
    "min_cut": (flow.min_cut, "source, target", "Source side of the least minimum cut"),
    "bottleneck_edges": (flow.find_bottleneck_edges, "source, target", "Pairs that a maximum flow fills"),
    "multi_max_flow": (_pairs, "source, target [, source, target ...]", "Sum of the pairs' maximum flows"),
    "db.labels": (_labels, "", "Vertex labels in use"),
}
ALIASES = {"shortestpath": "shortest_path", "is_reachable": "connected", "maxflow": "max_flow", "allpaths": "all_paths"}


def call(graph: Graph, name: str, args: list[Any]) -> DataFrame:
    """Rows of a procedure; names may carry the prefix algo. or graph."""
    short = name.lower()
    for prefix in ("algo.", "graph."):
        short = short.removeprefix(prefix)
    short = ALIASES.get(short, short)
    if short not in PROCEDURES:
        raise GqlError(f"unknown procedure {name}")
    try:
        return PROCEDURES[short][0](graph, *args)
    except TypeError as e:
        raise GqlError(f"{name}({PROCEDURES[short][1]}): {e}") from e
