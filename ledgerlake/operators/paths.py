"""Path procedures: breadth-first search, bounded simple paths, tracing, neighbourhoods.

Frontiers are DataFrames.  Each level is one join with the edge table, cut from its
lineage through the shared checkpoint folder, so a lost executor costs one level.  Only the stopping test of a level
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import weight
from ..sources.graph import Graph, cut, settled, union_all

LONGS = "array<bigint>"


def hops(graph: Graph, direction: str = "forward", labels: list[str] | None = None) -> DataFrame:
    """_from, _to, _id, _w of the edges that may be walked."""
    e = graph.edges
    if labels:
        e = e.where(F.col("label").isin(*labels))
    w = weight(F.col("amount")) if "amount" in e.columns else F.lit(1.0)
    ahead = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("id").alias("_id"), w.alias("_w"))
    back = e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), F.col("id").alias("_id"), w.alias("_w"))
    if direction == "forward":
        return ahead
    if direction == "backward":
        return back
    if direction == "both":
        return ahead.union(back)
    raise ValueError(f"unknown direction {direction}")


def seed(graph: Graph, vertex: int) -> DataFrame:
    return graph.spark.range(1).select(F.lit(vertex).cast("long").alias("cur"), F.array(F.lit(vertex).cast("long")).alias("vertices"), F.array().cast(LONGS).alias("edges"), F.lit(0.0).alias("total_weight"))


def step(front: DataFrame, relation: DataFrame) -> DataFrame:
    """All extensions of the paths by one edge to a vertex that they don't hold."""
    joined = front.join(relation, F.col("cur") == F.col("_from")).where(~F.array_contains("vertices", F.col("_to")))
    return joined.select(
        F.col("_to").alias("cur"), F.array_append("vertices", F.col("_to")).alias("vertices"), F.array_append("edges", F.col("_id")).alias("edges"), (F.col("total_weight") + F.col("_w")).alias("total_weight")
    )


def finished(paths: DataFrame) -> DataFrame:
    return paths.select("vertices", "edges", F.size("edges").alias("length"), "total_weight")


def rendered(paths: DataFrame) -> DataFrame:
    """path ("1 -> 5"), length, total_weight."""
    return paths.select(F.array_join(F.transform("vertices", lambda v: v.cast("string")), " -> ").alias("path"), "length", "total_weight")


def shortest_path(graph: Graph, source: int, target: int, most: int | None = None) -> DataFrame:
    """The shortest directed path of least edge-id sequence, or no row; a vertex has a path of length 0 to itself."""
    front = seed(graph, source)
    if source == target:
        return finished(front)
    relation = settled(hops(graph))
    seen = front.select(F.col("cur").alias("_seen"))
    level = 0
    while most is None or level < most:
        level += 1
        ahead = step(front, relation).join(seen, F.col("cur") == F.col("_seen"), "left_anti")
        # By induction over levels the least sequence to each vertex extends the least one to its predecessor.
        best = F.min(F.struct("edges", "vertices", "total_weight")).alias("m")
        front = cut(ahead.groupBy("cur").agg(best).select("cur", "m.vertices", "m.edges", "m.total_weight"))
        state = front.agg(F.count("*").alias("n"), F.max(F.col("cur") == target).alias("hit")).first()
        if state.hit:
            return finished(front.where(F.col("cur") == target))
        if not state.n:
            break
        seen = seen.union(front.select(F.col("cur").alias("_seen")))
        if level % 16 == 0:  # A long search would else plan a union of all its levels at each one.
            seen = cut(seen.repartition("_seen"))
    return finished(seed(graph, source).limit(0))


def near_enough(graph: Graph, target: int, depth: int) -> DataFrame:
    """_v, _d: vertices from which ``target`` can be reached in at most ``depth`` steps, with the fewest."""
    back = hops(graph, "backward")
    found = graph.spark.range(1).select(F.lit(target).cast("long").alias("_v"), F.lit(0).alias("_d"))
    front, levels = found, [found]
    seen = found.select(F.col("_v").alias("_s"))
    for d in range(1, depth + 1):
        front = front.join(back, F.col("_v") == F.col("_from")).select(F.col("_to").alias("_v")).distinct().join(seen, F.col("_v") == F.col("_s"), "left_anti").withColumn("_d", F.lit(d))
        front = cut(front)
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.union(front.select(F.col("_v").alias("_s")))
    return union_all(levels)


def all_paths(graph: Graph, source: int, target: int, depth: int = 10) -> DataFrame:
    """All simple directed paths of at most ``depth`` edges.  Extensions that can't reach the target in the rest are never made."""
    front = seed(graph, source)
    if source == target:
        return finished(front)
    close, relation = near_enough(graph, target, depth), hops(graph)
    done = []
    for d in range(1, depth + 1):
        ahead = step(front, relation).join(close, F.col("cur") == F.col("_v")).where(F.col("_d") <= depth - d).drop("_v", "_d")
        ahead = cut(ahead)
        done.append(ahead.where(F.col("cur") == target))
        front = ahead.where(F.col("cur") != target)
        if ahead.isEmpty():
            break
    return finished(union_all(done))


def k_shortest_paths(graph: Graph, source: int, target: int, k: int, depth: int = 10) -> DataFrame:
    """The k shortest simple paths by (length, edge ids)."""
    return all_paths(graph, source, target, depth).orderBy("length", "edges").limit(k)


def trace(graph: Graph, vertex: int, direction: str = "forward", depth: int = 5, labels: list[str] | None = None) -> DataFrame:
    """Every simple path of 1 to ``depth`` edges that begins at the vertex."""
    front, relation, levels = seed(graph, vertex), hops(graph, direction, labels), []
    for _ in range(depth):
        front = cut(step(front, relation))
        levels.append(front)
        if front.isEmpty():
            break
    return finished(union_all(levels) if levels else front.limit(0))


def trace_fund_flow(graph: Graph, vertex: int, depth: int = 5) -> DataFrame:
    return trace(graph, vertex, "forward", depth, ["Transfer"])


def trace_fund_source(graph: Graph, vertex: int, depth: int = 5) -> DataFrame:
    return trace(graph, vertex, "backward", depth, ["Transfer"])


def reached(graph: Graph, vertex: int, depth: int | None = None, direction: str = "forward", until: int | None = None) -> DataFrame:
    """id, distance of the vertices within ``depth`` steps (any number: None); stops early once ``until`` is found."""
    relation = hops(graph, direction).select("_from", "_to")
    front = graph.spark.range(1).select(F.lit(vertex).cast("long").alias("id"), F.lit(0).alias("distance"))
    levels, seen, d = [front], front.select(F.col("id").alias("_seen")), 0
    while depth is None or d < depth:
        d += 1
        front = front.join(relation, F.col("id") == F.col("_from")).select(F.col("_to").alias("id")).distinct()
        front = cut(front.join(seen, F.col("id") == F.col("_seen"), "left_anti").withColumn("distance", F.lit(d)))
        state = front.agg(F.count("*").alias("n"), F.max(F.col("id") == F.lit(until)).alias("hit")).first()
        if not state.n:
            break
        levels.append(front)
        seen = seen.union(front.select(F.col("id").alias("_seen")))
        if state.hit:
            break
    return union_all(levels)


def n_hop_neighbors(graph: Graph, vertex: int, n: int) -> DataFrame:
    """Vertices at a distance of exactly n."""
    return reached(graph, vertex, n).where(F.col("distance") == n).select("id")


def is_reachable(graph: Graph, source: int, target: int) -> DataFrame:
    found = reached(graph, source, until=target).where(F.col("id") == target)
    return found.agg((F.count("*") > 0).alias("connected")).select(F.lit(source).cast("long").alias("source"), F.lit(target).cast("long").alias("target"), "connected")


def neighbors(graph: Graph, vertex: int, direction: str = "both") -> DataFrame:
    """direction, neighbor_id: one row an edge, parallel edges each."""
    out = graph.outgoing(vertex).select(F.lit("out").alias("direction"), F.col("dst").alias("neighbor_id"))
    into = graph.incoming(vertex).select(F.lit("in").alias("direction"), F.col("src").alias("neighbor_id"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    return out if direction == "out" else into if direction == "in" else out.union(into)


def degree(graph: Graph, vertex: int) -> DataFrame:
    counts = graph.edges.where((F.col("src") == vertex) | (F.col("dst") == vertex)).agg(F.count_if(F.col("src") == vertex).alias("out_degree"), F.count_if(F.col("dst") == vertex).alias("in_degree"))
    return counts.select(F.lit(vertex).cast("long").alias("vertex_id"), "out_degree", "in_degree", (F.col("out_degree") + F.col("in_degree")).alias("total_degree"))


def degrees(graph: Graph) -> DataFrame:
    """Of all vertices: vertex_id, out_degree, in_degree, total_degree."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o")))).alias("x"))
    counted = ends.groupBy(F.col("x.v").alias("vertex_id")).agg(F.sum("x.o").alias("out_degree"), F.sum(1 - F.col("x.o")).alias("in_degree"), F.count("*").alias("total_degree"))
    every = graph.vertices.select(F.col("id").alias("vertex_id")).join(counted, "vertex_id", "left")
    return every.na.fill(0, ["out_degree", "in_degree", "total_degree"])
