"""Maximum flow, minimum cut and bottlenecks.

Capacities are aggregated and the network is pruned to walks from source to sink as
DataFrames if there are many.  Up to ``most_edges`` pairs, what is left is solved in one task by blocking flows on level
graphs in exact integers.  A larger network stays a table: shortest augmenting paths are
found by distributed search over the residual pairs, those of large capacity first, until there is
none.  Both give the same value and the same least source side.
"""

from __future__ import annotations

from collections import defaultdict, deque
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph, cut, settled, union_all
from .paths import reached, shortest_path

MOST_EDGES = 2_000_000


def capacities(graph: Graph) -> DataFrame:
    """src, dst, cap: summed over the Transfer edges; without any, over the edges from Account, Contract and Token."""
    e = settled(graph.edges.select("label", "src", "dst", *(["amount"] if "amount" in graph.edges.columns else [])))
    cap = F.coalesce(F.col("amount").cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")) if "amount" in e.columns else F.lit(1).cast("decimal(38,0)")
    flows = e.where(F.col("label") == "Transfer")
    if flows.isEmpty():
        holders = graph.vertices.where(F.col("label").isin("Account", "Contract", "Token")).select(F.col("id").alias("src"))
        flows = e.join(holders, "src", "left_semi")
    return flows.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum(cap).cast("decimal(38,0)").alias("cap")).where("cap > 0")


def pruned(graph: Graph, caps: DataFrame, source: int, target: int) -> DataFrame:
    """The pairs on some walk from source to target."""
    net = Graph(graph.vertices, caps.select(F.lit(0).cast("long").alias("id"), F.lit("").alias("label"), "src", "dst"))
    ahead = reached(net, source).select(F.col("id").alias("src"))
    back = reached(net, target, direction="backward").select(F.col("id").alias("dst"))
    return caps.join(ahead, "src", "left_semi").join(back, "dst", "left_semi")


def solve(pairs: list[tuple[int, int, int]], source: int, target: int) -> tuple[int, dict[tuple[int, int], int], set[int]]:
    """(value, positive flow of each pair, least source side of a minimum cut)."""
    if source == target:
        return 0, {}, {source}
    head: list[int] = []
    left: list[int] = []
    out: dict[int, list[int]] = defaultdict(list)
    for u, v, w in pairs:
        for a, b, x in ((u, v, w), (v, u, 0)):
            out[a].append(len(head))
            head.append(b)
            left.append(x)
    value = 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for i in out[u]:
                if left[i] > 0 and head[i] not in level:
                    level[head[i]] = level[u] + 1
                    queue.append(head[i])
        if target not in level:
            break
        tried = defaultdict(int)
        path: list[int] = []
        u = source
        while True:
            if u == target:
                push = min(left[i] for i in path)
                value += push
                for i in path:
                    left[i] -= push
                    left[i ^ 1] += push
                keep = next(k for k, i in enumerate(path) if left[i] == 0)
                u = head[path[keep] ^ 1]
                del path[keep:]
                continue
            while tried[u] < len(out[u]) and not (left[out[u][tried[u]]] > 0 and level.get(head[out[u][tried[u]]]) == level[u] + 1):
                tried[u] += 1
            if tried[u] < len(out[u]):
                path.append(out[u][tried[u]])
                u = head[path[-1]]
            elif path:
                u = head[path.pop() ^ 1]
                tried[u] += 1
            else:
                break
    flow: dict[tuple[int, int], int] = {}
    for k, (u, v, w) in enumerate(pairs):
        used = w - left[2 * k]
        if used > 0:
            flow[u, v] = flow.get((u, v), 0) + used
    return value, flow, set(level)


SOLVED = "kind string, src long, dst long, flow decimal(38,0)"


def solved(graph: Graph, source: int, target: int, most_edges: int = MOST_EDGES) -> DataFrame:
    """Rows of kind value (flow), flow (src, dst, flow) and side (src: a vertex on the source side; of a large network, of those on walks to the target)."""
    return solved_from(graph, cut(capacities(graph)), source, target, most_edges)


def solved_from(graph: Graph, caps: DataFrame, source: int, target: int, most_edges: int) -> DataFrame:
    """The same from written capacities.  A network that fits one task is solved as it is; only of a larger one the walks are searched first."""
    net = caps
    if caps.count() > most_edges:
        net = cut(pruned(graph, caps, source, target))
        if net.count() > most_edges:
            return augmented(net, source, target)
    marker = graph.spark.createDataFrame([(None, None, None)], "src long, dst long, cap decimal(38,0)")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["src"].notna()]
        pairs = sorted((int(a), int(b), int(w)) for a, b, w in zip(pdf["src"], pdf["dst"], pdf["cap"], strict=True))
        value, flow, side = solve(pairs, source, target)
        rows = [("value", None, None, Decimal(value)), *(("flow", u, v, Decimal(x)) for (u, v), x in sorted(flow.items())), *(("side", u, None, None) for u in sorted(side))]
        return pd.DataFrame(rows, columns=["kind", "src", "dst", "flow"]).astype({"src": "Int64", "dst": "Int64"})

    return net.select("src", "dst", "cap").union(marker).groupBy(F.lit(1).alias("one")).applyInPandas(one, SOLVED)


def augmented(net: DataFrame, source: int, target: int) -> DataFrame:
    """The rows of ``solved`` for a network that stays distributed: only one path at a time reaches the driver."""
    spark = net.sparkSession
    vertices = spark.range(0).select("id")
    left = cut(net.select("src", "dst", "cap").union(net.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("decimal(38,0)").alias("cap"))).groupBy("src", "dst").agg(F.sum("cap").cast("decimal(38,0)").alias("cap")))
    value, scale = 0, 1
    top = net.agg(F.max("cap")).first()[0] or 0
    while scale * 2 <= top:
        scale *= 2
    while source != target and scale >= 1:
        open_ = left.where(F.col("cap") >= scale)
        edges = open_.select(F.xxhash64("src", "dst").alias("id"), F.lit("").alias("label"), "src", "dst", F.col("cap").alias("amount"))
        found = shortest_path(Graph(vertices, edges), source, target).first()
        if found is None:
            scale //= 2
            continue
        steps = spark.createDataFrame(list(zip(found.vertices[:-1], found.vertices[1:], strict=True)), "src long, dst long")
        push = left.join(F.broadcast(steps), ["src", "dst"]).agg(F.min("cap")).first()[0]
        value += int(push)
        change = steps.select("src", "dst", F.lit(-push).alias("by")).union(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(push).alias("by")))
        left = cut(left.join(F.broadcast(change), ["src", "dst"], "left").select("src", "dst", (F.col("cap") + F.coalesce("by", F.lit(0))).cast("decimal(38,0)").alias("cap")))
    null = F.lit(None).cast("long")
    total = spark.range(1).select(F.lit("value").alias("kind"), null.alias("src"), null.alias("dst"), F.lit(value).cast("decimal(38,0)").alias("flow"))
    used = net.join(left.withColumnRenamed("cap", "rest"), ["src", "dst"]).where("cap > rest").select(F.lit("flow"), "src", "dst", (F.col("cap") - F.col("rest")).cast("decimal(38,0)"))
    open_ = left.where("cap > 0").select(F.lit(0).cast("long").alias("id"), F.lit("").alias("label"), "src", "dst")
    side = reached(Graph(vertices, open_), source).select(F.lit("side"), "id", null, F.lit(None).cast("decimal(38,0)"))
    return total.union(used).union(side)


def max_flow(graph: Graph, source: int, target: int) -> DataFrame:
    """One row: value."""
    return solved(graph, source, target).where("kind = 'value'").select(F.col("flow").alias("value"))


def flows(graph: Graph, source: int, target: int) -> DataFrame:
    return solved(graph, source, target).where("kind = 'flow'").select("src", "dst", "flow")


def min_cut(graph: Graph, source: int, target: int, most_edges: int = MOST_EDGES) -> DataFrame:
    """id of each vertex on the source side, which is the least one.

    Vertices that the side reaches but that can't reach the target are on it, too: nothing flows to them, so their pairs are open.
    """
    caps = cut(capacities(graph))
    front = cut(solved_from(graph, caps, source, target, most_edges).where("kind = 'side'").select(F.col("src").alias("id")))
    if source == target or caps.count() <= most_edges:
        return front
    held = Graph(graph.vertices, caps.select(F.lit(0).cast("long").alias("id"), F.lit("").alias("label"), "src", "dst"))
    ends = reached(held, target, direction="backward").select(F.col("id").alias("dst"))
    dead = cut(caps.join(ends, "dst", "left_anti").select("src", "dst"))
    parts = [front]
    while not front.isEmpty():
        seen = union_all(parts).select(F.col("id").alias("dst"))
        front = cut(front.join(dead, F.col("id") == F.col("src")).select("dst").distinct().join(seen, "dst", "left_anti").select(F.col("dst").alias("id")))
        parts.append(front)
    return union_all(parts)


def multi_source_sink_max_flow(graph: Graph, pairs: list[tuple[int, int]]) -> DataFrame:
    """One row: the sum of the pairs' maximum flows, each pair on its own."""
    parts = [max_flow(graph, s, t) for s, t in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("decimal(38,0)").alias("value"))


def find_bottleneck_edges(graph: Graph, source: int, target: int) -> DataFrame:
    """src, dst, cap of the pairs that the flow fills."""
    caps = cut(capacities(graph))
    used = solved_from(graph, caps, source, target, MOST_EDGES).where("kind = 'flow'").select("src", "dst", "flow")
    return used.join(caps, ["src", "dst"]).where("flow = cap").select("src", "dst", "cap")
