"""INSERT, DELETE, SET and REMOVE as rewrites of the graph's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ast as A
from ..sources.graph import Graph, cut
from .expressions import Compiler, GqlError, Table, c


def constant(e: A.Expr, params: dict):
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Param):
        if e.name not in params:
            raise GqlError(f"no value for parameter ${e.name}")
        return params[e.name]
    if isinstance(e, A.ListOf):
        return [constant(x, params) for x in e.items]
    if isinstance(e, A.Unary) and e.op == "-":
        return -constant(e.arg, params)
    raise GqlError("INSERT takes literal values")


def one_label(label: A.Label | None, default: str) -> str:
    if label is None:
        return default
    if label.op != "name":
        raise GqlError("an inserted element has one label")
    return label.args[0]


def with_columns(df: DataFrame, row: dict) -> DataFrame:
    """``df`` with a null column for every key that it lacks."""
    new = {k: "boolean" if type(v) is bool else "long" if type(v) is int else "double" if type(v) is float else "string" for k, v in row.items() if k not in df.columns and v is not None}
    return df.withColumns({k: F.lit(None).cast(t) for k, t in new.items()}) if new else df


def typed_rows(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Rows in the types of ``df``."""
    columns = [x for x in df.columns if any(x in r for r in rows)]
    made = None
    for r in rows:
        one = df.sparkSession.range(1).select(*(F.lit(r.get(x)).cast(df.schema[x].dataType).alias(x) for x in columns))
        made = one if made is None else made.union(one)
    return made.coalesce(1)


def insert(graph: Graph, statement: A.Insert, params: dict) -> tuple[Graph, int]:
    """Vertices are upserted by address; variables hold through the statement.  Gives the new graph and the number of elements named."""
    vertices, edges, count = graph.vertices, graph.edges, 0
    known: dict[str, int] = {}
    top = vertices.agg(F.max("id").alias("v")).first().v or 0
    last_edge = edges.agg(F.max("id").alias("e")).first().e or 0
    new_vertices: list[dict] = []
    new_edges: list[dict] = []
    by_address: dict[str, int] = {}

    def vertex(node: A.Node) -> int:
        nonlocal top, count
        if node.var in known and node.label is None and not node.props:
            return known[node.var]
        props = {k: constant(v, params) for k, v in node.props}
        count += 1
        vid = None
        if (a := props.get("address")) is not None:
            vid = by_address.get(a)
            if vid is None and "address" in graph.vertices.columns:
                row = graph.vertices.where(F.col("address") == a).select("id").first()
                vid = row.id if row else None
        if vid is None:
            top += 1
            vid = top
            new_vertices.append({"id": vid, "label": one_label(node.label, "Account"), **props})
        if a is not None:
            by_address[a] = vid
        if node.var:
            known[node.var] = vid
        return vid

    for term in statement.terms:
        ids = [vertex(n) for n in term[::2]]
        for k, edge in enumerate(term[1::2]):
            props = {x: constant(v, params) for x, v in edge.props}
            for short, name in (("value", "amount"), ("block", "block_number")):
                if short in props and name not in props:
                    props[name] = props.pop(short)
            last_edge += 1
            count += 1
            a, b = (ids[k + 1], ids[k]) if edge.direction == "in" else (ids[k], ids[k + 1])
            new_edges.append({"id": last_edge, "label": one_label(edge.label, "Transfer"), "src": a, "dst": b, **props})
    for r in new_vertices:
        vertices = with_columns(vertices, r)
    for r in new_edges:
        edges = with_columns(edges, r)
    if new_vertices:
        vertices = vertices.unionByName(typed_rows(vertices, new_vertices), allowMissingColumns=True)
    if new_edges:
        edges = edges.unionByName(typed_rows(edges, new_edges), allowMissingColumns=True)
    return replace(graph, vertices=vertices, edges=edges), count


def delete(graph: Graph, table: Table, names: list[str], detach: bool) -> tuple[Graph, int]:
    """Remove the bound elements; a vertex that still has edges only with DETACH."""
    count = 0
    for kind in ("edge", "node"):
        for v in names:
            if table.kinds.get(v) not in ("edge", "node"):
                raise GqlError(f"{v} is no vertex or edge")
            if table.kinds[v] != kind:
                continue
            ids = cut(table.df.select(c(f"{v}@id").alias("id")).where("id is not null").distinct())
            count += ids.count()
            if kind == "edge":
                graph = graph.remove_edges(ids)
                continue
            if not detach:
                ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
                if not ends.join(ids, "id", "left_semi").isEmpty():
                    raise GqlError(f"{v} still has edges; use DETACH DELETE")
            graph = graph.remove_vertices(ids)
    return graph, count


def update(graph: Graph, table: Table, statement: A.Update, params: dict) -> tuple[Graph, int]:
    """SET and REMOVE on the bound elements.  If rows disagree on a value, the largest one stays."""
    fixed = {"node": ("id", "label"), "edge": ("id", "label", "src", "dst")}
    touched = 0
    comp = Compiler(table, params)
    changes: dict[str, dict] = {}
    for item in statement.items:
        kind = table.kinds.get(item.var)
        if kind not in fixed:
            raise GqlError(f"{item.var} is no vertex or edge")
        mine = changes.setdefault(item.var, {})
        if item.kind == "label":
            mine["label"] = F.lit(None).cast("string") if statement.remove else F.lit(item.key)
        elif item.kind == "prop":
            if item.key in fixed[kind]:
                raise GqlError(f"{item.key} can't be set")
            mine[item.key] = F.lit(None) if statement.remove else comp(item.value)
        else:
            if item.kind == "replace":
                mine.update({p: F.lit(None) for p in table.props(item.var) if p not in fixed[kind]})
            mine.update({k: comp(v) for k, v in item.value.items})
    for var, columns in changes.items():
        which = "vertices" if table.kinds[var] == "node" else "edges"
        rows = table.df.select(c(f"{var}@id").alias("id"), *(v.alias(f"_new_{k}") for k, v in columns.items())).where("id is not null")
        rows = cut(rows.groupBy("id").agg(*(F.max(f"_new_{k}").alias(f"_new_{k}") for k in columns)))
        touched += rows.count()
        old = getattr(graph, which)
        joined = old.join(rows.withColumn("_hit", F.lit(True)), "id", "left")
        new = {}
        for k in columns:
            kind = old.schema[k].dataType if k in old.columns else None
            value = c(f"_new_{k}") if kind is None else c(f"_new_{k}").cast(kind)
            new[k] = F.when(c("_hit"), value).otherwise(c(k)) if kind is not None else F.when(c("_hit"), value)
            if isinstance(rows.schema[f"_new_{k}"].dataType.simpleString(), str) and rows.schema[f"_new_{k}"].dataType.simpleString() == "void" and kind is None:
                new.pop(k)
        order = [*old.columns, *(k for k in new if k not in old.columns)]
        graph = replace(graph, **{which: joined.withColumns(new).select(*order)})
    return graph, touched
