"""Entry point: statements of the query language over a catalog of graphs."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import changes, procedures
from .operators.expressions import PASS_THROUGH, Compiler, GqlError, Table, c
from .operators.match import UNBOUNDED, Matcher, conjunction, conjuncts, joined_on_shared, names, needed
from .operators.results import project, set_operation
from .plans import ast as A
from .plans.parser import parse
from .sources import schema as S
from .sources.catalog import Catalog
from .sources.graph import Graph


class Engine:
    """``gql(text)`` runs one statement and gives its result as a DataFrame."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, folder: str | None = None, unbounded: int = UNBOUNDED):
        self.spark, self.unbounded = spark, unbounded
        self.catalog = Catalog(spark, folder, {"default": graph} if graph is not None else None)
        self.session: dict[str, Any] = {}

    @property
    def graph(self) -> Graph:
        return self.catalog.graph

    def gql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        return self.run(parse(text), {**self.session, **(params or {})})

    def call(self, name: str, *args: Any) -> DataFrame:
        return procedures.call(self.graph, name, list(args))

    def script(self, text: str) -> list[DataFrame]:
        """Statements separated by semicolons at line ends."""
        parts = [p.strip() for p in text.replace(";\r\n", ";\n").split(";\n")]
        return [self.gql(p) for p in parts if p.strip("; \n")]

    # -- dispatch -------------------------------------------------------------
    def run(self, s, params: dict) -> DataFrame:
        return getattr(self, f"_{type(s).__name__.lower()}")(s, params)

    def row(self, **values) -> DataFrame:
        return self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))

    def rows(self, values: list[tuple], columns: str) -> DataFrame:
        return self.spark.createDataFrame(values, T._parse_datatype_string(columns) if hasattr(T, "_parse_datatype_string") else columns)

    # -- queries --------------------------------------------------------------
    def _setop(self, s: A.SetOp, params: dict) -> DataFrame:
        return set_operation(s.op, s.all, self.run(s.left, params), self.run(s.right, params))

    def matcher(self, need: set[str], params: dict) -> Matcher:
        return Matcher(self.graph, need, params, self.unbounded)

    def bind(self, steps: list, need: set[str], params: dict) -> tuple[Table | None, list[str]]:
        """The binding table after all steps, and its variables in order of appearance."""
        table: Table | None = None
        m = None
        for step in steps:
            if isinstance(step, A.Match):
                m = m or self.matcher(need, params)
                table = self.matched(m, table, step, params)
            elif isinstance(step, A.CallProc):
                found = self.procedure(step, params)
                own = Table(found, {x: "scalar" for x in found.columns})
                table = own if table is None else joined_on_shared(table, own, "left" if step.optional else "inner")
            else:
                table = table or Table(self.spark.range(1).select(F.lit(1).alias("_unit")), {})
                if isinstance(step, A.Filter):
                    m = m or self.matcher(need, params)
                    table = m.where(table, step.where)
                elif isinstance(step, A.Let):
                    for x in step.items:
                        col = Compiler(table, params).output(x.expr)
                        table = Table(table.df.withColumn(x.alias, col), {**table.kinds, x.alias: "scalar"})
                elif isinstance(step, A.For):
                    items = Compiler(table, params)(step.items)
                    out = [F.posexplode(items).alias(step.ordinal, step.var)] if step.ordinal else [F.explode(items).alias(step.var)]
                    kinds = {**table.kinds, step.var: "scalar", **({step.ordinal: "scalar"} if step.ordinal else {})}
                    df = table.df.select("*", *out)
                    if step.ordinal:
                        df = df.withColumn(step.ordinal, c(step.ordinal).cast("long"))
                    table = Table(df, kinds)
        return table, [v for v in (table.kinds if table else {}) if not v.startswith("_")]

    def matched(self, m: Matcher, table: Table | None, step: A.Match, params: dict) -> Table:
        pattern, late = step.pattern, []
        if table is not None and pattern.where is not None:
            # Conditions on variables of earlier steps hold after the join.
            own = set(m_vars(pattern))
            early = [e for e in conjuncts(pattern.where) if not (names(e) & set(table.kinds)) - own]
            late = [e for e in conjuncts(pattern.where) if e not in early]
            pattern = replace(pattern, where=conjunction(early))
        found = m.graph_pattern(pattern)
        if step.optional and table is None:
            unit = Table(self.spark.range(1).select(F.lit(1).alias("_unit")), {})
            return Table(joined_on_shared(unit, found, "left").df.drop("_unit"), found.kinds)
        if table is None:
            return found
        if late and step.optional:
            # Part of the join's condition: a row whose matches all fail keeps one row of nulls.
            right, cond = m.conditional(table, found, late)
            joined = table.df.join(right, cond, "left")
            return Table(joined.drop(*(x for x in right.columns if x.startswith("_on_"))), {**found.kinds, **table.kinds})
        out = joined_on_shared(table, found, "left" if step.optional else "inner")
        for e in late:
            out = m.where(out, e)
        return out

    def procedure(self, step: A.CallProc, params: dict) -> DataFrame:
        try:
            found = procedures.call(self.graph, step.name, [changes.constant(a, params) for a in step.args])
        except GqlError:
            if not step.optional:
                raise
            return self.rows([], "result string")
        if step.yields:
            for a, _ in step.yields:
                if a not in found.columns:
                    raise GqlError(f"{step.name} has no column {a}")
            found = found.select(*(c(a).alias(b) for a, b in step.yields))
        return found

    def _linear(self, s: A.Linear, params: dict) -> DataFrame:
        if s.result is not None and s.result.items is None and not s.result.order and s.result.limit is None and len(s.steps) == 1 and isinstance(s.steps[0], A.CallProc):
            return self.procedure(s.steps[0], params)
        if len(s.steps) == 1 and isinstance(s.steps[0], A.Filter) and s.result.items is None:
            unit = Table(self.spark.range(1).select(F.lit(1).alias("_unit")), {})
            return unit.df.select(Compiler(unit, params)(s.steps[0].where).alias("filter_result"))
        table, star = self.bind(s.steps, needed(s), params)
        table = table or Table(self.spark.range(1).select(F.lit(1).alias("_unit")), {})
        return project(table, s.result, params, star)

    def _select(self, s: A.Select, params: dict) -> DataFrame:
        engine = self
        if s.graph is not None:
            engine = Engine.__new__(Engine)
            engine.__dict__.update(self.__dict__)
            engine.catalog = Catalog(self.spark, None, {s.graph: self.catalog.graphs[s.graph]} if s.graph in self.catalog.graphs else None)
            if engine.catalog.current is None:
                raise GqlError(f"no graph {s.graph}")
        if s.matches:
            table, star = engine.bind(list(s.matches), needed(s), params)
        else:
            v = engine.graph.vertices
            table = Table(v.select(*(F.col(x).alias(f"_@{x}") for x in v.columns)), {"_": "node"})
            star = v.columns
        if s.where is not None:
            table = engine.matcher(set(), params).where(table, s.where)
        return project(table, s.result, params, star)

    # -- changes --------------------------------------------------------------
    def _insert(self, s: A.Insert, params: dict) -> DataFrame:
        graph, n = changes.insert(self.graph, s, params)
        self.catalog.put(graph)
        return self.row(inserted=n)

    def _delete(self, s: A.Delete, params: dict) -> DataFrame:
        if not s.steps:
            raise GqlError("DELETE without MATCH binds nothing")
        table, _ = self.bind(s.steps, set(), params)
        graph, n = changes.delete(self.graph, table, s.vars, s.detach)
        self.catalog.put(graph)
        return self.row(deleted=n)

    def _update(self, s: A.Update, params: dict) -> DataFrame:
        if not s.steps:
            raise GqlError("SET and REMOVE without MATCH bind nothing")
        table, _ = self.bind(s.steps, needed(s) | {x.var for x in s.items}, params)
        graph, n = changes.update(self.graph, table, s, params)
        self.catalog.put(graph)
        return self.row(**{"removed" if s.remove else "updated": n})

    # -- definitions and catalog ------------------------------------------------
    def _creategraph(self, s: A.CreateGraph, params: dict) -> DataFrame:
        made = self.catalog.create(s.name, S.declare(s.types), s.if_not_exists)
        return self.row(result=f"Graph {s.name} {'created' if made else 'exists'}")

    def _dropgraph(self, s: A.DropGraph, params: dict) -> DataFrame:
        gone = self.catalog.drop(s.name, s.if_exists)
        return self.row(result=f"Graph {s.name} {'dropped' if gone else 'does not exist'}")

    def _usegraph(self, s: A.UseGraph, params: dict) -> DataFrame:
        if s.name is not None:
            self.catalog.use(s.name)
        return self.row(current_graph=self.catalog.current)

    def schema(self) -> S.GraphSchema:
        held = self.catalog.graphs[self.catalog.current].schema if self.catalog.current else None
        return held if held is not None and (held.nodes or held.edges) else S.GraphSchema(dict(S.NODES), dict(S.EDGES))

    def _show(self, s: A.Show, params: dict) -> DataFrame:
        shape = lambda props: ", ".join(f"{p}: {k}" for p, k, _ in props)
        if s.what == "graphs":
            parts = [(k, "Closed", g.vertices.count(), g.edges.count()) for k, g in self.catalog.graphs.items()]
            out = self.rows(parts, "name string, type string, vertex_count long, edge_count long")
        elif s.what == "labels":
            out = self.rows([(n.name, shape(n.props), n.description) for n in self.schema().nodes.values()], "label string, properties string, description string")
        elif s.what == "edge types":
            out = self.rows([(e.name, e.source, e.target, shape(e.props), e.description) for e in self.schema().edges.values()], "type string, source string, target string, properties string, description string")
        elif s.what == "graph types":
            out = self.rows([(t, ", ".join(S.NODES), ", ".join(S.EDGES)) for t in S.TEMPLATES], "name string, node_types string, edge_types string")
        elif s.what == "property keys":
            keys = {(p, k, x.name) for x in [*self.schema().nodes.values(), *self.schema().edges.values()] for p, k, _ in x.props}
            out = self.rows(sorted(keys), "property string, type string, defined_by string")
        elif s.what == "functions":
            own = ["ID", "LABEL", "TOSTRING", "TOINTEGER", "TOFLOAT", "SIZE", "RANGE", "NODES", "EDGES", "PATH_LENGTH"]
            out = self.rows([(f, "aggregate" if f in A.AGGREGATES else "scalar") for f in sorted({*own, *A.AGGREGATES, *PASS_THROUGH})], "name string, kind string")
        elif s.what == "procedures":
            out = self.rows([(k, v[1], v[2]) for k, v in procedures.PROCEDURES.items()], "name string, parameters string, description string")
        elif s.what == "indexes":
            out = self.rows([("vertices", "label", "partition"), ("edges", "label", "partition"), ("edges", "src", "sort")], "table string, column string, kind string")
        else:
            keys = [(n.name, p, "PRIMARY KEY") for n in self.schema().nodes.values() for p, _, pk in n.props if pk]
            out = self.rows(keys, "label string, property string, kind string")
        return out.where(F.col(out.columns[0]).like(s.like)) if s.like is not None else out

    def _describe(self, s: A.Describe, params: dict) -> DataFrame:
        if s.what == "graph":
            g = self.catalog.graphs.get(s.name)
            if g is None:
                raise GqlError(f"no graph {s.name}")
            return self.row(name=s.name, type="Closed", vertex_count=g.vertices.count(), edge_count=g.edges.count())
        if s.what == "graph type":
            spec = S.template(s.name)
            return self.rows([("node", n) for n in spec.nodes] + [("edge", e) for e in spec.edges], "kind string, name string")
        held = self.schema()
        spec = (held.nodes if s.what == "label" else held.edges).get(s.name) or (S.NODES if s.what == "label" else S.EDGES).get(s.name)
        if spec is None:
            raise GqlError(f"no {s.what} {s.name}")
        return self.rows([(p, k, pk) for p, k, pk in spec.props], "property string, type string, primary_key boolean")

    def _session(self, s: A.Session, params: dict) -> DataFrame:
        if s.action == "close":
            self.session.clear()
            return self.row(result="session ended")
        if s.action == "reset":
            if s.key == "all":
                self.session.clear()
            else:
                self.session.pop(s.key, None)
            return self.row(result=f"{s.key} is unset")
        if s.key == "graph":
            self.catalog.use(s.value)
        elif s.key == "time zone":
            self.spark.conf.set("spark.sql.session.timeZone", s.value)
        self.session[s.key] = changes.constant(s.value, params) if isinstance(s.value, A.Expr) else s.value
        return self.row(result=f"{s.key} is set")

    def _transaction(self, s: A.Transaction, params: dict) -> DataFrame:
        # Each statement gives a new immutable graph, so there is nothing to lock; START keeps what ROLLBACK returns to.
        if s.action == "start":
            self._kept = dict(self.catalog.graphs)
        elif s.action == "rollback" and getattr(self, "_kept", None) is not None:
            self.catalog.graphs = self._kept
            self._kept = None
        elif s.action == "commit":
            self._kept = None
        return self.row(result={"start": "changes from here on can be undone", "commit": "changes kept", "rollback": "changes undone"}[s.action])


def m_vars(pattern: A.GraphPattern) -> set[str]:
    from .operators.match import variables

    return variables(pattern)
