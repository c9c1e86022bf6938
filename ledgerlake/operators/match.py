"""Graph patterns as joins.

A pattern becomes a binding table: fixed hops are equi-joins of the edge table, and
repeated ones are unrolled level by level.  Vertices are joined only where a label, a property or
a later clause needs more than their id.  Join strategies, filter pushdown
and column pruning are left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.parser import is_aggregate
from ..sources.graph import Graph, cut, settled, union_all
from .expressions import Compiler, GqlError, Table, c

#: Hops of a quantifier without an upper bound.
UNBOUNDED = 10
WHOLE = {"PROPERTIES", "LABEL", "LABELS", "TYPE", "COLLECT"}


def needed(x, out: set[str] | None = None, top: bool = False) -> set[str]:
    """Variables of which more than the id is asked for somewhere in a syntax tree."""
    out = set() if out is None else out
    if isinstance(x, A.Prop) and isinstance(x.of, A.Var):
        if x.name != "id":
            out.add(x.of.name)
    elif isinstance(x, A.Item) and isinstance(x.expr, A.Var):
        out.add(x.expr.name)
    elif isinstance(x, A.Call) and x.name in WHOLE:
        out.update(a.name for a in x.args if isinstance(a, A.Var))
    if isinstance(x, A.Return) and x.items is None:
        out.add("*")
    if is_dataclass(x):
        for f in fields(x):
            needed(getattr(x, f.name), out)
    elif isinstance(x, list | tuple):
        for y in x:
            needed(y, out)
    return out


def variables(pattern: A.GraphPattern) -> set[str]:
    """All named variables of a pattern."""
    out: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, A.Node | A.Edge | A.Paren | A.Path) and x.var:
            out.add(x.var)
        if is_dataclass(x) and not isinstance(x, A.Exists):
            for f in fields(x):
                walk(getattr(x, f.name))
        elif isinstance(x, tuple):
            for y in x:
                walk(y)

    walk(pattern)
    return out


def label_test(label: A.Label | None, col: Column) -> Column | None:
    """The label expression as a predicate; None if it asks for nothing."""
    if label is None or label.op == "any":
        return None
    if label.op == "name":
        return col == label.args[0]
    parts = [label_test(x, col) for x in label.args]
    if label.op == "not":
        return F.lit(False) if parts[0] is None else ~parts[0]
    if label.op == "and":
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if any(p is None for p in parts):
        return None
    if all(x.op == "name" for x in label.args):
        return col.isin(*(x.args[0] for x in label.args))
    return reduce(lambda a, b: a | b, parts)


@dataclass
class State:
    """A path under construction: its table, the column of its first and current vertex, and the columns that track it."""

    table: Table
    first: str
    last: str


class Matcher:
    def __init__(self, graph: Graph, need: set[str], params: dict | None = None, unbounded: int = UNBOUNDED):
        self.graph, self.need, self.params, self.unbounded = graph, need, params, unbounded
        self.n = 0

    def fresh(self, kind: str) -> str:
        self.n += 1
        return f"_{kind}{self.n}"

    # -- parts ----------------------------------------------------------------
    def test(self, table: Table, e: A.Expr) -> Column:
        return Compiler(table, self.params)(e)

    def filtered(self, df: DataFrame, var: str, part: A.Node | A.Edge, kind: str) -> DataFrame:
        """Rows of a vertex or edge table (columns var@...) that fit label, inline properties, and an inline WHERE on the part alone."""
        cond = label_test(part.label, c(f"{var}@label"))
        if cond is not None:
            df = df.where(cond)
        table = Table(df, {var: kind})
        for k, v in part.props:
            table.df = table.df.where(self.test(table, A.Binary("=", A.Prop(A.Var(var), k), v)))
        return table.df

    def wants(self, part: A.Node) -> bool:
        label = part.label is not None and label_test(part.label, F.lit("")) is not None
        return label or bool(part.props) or bool(part.var and ("*" in self.need or part.var in self.need))

    def node_table(self, part: A.Node, var: str) -> DataFrame:
        v = self.graph.vertices
        return self.filtered(v.select(*(F.col(x).alias(f"{var}@{x}") for x in v.columns)), var, part, "node")

    def edge_table(self, part: A.Edge, var: str) -> DataFrame:
        """The edges that fit, with _from and _to by direction."""
        e = self.graph.edges
        own = self.filtered(e.select(*(F.col(x).alias(f"{var}@{x}") for x in e.columns)), var, part, "edge")
        src, dst = c(f"{var}@src"), c(f"{var}@dst")
        ahead = own.select("*", src.alias("_from"), dst.alias("_to"))
        back = own.select("*", dst.alias("_from"), src.alias("_to"))
        return ahead if part.direction == "out" else back if part.direction == "in" else ahead.unionByName(back)

    def where(self, table: Table, cond: A.Expr | None) -> Table:
        """Keep the rows for which ``cond`` is true; EXISTS becomes a semi- or anti-join, or a flag inside larger conditions."""
        for e in conjuncts(cond):
            negated = isinstance(e, A.Unary) and e.op == "NOT" and isinstance(e.arg, A.Exists)
            if negated or isinstance(e, A.Exists):
                table = self.semi(table, (e.arg if negated else e).pattern, "left_anti" if negated else "left_semi")
                continue
            flags: dict[str, A.Exists] = {}
            plain = self.flagged(e, flags)
            columns = table.df.columns
            for name, x in flags.items():
                table = self.flag(table, x.pattern, name)
            kept = table.df.where(self.test(table, plain))
            table = Table(kept.select(*(c(x) for x in columns)) if flags else kept, {k: v for k, v in table.kinds.items() if k not in flags})
        return table

    def flagged(self, e, flags: dict):
        if isinstance(e, A.Exists):
            name = self.fresh("exists")
            flags[name] = e
            return A.Var(name)
        if isinstance(e, A.Expr):
            return replace(e, **{f.name: self.flagged(getattr(e, f.name), flags) for f in fields(e)})
        return tuple(self.flagged(x, flags) for x in e) if isinstance(e, tuple) else e

    def inner(self, table: Table, pattern: A.GraphPattern) -> tuple[DataFrame, list[str] | Column]:
        """(the pattern's matches, what they are joined on): distinct shared ids and their columns, or a condition if its WHERE reads outer variables."""
        outer = Matcher(self.graph, needed(pattern), self.params, self.unbounded)
        outer.n = self.n + 1000
        own = variables(pattern)
        late = [e for e in conjuncts(pattern.where) if (names(e) & set(table.kinds)) - own]
        found = outer.graph_pattern(replace(pattern, where=conjunction([e for e in conjuncts(pattern.where) if e not in late])))
        shared = [v for v in found.kinds if v in table.kinds and found.kinds[v] in ("node", "edge")]
        if late:
            return self.conditional(table, found, late)
        keys = [f"{v}@id" for v in shared]
        return (found.df.select(*(c(k) for k in keys)).distinct() if keys else found.df.limit(1).select(F.lit(1).alias("_one"))), keys

    def conditional(self, table: Table, found: Table, late: list[A.Expr]) -> tuple[DataFrame, Column]:
        """(``found`` under names that ``table`` lacks, the condition): equal shared variables, and ``late`` over the variables of both."""
        if any(has_exists(e) for e in late):
            raise GqlError("EXISTS inside such a WHERE can't be joined")
        shared = [v for v in found.kinds if v in table.kinds]
        keys = {v: v if found.kinds[v] == "scalar" else f"{v}@id" for v in shared}
        have = set(table.df.columns)
        right = found.df.select(*(c(x).alias(f"_on_{x}") for x in keys.values()), *(c(x) for x in found.df.columns if x not in keys.values() and x not in have))
        cond = F.lit(True)
        for k in keys.values():
            cond = cond & (c(k) == c(f"_on_{k}"))
        both = Table(table.df.join(right, cond), {**found.kinds, **table.kinds})
        for e in late:
            cond = cond & self.test(both, e)
        return right, cond

    def semi(self, table: Table, pattern: A.GraphPattern, how: str) -> Table:
        found, on = self.inner(table, pattern)
        return Table(table.df.join(found, F.lit(True) if isinstance(on, list) and not on else on, how), table.kinds)

    def flag(self, table: Table, pattern: A.GraphPattern, name: str) -> Table:
        found, on = self.inner(table, pattern)
        kinds = {**table.kinds, name: "scalar"}
        if not isinstance(on, list):
            yes, no = (table.df.join(found, on, how).withColumn(name, F.lit(how == "left_semi")) for how in ("left_semi", "left_anti"))
            return Table(yes.unionByName(no), kinds)
        found = found.withColumn(name, F.lit(True))
        df = table.df.join(found, on if on else F.lit(True), "left").withColumn(name, F.coalesce(c(name), F.lit(False)))
        return Table(df, kinds)

    # -- paths ----------------------------------------------------------------
    def start(self, part: A.Node) -> State:
        var = part.var or self.fresh("n")
        df = self.node_table(part, var)
        if not self.wants(part):
            df = df.select(c(f"{var}@id"))
        table = Table(df.withColumns({"_v": F.array(c(f"{var}@id")), "_e": F.array().cast("array<bigint>")}), {var: "node"})
        return State(self.where(table, part.where), f"{var}@id", f"{var}@id")

    def arrive(self, state: State, part: A.Node, to: str) -> State:
        """Bind the vertex in column ``to``: a new variable, or one that has to be the same vertex."""
        var = part.var or self.fresh("n")
        table = state.table
        if var in table.kinds:
            df = self.again(table.df.where(c(to) == c(f"{var}@id")).drop(to), part, var)
            return State(self.where(Table(df, table.kinds), part.where), state.first, f"{var}@id")
        if self.wants(part):
            df = table.df.join(self.node_table(part, var), c(to) == c(f"{var}@id")).drop(to)
        else:
            df = table.df.withColumnRenamed(to, f"{var}@id")
        return State(self.where(Table(df, {**table.kinds, var: "node"}), part.where), state.first, f"{var}@id")

    def again(self, df: DataFrame, part: A.Node, var: str) -> DataFrame:
        """The rows whose vertex ``var``, bound before, fits label and inline properties of this mention, too."""
        asked = part.props or (part.label is not None and label_test(part.label, F.lit("")) is not None)
        if not asked:
            return df
        if f"{var}@label" in df.columns:
            return self.filtered(df, var, part, "node")
        # Bound by its id alone: the vertices that fit are looked up.
        other = self.fresh("n")
        fit = self.node_table(part, other).select(c(f"{other}@id"))
        return df.join(fit, c(f"{var}@id") == c(f"{other}@id"), "left_semi")

    def hop(self, state: State, part: A.Edge, mode: str) -> State:
        """One edge from the current vertex; its target is in _to."""
        var = part.var or self.fresh("e")
        table, df = state.table, self.edge_table(part, var)
        if var in table.kinds:
            df = df.select(c(f"{var}@id").alias("_again"), "_from", "_to")
            joined = table.df.join(df, (c(state.last) == c("_from")) & (c(f"{var}@id") == c("_again"))).drop("_again")
        else:
            joined = table.df.join(df, c(state.last) == c("_from"))
        joined = guarded(joined, mode, c(f"{var}@id"), c("_to")).drop("_from")
        joined = joined.withColumns({"_e": F.array_append("_e", c(f"{var}@id")), "_v": F.array_append("_v", c("_to"))})
        kinds = {**table.kinds, var: "edge"}
        return State(self.where(Table(joined, kinds), part.where), state.first, "_to")

    def first_hop(self, head: A.Node, part: A.Edge, mode: str) -> State:
        """The first edge of a path whose first vertex is only an id: every edge has its ends, so no vertex is read."""
        var, node = part.var or self.fresh("e"), head.var or self.fresh("n")
        df = self.edge_table(part, var).withColumnRenamed("_from", f"{node}@id")
        if mode == "ACYCLIC":
            df = df.where(c(f"{node}@id") != c("_to"))
        df = df.withColumns({"_v": F.array(c(f"{node}@id"), c("_to")), "_e": F.array(c(f"{var}@id"))})
        return State(self.where(Table(df, {node: "node", var: "edge"}), part.where), f"{node}@id", "_to")

    def relation(self, part: A.Edge | A.Paren, mode: str) -> DataFrame:
        """What one repetition can do: _from, _to, _hv (vertices after the first), _he (edges)."""
        if isinstance(part, A.Edge):
            var = part.var or self.fresh("e")
            table = self.where(Table(self.edge_table(part, var), {var: "edge"}), part.where)
            return table.df.select("_from", "_to", F.array("_to").alias("_hv"), F.array(c(f"{var}@id")).alias("_he"))
        inner = self.term(part.term, part.mode or mode)
        table = self.where(inner.table, part.where)
        tail = F.slice("_v", 2, F.size("_v"))
        return table.df.select(c(inner.first).alias("_from"), c(inner.last).alias("_to"), tail.alias("_hv"), F.col("_e").alias("_he"))

    def repeat(self, state: State, part: A.Edge | A.Paren, mode: str) -> State:
        """``part`` repeated by its quantifier, from the current vertex on: all levels from the least to the most."""
        q = part.quantifier
        high = self.unbounded if q.high is None else q.high
        relation = self.relation(part, mode)
        table = state.table
        df = table.df.withColumns({"_to": c(state.last), "_base": F.size("_e")})
        levels = [df] if q.low == 0 else []
        # Stored edges are read anew at each level, with their filters pushed down: a copy of them costs more than a scan.
        if high > 2:
            relation = settled(relation)
        for d in range(1, high + 1):
            joined = df.join(relation.select(F.col("_from").alias("_rf"), F.col("_to").alias("_rt"), "_hv", "_he"), c("_to") == c("_rf"))
            joined = guarded_run(joined, mode, "_hv", "_he", state.first)
            df = joined.withColumns({"_to": c("_rt"), "_v": F.concat("_v", "_hv"), "_e": F.concat("_e", "_he")}).drop("_rf", "_rt", "_hv", "_he")
            if high > 2:
                # Each level is used twice, as a result and to go on from.
                df = cut(df)
                if df.isEmpty():
                    break
            if d >= q.low:
                levels.append(df)
        if not levels:
            levels = [df.limit(0)]
        out = union_all(levels)
        kinds = dict(table.kinds)
        if part.var:
            kinds[part.var] = "group"
            own = F.col("_base") + 1
            out = out.withColumns({f"{part.var}@edges": F.slice("_e", own, F.size("_e")), f"{part.var}@vertices": F.slice("_v", own, F.size("_v"))})
        return State(Table(out.drop("_base"), kinds), state.first, "_to")

    def term(self, term: tuple, mode: str) -> State:
        head, rest = term[0], term[1:]
        if isinstance(head, A.Node) and rest and not rest[0].quantifier and not self.wants(head) and head.where is None:
            state = self.first_hop(head, rest[0], mode)
            state = self.join_paren(self.arrive(state, A.Node(), "_to"), rest[1], mode) if isinstance(rest[1], A.Paren) else self.arrive(state, rest[1], "_to")
            rest = rest[2:]
        elif isinstance(head, A.Paren):
            if head.quantifier:
                state = self.repeat(self.start(A.Node()), head, mode)
                state = self.arrive(state, A.Node(), "_to")
            else:
                state = self.paren(head, mode)
        else:
            state = self.start(head)
        for edge, node in zip(rest[::2], rest[1::2], strict=True):
            state = self.repeat(state, edge, mode) if edge.quantifier else self.hop(state, edge, mode)
            if isinstance(node, A.Paren):
                state = self.join_paren(self.arrive(state, A.Node(), "_to"), node, mode)
            else:
                state = self.arrive(state, node, "_to")
        return state

    def paren(self, part: A.Paren, mode: str) -> State:
        state = self.term(part.term, part.mode or mode)
        table = self.where(state.table, part.where)
        if part.var:
            table = Table(table.df.withColumns({f"{part.var}@vertices": F.col("_v"), f"{part.var}@edges": F.col("_e")}), {**table.kinds, part.var: "path"})
        return State(table, state.first, state.last)

    def join_paren(self, state: State, part: A.Paren, mode: str) -> State:
        if part.quantifier:
            return self.arrive(self.repeat(state, part, mode), A.Node(), "_to")
        inner = self.paren(part, mode)
        other = inner.table.df.withColumnsRenamed({"_v": "_iv", "_e": "_ie"})
        kinds = {**state.table.kinds, **inner.table.kinds}
        clash = [v for v in inner.table.kinds if v in state.table.kinds]
        drop = [x for x in other.columns if x.split("@")[0] in clash]
        other = other.withColumnsRenamed({x: f"_dup_{x}" for x in drop})
        first = f"_dup_{inner.first}" if inner.first in drop else inner.first
        on = c(state.last) == c(first)
        for v in clash:
            on = on & (c(f"{v}@id") == c(f"_dup_{v}@id"))
        df = state.table.df.join(other, on)
        df = guarded_run(df.withColumns({"_hv": F.slice("_iv", 2, F.size("_iv")), "_he": F.col("_ie")}), mode, "_hv", "_he", state.first)
        df = df.withColumns({"_v": F.concat("_v", "_hv"), "_e": F.concat("_e", "_he")}).drop("_hv", "_he", "_iv", "_ie", *(f"_dup_{x}" for x in drop))
        return State(Table(df, kinds), state.first, inner.last)

    # -- selection ------------------------------------------------------------
    def searched(self, path: A.Path, term: tuple) -> Table:
        """The paths of one term under a search prefix."""
        search, mode = path.search, path.mode
        single = len(term) == 3 and isinstance(term[1], A.Edge) and term[1].quantifier and isinstance(term[0], A.Node) and isinstance(term[2], A.Node)
        if search.kind in ("any_shortest", "all_shortest") and single and term[1].quantifier.low <= 1 and not term[1].var:
            return self.breadth_first(term, search.kind == "all_shortest")
        if mode == "WALK":
            # A shortest walk repeats no vertex, and endless ones aren't wanted.
            mode = "SIMPLE" if search.kind == "all" else "ACYCLIC"
        state = self.term(term, mode)
        df = state.table.df.withColumns({"_first": c(state.first), "_last": c(state.last)})
        return Table(chosen(df, search), state.table.kinds)

    def breadth_first(self, term: tuple, every: bool) -> Table:
        """Shortest paths by levels: from each start, a vertex is entered at its first level only, by its least edge sequence (or by every one)."""
        head, edge, tail = term
        q = edge.quantifier
        start = self.start(head)
        begin = start.table.df.select(c(start.first).alias("_s")).distinct()
        relation = settled(self.relation(edge, "WALK").select("_from", "_to", F.col("_he")[0].alias("_eid")))
        front = cut(begin.select("_s", F.col("_s").alias("_t"), F.array("_s").alias("_v"), F.array().cast("array<bigint>").alias("_e")))
        levels = [front] if q.low == 0 else []
        seen = front.select("_s", "_t")
        for _ in range(self.unbounded if q.high is None else q.high):
            ahead = front.join(relation, c("_t") == c("_from")).join(seen.select(F.col("_s").alias("_s2"), F.col("_t").alias("_t2")), (c("_s") == c("_s2")) & (c("_to") == c("_t2")), "left_anti")
            ahead = ahead.select("_s", F.col("_to").alias("_t"), F.array_append("_v", c("_to")).alias("_v"), F.array_append("_e", c("_eid")).alias("_e"))
            if not every:
                ahead = ahead.groupBy("_s", "_t").agg(F.min(F.struct("_e", "_v")).alias("_m")).select("_s", "_t", "_m._v", "_m._e")
            front = cut(ahead)
            if front.isEmpty():
                break
            levels.append(front)
            seen = seen.union(front.select("_s", "_t").distinct())
        found = union_all(levels) if levels else front.limit(0)
        df = start.table.df.drop("_v", "_e").join(found, c(start.first) == c("_s")).drop("_s").withColumnRenamed("_t", "_to")
        return self.arrive(State(Table(df, start.table.kinds), start.first, "_to"), tail, "_to").table

    def path(self, path: A.Path) -> Table:
        tables = []
        for term in path.terms:
            if path.search:
                tables.append(self.searched(path, term))
            else:
                tables.append(self.term(term, path.mode).table)
        out = tables[0]
        for op, t in zip(path.unions, tables[1:], strict=True):
            kinds = {**out.kinds, **t.kinds}
            named = [x for x in dict.fromkeys([*out.df.columns, *t.df.columns]) if not x.startswith("_n") and not (x.startswith("_e") and "@" in x)]
            a, b = (Table(x.df.select(*(c(n) for n in named if n in x.df.columns)), x.kinds) for x in (out, t))
            df = a.df.unionByName(b.df, allowMissingColumns=True)
            out = Table(df.distinct() if op == "|" else df, {k: v for k, v in kinds.items() if not k.startswith("_")})
        if path.var:
            out = Table(out.df.withColumns({f"{path.var}@vertices": F.col("_v"), f"{path.var}@edges": F.col("_e")}), {**out.kinds, path.var: "path"})
        return out

    def graph_pattern(self, pattern: A.GraphPattern) -> Table:
        """All paths of a pattern joined on what they share, then its WHERE."""
        whole: Table | None = None
        alone = [e for e in conjuncts(pattern.where) if not has_exists(e)]
        for i, path in enumerate(pattern.paths):
            table = self.path(replace(path, terms=tuple(started(t, alone) for t in path.terms)))
            if pattern.keep:
                ends = table.df.withColumns({"_first": F.element_at("_v", 1), "_last": F.element_at("_v", -1)})
                table = Table(chosen(ends, pattern.keep), table.kinds)
            table = Table(table.df.withColumnRenamed("_e", f"_edges{i}").drop("_v"), table.kinds)
            whole = table if whole is None else joined_on_shared(whole, table)
        if pattern.different_edges:
            every = F.concat(*(c(f"_edges{i}") for i in range(len(pattern.paths))))
            whole = Table(whole.df.where(F.size(F.array_distinct(every)) == F.size(every)), whole.kinds)
        whole = Table(whole.df.drop(*(f"_edges{i}" for i in range(len(pattern.paths)))), whole.kinds)
        return self.where(whole, pattern.where)


def names(x) -> set[str]:
    out: set[str] = set()

    def walk(y) -> None:
        if isinstance(y, A.Var):
            out.add(y.name)
        if is_dataclass(y):
            for f in fields(y):
                walk(getattr(y, f.name))
        elif isinstance(y, tuple):
            for z in y:
                walk(z)

    walk(x)
    return out


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    if isinstance(e, A.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def started(term: tuple, conditions: list[A.Expr]) -> tuple:
    """The term with the conditions on its first vertex alone at that vertex, if repetitions follow: they would go on from every vertex else.

    Searches choose among the paths between two ends, so a condition on one end may come first.
    """
    head = term[0]
    if not isinstance(head, A.Node) or not head.var or not any(x.quantifier for x in term[1:] if isinstance(x, A.Edge | A.Paren)):
        return term
    own = [e for e in conditions if names(e) == {head.var}]
    return (replace(head, where=conjunction([*conjuncts(head.where), *own])), *term[1:]) if own else term


def conjunction(parts: list[A.Expr]) -> A.Expr | None:
    return reduce(lambda a, b: A.Binary("AND", a, b), parts) if parts else None


def has_exists(e) -> bool:
    if isinstance(e, A.Exists):
        return True
    if isinstance(e, tuple):
        return any(has_exists(x) for x in e)
    return is_dataclass(e) and any(has_exists(getattr(e, f.name)) for f in fields(e))


def guarded(df: DataFrame, mode: str, edge: Column, to: Column) -> DataFrame:
    """Drop extensions by one edge that the path mode forbids."""
    if mode == "TRAIL":
        return df.where(~F.array_contains("_e", edge))
    if mode == "ACYCLIC":
        return df.where(~F.array_contains("_v", to))
    if mode == "SIMPLE":
        # Only the first vertex may come again, and then the path is closed.
        inner = F.slice("_v", 2, F.size("_v"))
        return df.where(~F.array_contains(inner, to) & ~closed())
    return df


def closed() -> Column:
    return (F.size("_v") > 1) & (F.element_at("_v", 1) == F.element_at("_v", -1))


def guarded_run(df: DataFrame, mode: str, hv: str, he: str, first: str) -> DataFrame:
    """The same for a whole run of edges."""
    if mode == "TRAIL":
        return df.where(~F.arrays_overlap("_e", he) & (F.size(F.array_distinct(he)) == F.size(he)))
    if mode == "ACYCLIC":
        return df.where(~F.arrays_overlap("_v", hv) & (F.size(F.array_distinct(hv)) == F.size(hv)))
    if mode == "SIMPLE":
        inner = F.concat(F.slice("_v", 2, F.size("_v")), F.col(hv))
        start = F.element_at("_v", 1)
        mid = F.slice(F.col(hv), 1, F.size(hv) - 1)
        return df.where((F.size(F.array_distinct(inner)) == F.size(inner)) & ~closed() & ~F.array_contains(mid, start))
    return df


def chosen(df: DataFrame, search: A.Search) -> DataFrame:
    """Of the paths between two ends those that the search keeps, by (length, edge ids)."""
    ends = Window.partitionBy("_first", "_last")
    order = ends.orderBy(F.size("_e"), "_e")
    if search.kind == "all":
        return df.drop("_first", "_last")
    if search.kind in ("all_shortest", "groups"):
        df = df.withColumn("_rank", F.dense_rank().over(ends.orderBy(F.size("_e"))))
    else:
        df = df.withColumn("_rank", F.row_number().over(order))
    return df.where(F.col("_rank") <= search.k).drop("_rank", "_first", "_last")


def joined_on_shared(a: Table, b: Table, how: str = "inner") -> Table:
    """Join on the variables that both bind; without any, every pair."""
    shared = [v for v in b.kinds if v in a.kinds]
    for v in shared:
        if b.kinds[v] != a.kinds[v] or b.kinds[v] not in ("node", "edge", "scalar"):
            raise GqlError(f"variable {v} is bound twice")
    key = lambda v: v if b.kinds[v] == "scalar" else f"{v}@id"
    kinds = {**b.kinds, **a.kinds}
    if not shared:
        df = a.df.crossJoin(b.df) if how == "inner" else a.df.join(b.df, F.lit(True), how)
        return Table(df, kinds)
    repeat = [x for x in b.df.columns if x.split("@")[0] in shared and x not in [key(v) for v in shared]]
    have = set(a.df.columns)
    right = b.df.drop(*(x for x in repeat if x in have))
    return Table(a.df.join(right, [key(v) for v in shared], how), kinds)


__all__ = ["Matcher", "conjunction", "conjuncts", "is_aggregate", "joined_on_shared", "needed", "variables"]
