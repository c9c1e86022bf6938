"""RETURN and SELECT: projection, grouping, ordering, paging; and set operations."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.parser import is_aggregate
from .expressions import Compiler, GqlError, Table, c


def item_names(items: list[A.Item]) -> list[str]:
    """Alias, variable, or var.property; else expr, expr_2, ..."""
    out: list[str] = []
    for x in items:
        e = x.expr
        name = x.alias or (e.name if isinstance(e, A.Var) else f"{e.of.name}.{e.name}" if isinstance(e, A.Prop) and isinstance(e.of, A.Var) else "expr")
        n, k = name, 1
        while n in out:
            k += 1
            n = f"{name}_{k}"
        out.append(n)
    return out


def substituted(e, aliases: dict[str, A.Expr], bound: dict | None = None):
    """Aliases of result items replaced by what they stand for; x.p is a property of a bound variable first."""
    if isinstance(e, A.Prop) and isinstance(e.of, A.Var) and e.of.name in (bound or {}):
        return e
    if isinstance(e, A.Var) and e.name in aliases:
        return aliases[e.name]
    if isinstance(e, A.Expr):
        return replace(e, **{f.name: substituted(getattr(e, f.name), aliases, bound) for f in fields(e)})
    return tuple(substituted(x, aliases, bound) for x in e) if isinstance(e, tuple) else e


def sort_key(col: Column, o: A.Order) -> Column:
    """Nulls come last unless asked otherwise."""
    if o.descending:
        return col.desc_nulls_first() if o.nulls_first else col.desc_nulls_last()
    return col.asc_nulls_first() if o.nulls_first else col.asc_nulls_last()


def project(table: Table, ret: A.Return, params: dict | None = None, star: list[str] | None = None) -> DataFrame:
    """The result table.  Order: group, having, distinct, order, offset, limit."""
    comp = Compiler(table, params)
    items = ret.items
    if items is None:
        items = [A.Item(A.Var(v), v) for v in (star if star is not None else [v for v in table.kinds if not v.startswith("_")])]
        if not items:
            raise GqlError("nothing to return")
    names = item_names(items)
    aliases = {x.alias: x.expr for x in items if x.alias and not (isinstance(x.expr, A.Var) and x.expr.name == x.alias)}
    order = [replace(o, expr=substituted(o.expr, aliases, table.kinds)) for o in ret.order]
    exprs = [x.expr for x in items]
    grouped = bool(ret.group_by) or ret.having is not None or any(is_aggregate(x) for x in exprs) or any(is_aggregate(o.expr) for o in order)

    hidden = {f"_order{i}": o.expr for i, o in enumerate(order) if o.expr not in exprs}
    values = {**{f"_item{i}": e for i, e in enumerate(exprs)}, **hidden}
    if grouped:
        keys = [substituted(k, aliases, table.kinds) for k in ret.group_by] if ret.group_by else [e for e in values.values() if not is_aggregate(e) and not isinstance(e, A.Lit)]
        if ret.having is not None:
            values["_having"] = substituted(ret.having, aliases, table.kinds)
        key_names = {k: f"_key{i}" for i, k in enumerate(dict.fromkeys(keys))}
        base = table.df
        if key_names:
            base = base.withColumns({n: comp.output(k) for k, n in key_names.items()})
        inner = Compiler(Table(base, {**table.kinds, **{n: "scalar" for n in key_names.values()}}), params)
        by_key = {k: A.Var(n) for k, n in key_names.items()}
        columns = [inner.output(keyed(e, by_key)).alias(n) for n, e in values.items()]
        df = base.groupBy(*(c(n) for n in key_names.values())).agg(*columns)
        if ret.having is not None:
            df = df.where("_having")
    else:
        df = table.df.select(*(comp.output(e).alias(n) for n, e in values.items()))

    if ret.distinct:
        if hidden:
            raise GqlError("ORDER BY after DISTINCT can only use what is returned")
        df = df.select(*(f"_item{i}" for i in range(len(items)))).distinct()
    if order:
        df = df.orderBy(*(sort_key(c(f"_order{i}" if f"_order{i}" in hidden else f"_item{exprs.index(o.expr)}"), o) for i, o in enumerate(order)))
    if ret.offset:
        df = df.offset(ret.offset)
    if ret.limit is not None:
        df = df.limit(ret.limit)
    return df.select(*(c(f"_item{i}").alias(n) for i, n in enumerate(names)))


def keyed(e, by_key: dict):
    """Grouping expressions outside of aggregates replaced by their key columns."""
    if isinstance(e, A.Expr):
        if e in by_key:
            return by_key[e]
        if isinstance(e, A.Call) and e.name in A.AGGREGATES:
            return e
        return replace(e, **{f.name: keyed(getattr(e, f.name), by_key) for f in fields(e)})
    return tuple(keyed(x, by_key) for x in e) if isinstance(e, tuple) else e


def set_operation(op: str, every: bool, left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns match by position and are named as on the left."""
    if len(left.columns) != len(right.columns):
        raise GqlError(f"{op} of {len(left.columns)} and {len(right.columns)} columns")
    right = right.toDF(*left.columns)
    if op == "UNION":
        return left.union(right) if every else left.union(right).distinct()
    if op == "EXCEPT":
        return left.exceptAll(right) if every else left.subtract(right)
    if op == "INTERSECT":
        return left.intersectAll(right) if every else left.intersect(right)
    # OTHERWISE: the right side only if the left has no row; decided inside the plan by a one-row table.
    some = left.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return left.union(right.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n"))
