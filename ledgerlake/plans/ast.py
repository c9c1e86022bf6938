"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT", "STDDEV", "STDDEV_SAMP", "STDDEV_POP", "VARIANCE", "VAR_SAMP", "VAR_POP", "APPROX_COUNT_DISTINCT", "PERCENTILE_APPROX"}


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    name: str


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Quantified(Expr):
    """ALL/ANY/NONE/SINGLE(var IN list WHERE predicate)."""

    kind: str
    var: str
    items: Expr
    predicate: Expr


@dataclass(frozen=True)
class Exists(Expr):
    pattern: GraphPattern


@dataclass(frozen=True)
class Label:
    """op: name, any (the wildcard), not, and, or."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Node:
    var: str | None = None
    label: Label | None = None
    props: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None


@dataclass(frozen=True)
class Quantifier:
    low: int
    high: int | None


@dataclass(frozen=True)
class Edge:
    """direction: out, in or any."""

    direction: str
    var: str | None = None
    label: Label | None = None
    props: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None
    quantifier: Quantifier | None = None


@dataclass(frozen=True)
class Paren:
    term: tuple
    var: str | None = None
    mode: str | None = None
    where: Expr | None = None
    quantifier: Quantifier | None = None


@dataclass(frozen=True)
class Search:
    """kind: all, all_shortest, any, any_shortest, shortest, groups."""

    kind: str
    k: int = 1


@dataclass(frozen=True)
class Path:
    """terms: alternatives of node, edge, node, ...; unions: "|" or "|+|" between them."""

    terms: tuple[tuple, ...]
    unions: tuple[str, ...] = ()
    var: str | None = None
    mode: str = "WALK"
    search: Search | None = None


@dataclass(frozen=True)
class GraphPattern:
    paths: tuple[Path, ...]
    where: Expr | None = None
    different_edges: bool = False
    keep: Search | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False
    nulls_first: bool | None = None


@dataclass
class Match:
    pattern: GraphPattern
    optional: bool = False


@dataclass
class Filter:
    where: Expr


@dataclass
class Let:
    items: list[Item]


@dataclass
class For:
    var: str
    items: Expr
    ordinal: str | None = None


@dataclass
class CallProc:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]]
    optional: bool = False


@dataclass
class Return:
    items: list[Item] | None
    distinct: bool = False
    group_by: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[Order] = field(default_factory=list)
    offset: int | None = None
    limit: int | None = None


@dataclass
class Select:
    result: Return
    graph: str | None = None
    matches: list[Match] = field(default_factory=list)
    where: Expr | None = None


@dataclass
class Linear:
    """Steps that hand a binding table on, then RETURN (None: all that is bound)."""

    steps: list
    result: Return | None


@dataclass
class SetOp:
    op: str
    all: bool
    left: Any
    right: Any


@dataclass
class Insert:
    terms: list[tuple]


@dataclass
class Delete:
    vars: list[str]
    detach: bool
    steps: list = field(default_factory=list)


@dataclass
class SetItem:
    """kind: prop (key, value), label (key), replace or merge (value: MapOf)."""

    var: str
    kind: str
    key: str | None = None
    value: Expr | None = None


@dataclass
class Update:
    items: list[SetItem]
    remove: bool
    steps: list = field(default_factory=list)


@dataclass
class NodeType:
    name: str
    props: list[tuple[str, str, bool]]


@dataclass
class EdgeType:
    name: str
    source: str | None
    target: str | None
    props: list[tuple[str, str, bool]]


@dataclass
class CreateGraph:
    name: str
    if_not_exists: bool
    types: list


@dataclass
class DropGraph:
    name: str
    if_exists: bool


@dataclass
class UseGraph:
    name: str | None


@dataclass
class Show:
    what: str
    like: str | None = None


@dataclass
class Describe:
    what: str
    name: str


@dataclass
class Session:
    action: str
    key: str | None = None
    value: Any = None


@dataclass
class Transaction:
    action: str
    read_only: bool = False
