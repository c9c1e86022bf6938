"""Declared graph types, the built-in ones, and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.values import spark_type

Property = tuple[str, str, bool]


@dataclass
class NodeSpec:
    name: str
    props: list[Property]
    description: str = ""


@dataclass
class EdgeSpec:
    name: str
    source: str | None
    target: str | None
    props: list[Property]
    description: str = ""


def _props(text: str) -> list[Property]:
    """name TYPE pairs; a star marks the primary key."""
    out = []
    for part in text.split(", "):
        name, kind = part.split()
        out.append((name.rstrip("*"), kind, name.endswith("*")))
    return out


# The built-in node and edge types and the chain templates.
NODES = {
    "__Account": NodeSpec("__Account", _props("address* STRING, entity_label STRING, risk_label STRING, first_seen_block INT64, last_active_block INT64"), "Blockchain account"),
    "__Transaction": NodeSpec("__Transaction", _props("hash* STRING, block_number INT64, block_timestamp INT64, value STRING, gas_used INT64, gas_price STRING, status INT"), "Blockchain transaction"),
    "__Block": NodeSpec("__Block", _props("number* INT64, hash STRING, parent_hash STRING, timestamp INT64, miner STRING, tx_count INT64"), "Block"),
    "__Token": NodeSpec("__Token", _props("address* STRING, name STRING, symbol STRING, decimals INT, total_supply STRING"), "Token"),
    "__Contract": NodeSpec("__Contract", _props("address* STRING, name STRING, creator STRING, creation_block INT64, is_verified BOOL, bytecode_hash STRING"), "Contract"),
}
EDGES = {
    "__Transfer": EdgeSpec("__Transfer", "__Account", "__Account", _props("token_address STRING, first_time INT64, last_time INT64, sum STRING, tx_count INT64"), "Aggregated transfers"),
    "__TxRel": EdgeSpec("__TxRel", "__Account", "__Transaction", _props("type STRING, value STRING"), "Account and its transaction"),
    "__Call": EdgeSpec("__Call", "__Account", "__Contract", _props("method STRING, tx_hash STRING, block_number INT64, success BOOL"), "Contract call"),
    "__Approval": EdgeSpec("__Approval", "__Account", "__Account", _props("token_address STRING, amount STRING, tx_hash STRING"), "Token approval"),
    "__TokenTransfer": EdgeSpec("__TokenTransfer", "__Account", "__Account", _props("token_address STRING, amount STRING, tx_hash STRING, log_index INT"), "Single token transfer"),
}
TEMPLATES = ("__ethereum", "__tron", "__bsc", "__polygon")


class SchemaError(ValueError):
    pass


@dataclass
class GraphSchema:
    nodes: dict[str, NodeSpec] = field(default_factory=dict)
    edges: dict[str, EdgeSpec] = field(default_factory=dict)

    def struct(self, name: str) -> T.StructType:
        spec = self.nodes.get(name) or self.edges.get(name)
        if spec is None:
            raise SchemaError(f"no type {name}")
        return T.StructType([T.StructField(p, spark_type(k), not pk) for p, k, pk in spec.props])

    def ddl(self, graph: str) -> str:
        """CREATE GRAPH text that declares this schema."""

        def props(spec) -> str:
            return ", ".join(f"{p} {k}{' PRIMARY KEY' if pk else ''}" for p, k, pk in spec.props)

        parts = [f"NODE {n.name} {{{props(n)}}}" for n in self.nodes.values()]
        parts += [f"EDGE {e.name} ({e.source})-[{{{props(e)}}}]->({e.target})" for e in self.edges.values()]
        return f"CREATE GRAPH {graph} {{ {', '.join(parts)} }}"


def template(name: str) -> GraphSchema:
    """All built-in types, under a chain's template name."""
    if name not in TEMPLATES:
        raise SchemaError(f"unknown template {name}")
    return GraphSchema(dict(NODES), dict(EDGES))


def declare(types: list) -> GraphSchema:
    """A validated schema from the declarations of CREATE GRAPH."""
    from ..plans.ast import NodeType

    out = GraphSchema()
    for t in types:
        node = isinstance(t, NodeType)
        known = NODES if node else EDGES
        if t.name.startswith("__"):
            if node and t.name in TEMPLATES:
                chain = template(t.name)
                out.nodes.update(chain.nodes)
                out.edges.update(chain.edges)
                continue
            if t.name not in known or t.props:
                raise SchemaError(f"{t.name}: names with __ are reserved for built-in types")
            (out.nodes if node else out.edges)[t.name] = known[t.name]
            continue
        seen = [p for p, _, _ in t.props]
        if len(set(seen)) < len(seen):
            raise SchemaError(f"{t.name}: a property is declared twice")
        for _, kind, _ in t.props:
            spark_type(kind)
        if node:
            if not any(pk for _, _, pk in t.props):
                raise SchemaError(f"{t.name}: a node type needs a primary key")
            out.nodes[t.name] = NodeSpec(t.name, t.props)
        else:
            if t.source is None:
                raise SchemaError(f"{t.name}: an edge type needs its ends")
            out.edges[t.name] = EdgeSpec(t.name, t.source, t.target, t.props)
    for e in out.edges.values():
        for end in (e.source, e.target):
            if end not in out.nodes and not (e.name.startswith("__") and not out.nodes):
                raise SchemaError(f"{e.name}: no node type {end}")
    return out
