"""Recursive-descent parser of the query language.

The text is cut into tokens first.  Symbols that patterns and comparisons share
(< > - ~) are single tokens, and the rules say by context what they make up.
"""

from __future__ import annotations

import re

from .ast import (
    AGGREGATES, Binary, Call, CallProc, Case, CreateGraph, Delete, Describe, DropGraph, Edge, EdgeType, Exists, Expr, Filter, For, GraphPattern, Insert, IsNull, Item, Label, Let, Linear,
    ListOf, Lit, MapOf, Match, Node, NodeType, Order, Param, Paren, Path, Prop, Quantified, Quantifier, Return, Search, Select, Session, SetItem, SetOp, Show, Transaction, Unary, Update, UseGraph, Var,
)


class GqlSyntaxError(ValueError):
    pass


TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*--(?![>\[(])[^\n]*)
    |(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<param>\$[^\W\d]\w*)
    |(?P<name>[^\W\d]\w*|`[^`]+`)
    |(?P<symbol>\|\+\||\|\||<=|>=|<>|!=|[-<>=+*/%^(){}\[\],.:;|&!~?])""",
    re.S | re.X | re.M,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARE = ("=", "<>", "!=", "<=", ">=", "<", ">")


class Token:
    __slots__ = ("at", "kind", "text", "value")

    def __init__(self, kind, text, value, at):
        self.kind, self.text, self.value, self.at = kind, text, value, at


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise GqlSyntaxError(f"unexpected {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        if kind == "number":
            value = float(s) if re.search(r"[.eE]", s) else int(s)
            if isinstance(value, int) and value >= 1 << 63:
                raise GqlSyntaxError(f"integer out of range: {s}")
            out.append(Token(kind, s, value, at))
        elif kind == "string":
            out.append(Token(kind, s, re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), s[1:-1], flags=re.S), at))
        elif kind != "skip":
            out.append(Token(kind, s.upper() if kind == "name" and s[0] != "`" else s, s.strip("`") if kind == "name" else s, at))
        at = m.end()
    out.append(Token("end", "", None, len(text)))
    return out


class Parser:
    def __init__(self, text: str):
        self.toks, self.i = tokens(text), 0

    # -- tokens ---------------------------------------------------------------
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        """Whether these words or symbols come next."""
        for k, t in enumerate(texts):
            j = self.i + ahead + k
            if j >= len(self.toks) or self.toks[j].text != t or self.toks[j].kind not in ("name", "symbol"):
                return False
        return True

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.i += len(texts)
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise GqlSyntaxError(f"expected {' '.join(texts)} at {self.tok.at}, found {self.tok.text or 'the end'!r}")

    def name(self) -> str:
        if self.tok.kind != "name":
            raise GqlSyntaxError(f"expected a name at {self.tok.at}, found {self.tok.text or 'the end'!r}")
        self.i += 1
        return self.toks[self.i - 1].value

    def integer(self) -> int:
        if self.tok.kind != "number" or not isinstance(self.tok.value, int):
            raise GqlSyntaxError(f"expected a whole number at {self.tok.at}")
        self.i += 1
        return self.toks[self.i - 1].value

    def some(self, rule, sep: str = ",") -> list:
        out = [rule()]
        while self.take(sep):
            out.append(rule())
        return out

    # -- statements -----------------------------------------------------------
    def statement(self):
        out = self.set_operation()
        while self.take(";"):
            pass
        if self.tok.kind != "end":
            raise GqlSyntaxError(f"unexpected {self.tok.text!r} at {self.tok.at}")
        return out

    def set_operation(self):
        left = self.single()
        while self.tok.text in ("UNION", "EXCEPT", "INTERSECT", "OTHERWISE") and self.tok.kind == "name":
            op = self.tok.text
            self.i += 1
            every = self.take("ALL")
            self.take("DISTINCT")
            left = SetOp(op, every, left, self.single())
        return left

    def single(self):
        rules = {
            "INSERT": self.insert, "CREATE": self.create, "DROP": self.drop, "USE": self.use, "SHOW": self.show, "DESCRIBE": self.describe, "DESC": self.describe,
            "SESSION": self.session, "START": self.transaction, "COMMIT": self.transaction, "ROLLBACK": self.transaction, "SELECT": self.select,
        }
        if self.take("{"):
            inner = self.set_operation()
            self.need("}")
            return inner
        if self.tok.kind == "name" and self.tok.text in rules:
            return rules[self.tok.text]()
        return self.linear()

    def linear(self):
        steps: list = []
        while True:
            if self.peek("OPTIONAL", "CALL") or self.peek("CALL"):
                steps.append(self.call())
            elif self.peek("OPTIONAL") or self.peek("MATCH"):
                steps.append(self.match())
            elif self.take("LET"):
                steps.append(Let(self.some(self.assignment)))
            elif self.take("FOR"):
                steps.append(self.for_())
            elif self.take("FILTER"):
                self.take("WHERE")
                steps.append(Filter(self.expr()))
            elif self.peek("DETACH") or self.peek("NODETACH") or self.peek("DELETE"):
                detach = self.take("DETACH")
                self.take("NODETACH")
                self.need("DELETE")
                return Delete(self.some(self.name), detach, steps)
            elif self.take("SET"):
                return Update(self.some(self.set_item), False, steps)
            elif self.take("REMOVE"):
                return Update(self.some(self.remove_item), True, steps)
            else:
                break
        if not steps and not self.peek("RETURN"):
            raise GqlSyntaxError(f"unexpected {self.tok.text or 'the end'!r} at {self.tok.at}")
        return Linear(steps, self.result() if self.take("RETURN") else self.page(Return(None)))

    def assignment(self) -> Item:
        name = self.name()
        self.need("=")
        return Item(self.expr(), name)

    def for_(self) -> For:
        var = self.name()
        ordinal = self.name() if self.take(",") else None
        self.need("IN")
        items = self.expr()
        if self.take("WITH"):
            if not self.take("ORDINALITY"):
                self.need("OFFSET")
            self.take("AS")
            ordinal = self.name()
        return For(var, items, ordinal)

    def match(self) -> Match:
        optional = self.take("OPTIONAL")
        self.need("MATCH")
        return Match(self.graph_pattern(), optional)

    def graph_pattern(self) -> GraphPattern:
        different = False
        if self.take("REPEATABLE"):
            self.take("ELEMENTS") or self.need("ELEMENT")
        elif self.take("DIFFERENT"):
            self.take("EDGES") or self.need("EDGE")
            different = True
        paths = tuple(self.some(self.path))
        keep = self.search() if self.take("KEEP") else None
        where = self.expr() if self.take("WHERE") else None
        return GraphPattern(paths, where, different, keep)

    def result(self) -> Return:
        distinct = self.take("DISTINCT")
        self.take("ALL")
        items = None if self.take("*") else self.some(self.item)
        out = Return(items, distinct)
        if self.take("GROUP", "BY"):
            out.group_by = self.some(self.expr)
        if self.take("HAVING"):
            out.having = self.expr()
        return self.page(out)

    def page(self, out: Return) -> Return:
        if self.take("ORDER", "BY"):
            out.order = self.some(self.order)
        while True:
            if self.take("SKIP") or self.take("OFFSET"):
                out.offset = self.integer()
            elif self.take("LIMIT"):
                out.limit = self.integer()
            else:
                return out

    def item(self) -> Item:
        e = self.expr()
        return Item(e, self.name() if self.take("AS") else None)

    def order(self) -> Order:
        e = self.expr()
        down = self.take("DESC") or self.take("DESCENDING")
        if not down:
            self.take("ASC") or self.take("ASCENDING")
        first = None
        if self.take("NULLS"):
            first = self.take("FIRST")
            if not first:
                self.need("LAST")
        return Order(e, down, first)

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        out = Select(Return(None if self.take("*") else self.some(self.item), distinct))
        if self.take("FROM"):
            if not self.peek("MATCH") and not self.peek("OPTIONAL"):
                out.graph = self.name()
            while self.peek("MATCH") or self.peek("OPTIONAL"):
                out.matches.append(self.match())
        if self.take("WHERE"):
            out.where = self.expr()
        if self.take("GROUP", "BY"):
            out.result.group_by = self.some(self.expr)
        if self.take("HAVING"):
            out.result.having = self.expr()
        self.page(out.result)
        return out

    def call(self) -> CallProc:
        optional = self.take("OPTIONAL")
        self.need("CALL")
        name = ".".join(self.some(self.name, "."))
        args: list[Expr] = []
        if self.take("(") and not self.take(")"):
            args = self.some(self.expr)
            self.need(")")
        yields = []
        if self.take("YIELD"):
            yields = self.some(lambda: (n := self.name(), self.name() if self.take("AS") else n))
        return CallProc(name, args, yields, optional)

    # -- data changes ---------------------------------------------------------
    def insert(self) -> Insert:
        self.need("INSERT")
        return Insert(self.some(self.term))

    def set_item(self) -> SetItem:
        var = self.name()
        if self.take("."):
            key = self.name()
            self.need("=")
            return SetItem(var, "prop", key, self.expr())
        if self.take(":"):
            return SetItem(var, "label", self.name())
        if self.take("+"):
            self.need("=")
            return SetItem(var, "merge", value=self.map())
        self.need("=")
        return SetItem(var, "replace", value=self.map())

    def remove_item(self) -> SetItem:
        var = self.name()
        if self.take("."):
            return SetItem(var, "prop", self.name())
        self.need(":")
        return SetItem(var, "label", self.name())

    # -- definitions ----------------------------------------------------------
    def create(self) -> CreateGraph:
        self.need("CREATE")
        self.take("PROPERTY")
        self.need("GRAPH")
        lenient = self.take("IF", "NOT", "EXISTS")
        name, types = self.name(), []
        if self.take("{") and not self.take("}"):
            types = self.some(self.type_)
            self.need("}")
        return CreateGraph(name, lenient, types)

    def type_(self):
        if self.take("NODE"):
            name, props = self.name(), []
            for a, b in (("{", "}"), ("(", ")")):
                if self.take(a):
                    props = [] if self.peek(b) else self.some(self.property_)
                    self.need(b)
                    break
            return NodeType(name, props)
        self.need("EDGE")
        name, source, target, props = self.name(), None, None, []
        if self.take("("):
            source = self.name()
            self.need(")")
            self.need("-")
            self.need("[")
            if self.take("{"):
                props = [] if self.peek("}") else self.some(self.property_)
                self.need("}")
            elif not self.peek("]"):
                props = self.some(self.property_)
            self.need("]")
            self.need("-")
            self.need(">")
            self.need("(")
            target = self.name()
            self.need(")")
        return EdgeType(name, source, target, props)

    def property_(self) -> tuple[str, str, bool]:
        name = self.name()
        self.take(":") and self.take(":")
        kind = self.name()
        if kind.upper() == "SET" and self.take("<"):
            kind = f"SET<{self.name()}>"
            self.need(">")
        return name, kind, self.take("PRIMARY", "KEY")

    def drop(self) -> DropGraph:
        self.need("DROP")
        self.take("PROPERTY")
        self.need("GRAPH")
        lenient = self.take("IF", "EXISTS")
        return DropGraph(self.name(), lenient)

    def use(self) -> UseGraph:
        self.need("USE")
        if self.take("CURRENT_GRAPH") or self.take("CURRENT"):
            return UseGraph(None)
        if self.peek("GRAPH") and self.toks[self.i + 1].kind == "name":
            self.i += 1
        return UseGraph(self.name())

    def show(self) -> Show:
        self.need("SHOW")
        names = {
            ("GRAPH", "TYPES"): "graph types", ("GRAPH", "TYPE"): "graph types", ("GRAPHS",): "graphs", ("SCHEMAS",): "graph types", ("FUNCTIONS",): "functions", ("PROCEDURES",): "procedures", ("LABELS",): "labels",
            ("EDGE", "TYPES"): "edge types", ("RELATIONSHIP", "TYPES"): "edge types", ("PROPERTY", "KEYS"): "property keys", ("INDEXES",): "indexes", ("CONSTRAINTS",): "constraints",
        }
        for words, what in names.items():
            if self.take(*words):
                like = None
                if self.take("LIKE"):
                    like = self.string()
                return Show(what, like)
        raise GqlSyntaxError(f"nothing to show at {self.tok.at}")

    def string(self) -> str:
        if self.tok.kind != "string":
            raise GqlSyntaxError(f"expected a string at {self.tok.at}")
        self.i += 1
        return self.toks[self.i - 1].value

    def describe(self) -> Describe:
        self.i += 1
        what = "graph"
        if self.take("GRAPH", "TYPE") or self.take("SCHEMA"):
            what = "graph type"
        elif self.take("LABEL") or self.take("VERTEX"):
            self.take("TYPE")
            what = "label"
        elif self.take("EDGE") or self.take("RELATIONSHIP"):
            self.take("TYPE")
            what = "edge type"
        elif self.peek("GRAPH") and self.toks[self.i + 1].kind == "name":
            self.i += 1
        return Describe(what, self.name())

    def session(self) -> Session:
        self.need("SESSION")
        if self.take("CLOSE"):
            return Session("close")
        if self.take("RESET"):
            key = "all" if self.take("ALL") or self.tok.kind == "end" else self.session_key()
            return Session("reset", key)
        self.need("SET")
        key = self.session_key()
        if key in ("graph", "graph type", "schema"):
            return Session("set", key, self.name())
        if key == "time zone":
            return Session("set", key, self.string())
        self.need("=")
        return Session("set", key, self.expr())

    def session_key(self) -> str:
        if self.take("GRAPH", "TYPE"):
            return "graph type"
        if self.take("TIME", "ZONE"):
            return "time zone"
        for word in ("GRAPH", "SCHEMA"):
            if self.take(word):
                return word.lower()
        if self.tok.kind == "param":
            self.i += 1
            return self.toks[self.i - 1].text[1:]
        return self.name()

    def transaction(self) -> Transaction:
        if self.take("START", "TRANSACTION"):
            only = self.take("READ", "ONLY")
            if not only:
                self.take("READ", "WRITE")
            return Transaction("start", only)
        return Transaction(self.name().lower())

    # -- patterns -------------------------------------------------------------
    def path(self) -> Path:
        var = None
        if self.tok.kind == "name" and self.peek("=", ahead=1):
            var = self.name()
            self.need("=")
        mode = self.mode() or "WALK"
        search = self.search() if self.tok.text in ("ALL", "ANY", "SHORTEST") and self.tok.kind == "name" else None
        mode = self.mode() or mode
        self.take("PATHS") or self.take("PATH")
        terms, unions = [self.term()], []
        while self.peek("|") or self.peek("|+|"):
            unions.append(self.tok.text)
            self.i += 1
            terms.append(self.term())
        q = self.quantifier()
        if q:
            if unions:
                raise GqlSyntaxError("a quantified alternative is not supported; put each into parentheses")
            terms = [(Paren(terms[0], quantifier=q),)]
        return Path(tuple(terms), tuple(unions), var, mode, search)

    def mode(self) -> str | None:
        for m in ("WALK", "TRAIL", "SIMPLE", "ACYCLIC"):
            if self.take(m):
                return m
        return None

    def search(self) -> Search:
        if self.take("ALL"):
            return Search("all_shortest" if self.take("SHORTEST") else "all")
        if self.take("ANY"):
            if self.take("SHORTEST"):
                return Search("any_shortest")
            return Search("any", self.integer() if self.tok.kind == "number" else 1)
        self.need("SHORTEST")
        k = self.integer() if self.tok.kind == "number" else 1
        if self.take("GROUP") or self.take("GROUPS"):
            return Search("groups", k)
        return Search("shortest", k)

    def term(self) -> tuple:
        out = [self.node_or_paren()]
        while self.peek("-") or self.peek("<", "-") or self.peek("~") or self.peek("<", "~"):
            out.append(self.edge())
            out.append(self.node_or_paren())
        return tuple(out)

    def node_or_paren(self):
        if not self.peek("("):
            raise GqlSyntaxError(f"expected a node at {self.tok.at}, found {self.tok.text or 'the end'!r}")
        start = self.i
        self.i += 1
        if self.peek("(") or self.mode() or (self.tok.kind == "name" and self.peek("=", ahead=1)):
            self.i = start
            return self.paren()
        node = self.filler(Node)
        self.need(")")
        return node

    def paren(self) -> Paren:
        self.need("(")
        var = None
        if self.tok.kind == "name" and self.peek("=", ahead=1):
            var = self.name()
            self.need("=")
        mode = self.mode()
        term = self.term()
        where = self.expr() if self.take("WHERE") else None
        self.need(")")
        return Paren(term, var, mode, where, self.quantifier())

    def filler(self, kind, **more):
        var = self.name() if self.tok.kind == "name" and self.tok.text not in ("WHERE", "IS") else None
        label = self.label() if self.take(":") or self.take("IS") else None
        props = self.map().items if self.peek("{") else ()
        where = self.expr() if self.take("WHERE") else None
        return kind(var=var, label=label, props=props, where=where, **more)

    def edge(self) -> Edge:
        back = self.take("<")
        wave = self.take("~")
        if not wave:
            self.need("-")
        body = Edge("any")
        if self.take("["):
            body = self.filler(Edge, direction="any")
            self.need("]")
            if not (self.take("-") or self.take("~")):
                raise GqlSyntaxError(f"expected the end of an edge at {self.tok.at}")
        else:
            # --> <-- -- <-> and the short forms of one stroke
            self.take("-") or (wave and self.take("~"))
        forward = self.take(">")
        direction = "any" if back == forward else "out" if forward else "in"
        return Edge(direction, body.var, body.label, body.props, body.where, self.quantifier())

    def quantifier(self) -> Quantifier | None:
        if self.take("*"):
            return Quantifier(0, None)
        if self.take("+"):
            return Quantifier(1, None)
        if self.take("?"):
            return Quantifier(0, 1)
        if not self.take("{"):
            return None
        low = 0 if self.peek(",") else self.integer()
        high: int | None = low
        if self.take(","):
            high = self.integer() if self.tok.kind == "number" else None
        self.need("}")
        if high is not None and high < low:
            raise GqlSyntaxError(f"empty quantifier {{{low},{high}}}")
        return Quantifier(low, high)

    def label(self) -> Label:
        parts = [self.label_and()]
        while self.take("|"):
            self.take(":")
            parts.append(self.label_and())
        return parts[0] if len(parts) == 1 else Label("or", tuple(parts))

    def label_and(self) -> Label:
        parts = [self.label_not()]
        while self.take("&"):
            parts.append(self.label_not())
        return parts[0] if len(parts) == 1 else Label("and", tuple(parts))

    def label_not(self) -> Label:
        if self.take("!"):
            return Label("not", (self.label_not(),))
        if self.take("("):
            inner = self.label()
            self.need(")")
            return inner
        if self.take("%"):
            return Label("any")
        return Label("name", (self.name(),))

    # -- expressions ----------------------------------------------------------
    def map(self) -> MapOf:
        self.need("{")
        items = []
        while not self.take("}"):
            key = self.string() if self.tok.kind == "string" else self.name()
            self.need(":")
            items.append((key, self.expr()))
            if not self.peek("}"):
                self.need(",")
        return MapOf(tuple(items))

    def expr(self) -> Expr:
        return self.chain(("OR",), lambda: self.chain(("XOR",), lambda: self.chain(("AND",), self.not_)))

    def chain(self, ops: tuple[str, ...], rule) -> Expr:
        left = rule()
        while any(self.peek(o) for o in ops):
            op = self.tok.text
            self.i += 1
            left = Binary(op, left, rule())
        return left

    def not_(self) -> Expr:
        return Unary("NOT", self.not_()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Expr:
        left = self.additive()
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return IsNull(left, negated)
        negated = self.peek("NOT") and any(self.peek(w, ahead=1) for w in ("IN", "LIKE", "CONTAINS", "STARTS", "ENDS"))
        if negated:
            self.i += 1
        for words, op in ((("STARTS", "WITH"), "STARTS"), (("ENDS", "WITH"), "ENDS"), (("CONTAINS",), "CONTAINS"), (("LIKE",), "LIKE"), (("IN",), "IN")):
            if self.take(*words):
                e = Binary(op, left, self.additive())
                return Unary("NOT", e) if negated else e
        for op in COMPARE:
            if self.take(op):
                return Binary("<>" if op == "!=" else op, left, self.additive())
        return left

    def additive(self) -> Expr:
        return self.chain(("+", "-", "||"), lambda: self.chain(("*", "/", "%"), self.power))

    def power(self) -> Expr:
        base = self.unary()
        return Binary("^", base, self.power()) if self.take("^") else base

    def unary(self) -> Expr:
        if self.take("-"):
            arg = self.unary()
            return Lit(-arg.value) if isinstance(arg, Lit) and type(arg.value) in (int, float) else Unary("-", arg)
        if self.take("+"):
            return self.unary()
        e = self.primary()
        while self.peek("."):
            self.i += 1
            e = Prop(e, self.name())
        return e

    def primary(self) -> Expr:
        t = self.tok
        if t.kind in ("number", "string"):
            self.i += 1
            return Lit(t.value)
        if t.kind == "param":
            self.i += 1
            return Param(t.text[1:])
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            items = [] if self.peek("]") else self.some(self.expr)
            self.need("]")
            return ListOf(tuple(items))
        if self.peek("{"):
            return self.map()
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return Lit(value)
        if self.take("CASE"):
            return self.case()
        if self.peek("EXISTS", "{"):
            self.i += 2
            self.take("MATCH")
            pattern = self.graph_pattern()
            self.need("}")
            return Exists(pattern)
        if t.text in ("ALL", "ANY", "NONE", "SINGLE") and self.peek("(", ahead=1):
            return self.quantified()
        name = self.name()
        if self.take("("):
            return self.function(name)
        return Var(name)

    def quantified(self) -> Quantified:
        kind = self.name().upper()
        self.need("(")
        var = self.name()
        self.need("IN")
        items = self.expr()
        predicate: Expr = Lit(True)
        if self.take("WHERE") or self.take("|"):
            predicate = self.expr()
        self.need(")")
        return Quantified(kind, var, items, predicate)

    def function(self, name: str) -> Call:
        if self.take("*"):
            self.need(")")
            return Call(name.upper(), (), star=True)
        distinct = self.take("DISTINCT")
        args = [] if self.peek(")") else self.some(self.expr)
        self.need(")")
        return Call(name.upper(), tuple(args), distinct)

    def case(self) -> Case:
        operand = None if self.peek("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            cond = self.expr()
            self.need("THEN")
            whens.append((cond, self.expr()))
        default = self.expr() if self.take("ELSE") else None
        self.need("END")
        if not whens:
            raise GqlSyntaxError("CASE without WHEN")
        return Case(operand, tuple(whens), default)


def parse(text: str):
    """The syntax tree of one statement."""
    return Parser(text).statement()


def is_aggregate(e) -> bool:
    """Whether an aggregate stands anywhere in the expression."""
    if isinstance(e, Call) and e.name in AGGREGATES:
        return True
    if isinstance(e, Expr):
        return any(is_aggregate(x) for x in vars(e).values())
    return isinstance(e, tuple) and any(is_aggregate(x) for x in e)
