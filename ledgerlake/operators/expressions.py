"""Expressions of the query language as Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ast as A


class GqlError(ValueError):
    pass


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Table:
    """A binding table: one row a match.  Variables are spread over columns ``var@property``.

    kinds: node, edge (columns by property), group (of a repeated edge: @vertices, @edges), path (the same), scalar (one column, the name itself).
    """

    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)

    def props(self, var: str) -> list[str]:
        return [x[len(var) + 1 :] for x in self.df.columns if x.startswith(f"{var}@")]

    def value(self, var: str) -> Column:
        """The whole of a variable as one column."""
        kind = self.kinds[var]
        if kind == "scalar":
            return c(var)
        if kind == "path":
            return F.struct(c(f"{var}@vertices").alias("vertices"), c(f"{var}@edges").alias("edges"), F.size(c(f"{var}@edges")).alias("length"))
        if kind == "group":
            return c(f"{var}@edges")
        whole = F.struct(*(c(f"{var}@{p}").alias(p) for p in self.props(var)))
        return F.when(c(f"{var}@id").isNotNull(), whole)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

#: Spark functions that queries may call by their own names.
PASS_THROUGH = {
    "ABS", "CEIL", "FLOOR", "ROUND", "SQRT", "EXP", "LN", "LOG10", "SIGN", "SIN", "COS", "TAN", "GREATEST", "LEAST", "COALESCE", "NULLIF", "LENGTH", "CHAR_LENGTH", "OCTET_LENGTH", "LOWER", "UPPER", "TRIM", "LTRIM", "RTRIM",
    "SUBSTRING", "REPLACE", "REVERSE", "SPLIT", "CONCAT", "CONCAT_WS", "LPAD", "RPAD", "REGEXP_EXTRACT", "REGEXP_REPLACE", "ELEMENT_AT", "ARRAY_DISTINCT", "ARRAY_UNION", "ARRAY_INTERSECT", "ARRAY_MAX", "ARRAY_MIN", "ARRAY_SORT", "SLICE", "FLATTEN",
    "MAP_KEYS", "MAP_VALUES", "GET_JSON_OBJECT", "TO_JSON", "CURRENT_DATE", "CURRENT_TIMESTAMP", "DATE_TRUNC", "DATEDIFF", "YEAR", "MONTH", "DAY", "HEX", "UNHEX", "CONV", "MOD", "POWER",
}


class Compiler:
    """Turns expressions into Columns over one binding table."""

    def __init__(self, table: Table, params: dict | None = None):
        self.table, self.params = table, params or {}
        self.local: dict[str, Column] = {}

    def type_of(self, col: Column) -> T.DataType | None:
        """The type of a column; None inside a lambda, whose variables have none yet."""
        if self.local:
            return None
        try:
            return self.table.df.select(col).schema[0].dataType
        except Exception:
            return None

    def __call__(self, e: A.Expr) -> Column:
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def output(self, e: A.Expr) -> Column:
        """As a RETURN value: a bare variable gives the whole vertex, edge or path."""
        if isinstance(e, A.Var) and e.name in self.table.kinds:
            return self.table.value(e.name)
        return self(e)

    def _lit(self, e: A.Lit) -> Column:
        return F.lit(e.value).cast("long") if type(e.value) is int else F.lit(e.value)

    def _param(self, e: A.Param) -> Column:
        if e.name not in self.params:
            raise GqlError(f"no value for parameter ${e.name}")
        v = self.params[e.name]
        return F.array(*(F.lit(x) for x in v)) if isinstance(v, list | tuple) else self._lit(A.Lit(v))

    def _var(self, e: A.Var) -> Column:
        if e.name in self.local:
            return self.local[e.name]
        kind = self.table.kinds.get(e.name)
        if kind is None:
            if "_" in self.table.kinds and f"_@{e.name}" in self.table.df.columns:
                return c(f"_@{e.name}")
            raise GqlError(f"unknown variable {e.name}")
        if kind in ("node", "edge"):
            return c(f"{e.name}@id")
        return self.table.value(e.name)

    def _prop(self, e: A.Prop) -> Column:
        if isinstance(e.of, A.Var) and e.of.name not in self.local:
            kind = self.table.kinds.get(e.of.name)
            if kind is None:
                raise GqlError(f"unknown variable {e.of.name}")
            if kind != "scalar":
                if kind in ("path", "group") and e.name == "length":
                    return F.size(c(f"{e.of.name}@edges"))
                name = f"{e.of.name}@{e.name}"
                if name in self.table.df.columns:
                    return c(name)
                ext = f"{e.of.name}@ext"
                return c(ext).getItem(e.name) if ext in self.table.df.columns else F.lit(None)
        base = self(e.of)
        kind = self.type_of(base)
        if isinstance(kind, T.StructType) and e.name not in kind.names:
            return F.lit(None)
        return base[e.name]

    def _unary(self, e: A.Unary) -> Column:
        return ~self(e.arg) if e.op == "NOT" else -self(e.arg)

    def _isnull(self, e: A.IsNull) -> Column:
        col = self(e.arg)
        return col.isNotNull() if e.negated else col.isNull()

    def _listof(self, e: A.ListOf) -> Column:
        return F.array(*(self(x) for x in e.items))

    def _mapof(self, e: A.MapOf) -> Column:
        return F.struct(*(self(v).alias(k) for k, v in e.items))

    def _case(self, e: A.Case) -> Column:
        out = None
        for cond, value in e.whens:
            test = self(cond) if e.operand is None else self.compare("=", self(e.operand), self(cond))
            out = (F if out is None else out).when(test, self(value))
        return out.otherwise(self(e.default)) if e.default is not None else out

    def _quantified(self, e: A.Quantified) -> Column:
        def test(x: Column) -> Column:
            before = self.local
            self.local = {**before, e.var: x}
            try:
                return self(e.predicate)
            finally:
                self.local = before

        items = self(e.items)
        if e.kind == "ALL":
            return F.forall(items, test)
        if e.kind == "SINGLE":
            return F.size(F.filter(items, test)) == 1
        found = F.exists(items, test)
        return ~found if e.kind == "NONE" else found

    def _exists(self, e: A.Exists) -> Column:
        raise GqlError("EXISTS can only stand in WHERE, FILTER or an inline WHERE")

    def compare(self, op: str, a: Column, b: Column) -> Column:
        """Values of different kinds are unequal and have no order."""
        x, y = self.type_of(a), self.type_of(b)
        if x is not None and y is not None and not isinstance(x, T.NullType) and not isinstance(y, T.NullType):
            number = isinstance(x, NUMERIC), isinstance(y, NUMERIC)
            if number != (True, True) and type(x) is not type(y):
                known = a.isNotNull() & b.isNotNull()
                return F.when(known, F.lit(op == "<>"))
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _binary(self, e: A.Binary) -> Column:
        if e.op == "IN" and isinstance(e.right, A.ListOf):
            left = self(e.left)
            tests = [self.compare("=", left, self(x)) for x in e.right.items]
            return reduce(lambda p, q: p | q, tests) if tests else F.lit(False)
        a, b = self(e.left), self(e.right)
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(e.op, a, b)
        if e.op in ("AND", "OR", "XOR"):
            return a & b if e.op == "AND" else a | b if e.op == "OR" else a != b
        if e.op in ("+", "-", "*"):
            return a + b if e.op == "+" else a - b if e.op == "-" else a * b
        if e.op == "||":
            return F.concat(a.cast("string"), b.cast("string")) if not isinstance(self.type_of(a), T.ArrayType) else F.concat(a, b)
        if e.op in ("/", "%", "^"):
            whole = isinstance(self.type_of(a), WHOLE) and isinstance(self.type_of(b), WHOLE)
            if e.op == "/":
                if not whole:
                    return F.try_divide(a, b)
                # Toward zero, as for whole numbers elsewhere; null for a zero divisor.
                return F.call_function("div", a, F.when(b != 0, b))
            if e.op == "%":
                return a % F.when(b != 0, b)
            power = F.pow(a.cast("double"), b.cast("double"))
            return power.try_cast("long") if whole else power
        if e.op == "CONTAINS":
            return F.contains(a, b)
        if e.op == "STARTS":
            return F.startswith(a, b)
        if e.op == "ENDS":
            return F.endswith(a, b)
        if e.op == "LIKE":
            return F.like(a, b)
        if e.op == "IN":
            return F.array_contains(b, a)
        raise GqlError(f"unknown operator {e.op}")

    def _call(self, e: A.Call) -> Column:
        if e.name in A.AGGREGATES:
            return self.aggregate(e)
        args = [self(x) for x in e.args]
        if e.name in ("ID", "ELEMENT_ID"):
            return args[0]
        if e.name in ("LABEL", "TYPE") and isinstance(e.args[0], A.Var):
            return c(f"{e.args[0].name}@label")
        if e.name in ("LABELS",) and isinstance(e.args[0], A.Var):
            return F.array(c(f"{e.args[0].name}@label"))
        if e.name in ("TOSTRING", "TO_STRING"):
            return args[0].cast("string")
        if e.name in ("TOINTEGER", "TO_INTEGER"):
            return args[0].try_cast("double").try_cast("long") if isinstance(self.type_of(args[0]), T.StringType) else args[0].try_cast("long")
        if e.name in ("TOFLOAT", "TO_FLOAT"):
            return args[0].try_cast("double")
        if e.name in ("PATH_LENGTH",) or (e.name == "LENGTH" and isinstance(e.args[0], A.Var) and self.table.kinds.get(e.args[0].name) in ("path", "group")):
            return F.size(c(f"{e.args[0].name}@edges"))
        if e.name in ("NODES", "EDGES", "RELATIONSHIPS"):
            return c(f"{e.args[0].name}@{'vertices' if e.name == 'NODES' else 'edges'}")
        if e.name in ("SIZE", "CARDINALITY"):
            return F.size(args[0])
        if e.name == "RANGE":
            # The end is exclusive; an empty range is an empty list.
            return F.when(args[0] < args[1], F.sequence(args[0], args[1] - 1)).otherwise(F.array().cast("array<bigint>"))
        if e.name in PASS_THROUGH:
            return F.call_function(e.name.lower(), *args)
        raise GqlError(f"unknown function {e.name}")

    def aggregate(self, e: A.Call) -> Column:
        if e.star:
            if e.name != "COUNT":
                raise GqlError(f"{e.name}(*) is no aggregate")
            return F.count(F.lit(1))
        args = [self(x) for x in e.args]
        if e.distinct:
            distinct = {"COUNT": F.count_distinct, "SUM": F.sum_distinct, "COLLECT": F.collect_set, "MIN": F.min, "MAX": F.max}
            if e.name in distinct:
                return distinct[e.name](*args)
            if e.name == "AVG":
                total = F.sum_distinct(args[0])
                whole = self.type_of(args[0])
                return F.try_divide(total.cast("double") if isinstance(whole, WHOLE) else total, F.count_distinct(args[0]))
            # The other spreads take DISTINCT by SQL text, which needs a column.
            name = f"{e.args[0].of.name}@{e.args[0].name}" if isinstance(e.args[0], A.Prop) and isinstance(e.args[0].of, A.Var) else getattr(e.args[0], "name", "")
            spreads = {"STDDEV": "stddev_samp", "STDDEV_SAMP": "stddev_samp", "STDDEV_POP": "stddev_pop", "VARIANCE": "var_samp", "VAR_SAMP": "var_samp", "VAR_POP": "var_pop"}
            if e.name not in spreads or name not in self.table.df.columns:
                raise GqlError(f"{e.name} DISTINCT takes a property or a value bound by LET")
            return F.expr(f"{spreads[e.name]}(DISTINCT `{name}`)")
        plain = {
            "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COLLECT": F.collect_list, "STDDEV": F.stddev_samp, "STDDEV_SAMP": F.stddev_samp, "STDDEV_POP": F.stddev_pop,
            "VARIANCE": F.var_samp, "VAR_SAMP": F.var_samp, "VAR_POP": F.var_pop, "APPROX_COUNT_DISTINCT": F.approx_count_distinct, "PERCENTILE_APPROX": F.percentile_approx,
        }
        return plain[e.name](*args)
