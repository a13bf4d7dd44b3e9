"""Binding of expressions: names to columns, overloads by type, aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import REGISTRY, L, cast_to, list_extract, list_slice
from ..types import INTERVAL, is_int, is_interval
from .parser import QueryError

AGGREGATES = {"COUNT", "COUNT_STAR", "SUM", "AVG", "MIN", "MAX", "COLLECT", "PERCENTILEDISC", "PERCENTILECONT", "HISTOGRAM"}


@dataclass
class Value:
    """A variable held in one column."""

    column: str


@dataclass
class Node:
    """A node variable: columns v___id, v___label and v__<property>."""

    name: str
    labels: list[str]
    props: list[str]
    pk: str | None = None


@dataclass
class Rel:
    """A relationship variable: v___src, v___dst, their labels, v___label, v___rid, properties."""

    name: str
    labels: list[str]
    props: list[str]


@dataclass
class Walk:
    """A recursive relationship: v___len, and v___nodes, v___rels, v___cost where needed."""

    name: str
    props: list[str] = field(default_factory=list)


@dataclass
class Path:
    """A named path over pattern variables, nodes and relationships in turn."""

    name: str
    items: list[str] = field(default_factory=list)


@dataclass
class Scope:
    graph: object
    df: DataFrame
    vars: dict[str, object]
    params: dict = field(default_factory=dict)
    used: dict[str, set] = field(default_factory=dict)

    def at(self, df: DataFrame) -> Scope:
        return Scope(self.graph, df, self.vars, self.params, self.used)


class Arg:
    """A bound argument; its type is found when asked for."""

    def __init__(self, binder: Binder, ast, column: Column):
        self.binder, self.ast, self.c = binder, ast, column
        self._t = None

    @property
    def t(self) -> T.DataType:
        if self._t is None:
            self._t = self.binder.type_of(self.ast)
        return self._t


class Binder:
    """Expressions of one scope. ``lam`` holds lambda variables, ``twin`` a binder
    of the same expressions in which these are plain columns, to find types."""

    def __init__(self, scope: Scope, lam: dict[str, Column] | None = None, twin: Binder | None = None, columns: dict[str, Column] | None = None):
        self.scope, self.graph = scope, scope.graph
        self.lam, self.twin, self.columns = lam or {}, twin, columns or {}

    # ------------------------------------------------------------ types
    def type_of(self, ast) -> T.DataType:
        if ast[0] == "lit":
            v = ast[1]
            if isinstance(v, bool):
                return T.BooleanType()
            if isinstance(v, int) and abs(v) < 2**63:
                return T.LongType()
            if isinstance(v, float):
                return T.DoubleType()
            if isinstance(v, str):
                return T.StringType()
        b = self.twin or self
        return b.scope.df.select(b.expr(ast).alias("x")).schema[0].dataType

    def arg(self, ast) -> Arg:
        if ast[0] == "lambda":
            return Arg(self, ast, L(None))
        if ast[0] == "named":
            inner = self.arg(ast[2])
            out = Arg(self, ("named", ast[1]), inner.c)
            out._t = inner._t
            return out
        return Arg(self, ast, self.expr(ast))

    def text(self, a: Arg) -> Column:
        return text_of(a.c, a.t)

    def join_text(self, a: Arg, sep: Column) -> Column:
        e = a.t.elementType
        parts = F.transform(a.c, lambda x: F.coalesce(text_of(x, e), L("")))
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), L(1))), F.coalesce(F.get(parts, L(0)), L("")), lambda acc, x: F.concat(acc, sep, x))

    # ------------------------------------------------------- variables
    def var(self, name: str):
        found = self.scope.vars.get(name)
        if found is None:
            for k, v in self.scope.vars.items():
                if k.upper() == name.upper():
                    return v
            raise QueryError(f"Variable {name} is not in scope.")
        return found

    def prop(self, v, key: str) -> Column:
        if isinstance(v, Node) and v.pk and key.upper() == v.pk.upper():
            return F.col(f"{v.name}___id")
        for p in v.props:
            if p.upper() == key.upper():
                return F.col(f"`{v.name}__{p}`")
        raise QueryError(f"Cannot find property {key} for {v.name}.")

    def internal_id(self, label: Column, key: Column, kind: T.DataType) -> Column:
        """(table, offset) of a node from its label and key."""
        tables = self.graph.catalog.nodes
        number = F.coalesce(*[F.when(label == t.name, L(t.number)) for t in tables.values()]) if tables else L(0)
        offset = key.cast("long") if is_int(kind) else F.xxhash64(key)
        return F.struct(number.cast("int").alias("table"), offset.alias("offset"))

    def node_struct(self, v: Node, props: list[str] | None = None) -> Column:
        df = self.scope.df
        key, label = F.col(f"{v.name}___id"), F.col(f"{v.name}___label")
        fields = [F.col(f"`{v.name}__{p}`").alias(p) for p in (props or v.props) if f"{v.name}__{p}" in df.columns]
        body = F.struct(self.internal_id(label, key, df.schema[f"{v.name}___id"].dataType).alias("_ID"), label.alias("_LABEL"), *fields)
        return F.when(key.isNotNull(), body)

    def rel_struct(self, v: Rel) -> Column:
        df = self.scope.df
        end = lambda s: self.internal_id(F.col(f"{v.name}___{s}label"), F.col(f"{v.name}___{s}"), df.schema[f"{v.name}___{s}"].dataType)
        label = F.col(f"{v.name}___label")
        number = F.coalesce(*[F.when(label == t.name, L(t.number)) for t in self.graph.catalog.rels.values()])
        fields = [F.col(f"`{v.name}__{p}`").alias(p) for p in v.props]
        rid = F.struct(number.cast("int").alias("table"), F.col(f"{v.name}___rid").alias("offset"))
        return F.when(F.col(f"{v.name}___rid").isNotNull(), F.struct(end("src").alias("_SRC"), end("dst").alias("_DST"), label.alias("_LABEL"), rid.alias("_ID"), *fields))

    def identity(self, ast):
        """Columns that tell nodes or relationships apart, or None for other expressions."""
        if ast[0] == "call" and ast[1] in ("ID", "ROWID") and len(ast[2]) == 1:
            ast = ast[2][0]
        if ast[0] == "var" and ast[1] not in self.lam and ast[1] in self.scope.vars:
            v = self.scope.vars[ast[1]]
            if isinstance(v, Node):
                return [F.col(f"{v.name}___id"), F.col(f"{v.name}___label")]
            if isinstance(v, Rel):
                return [F.col(f"{v.name}___rid"), F.col(f"{v.name}___label")]
        return None

    def path_nodes(self, v) -> Column:
        if isinstance(v, Walk):
            return F.col(f"{v.name}___nodes")
        props = sorted({p for i in v.items for p in getattr(self.scope.vars[i], "props", []) if isinstance(self.scope.vars[i], Node)} | {p for i in v.items if isinstance(self.scope.vars[i], Walk) for p in self.scope.vars[i].props})
        parts = []
        for i in v.items:
            x = self.scope.vars[i]
            if isinstance(x, Node):
                df = self.scope.df
                fields = [(F.col(f"`{x.name}__{p}`") if f"{x.name}__{p}" in df.columns else L(None).cast(self.graph.prop_type(p))).alias(p) for p in props]
                parts.append(F.array(F.struct(self.internal_id(F.col(f"{x.name}___label"), F.col(f"{x.name}___id"), df.schema[f"{x.name}___id"].dataType).alias("_ID"), F.col(f"{x.name}___label").alias("_LABEL"), *fields)))
            elif isinstance(x, Walk):
                parts.append(F.transform(F.col(f"{x.name}___nodes"), self.widened(set(x.props), props)))
        return F.concat(*parts)

    def widened(self, have: set[str], props: list[str]):
        """A function from a node struct to one with all of ``props``."""
        fill = lambda n, p: n[p] if p in have else L(None).cast(self.graph.prop_type(p))
        return lambda n: F.struct(n["_ID"].alias("_ID"), n["_LABEL"].alias("_LABEL"), *[fill(n, p).alias(p) for p in props])

    def path_rels(self, v) -> Column:
        if isinstance(v, Walk):
            return F.col(f"{v.name}___rels")
        slim = lambda r: F.struct(r["_SRC"].alias("_SRC"), r["_DST"].alias("_DST"), r["_LABEL"].alias("_LABEL"), r["_ID"].alias("_ID"))
        kinds = [self.scope.vars[i] for i in v.items if not isinstance(self.scope.vars[i], Node)]
        if all(isinstance(x, Rel) for x in kinds) and len({tuple(x.props) for x in kinds}) == 1:
            slim = lambda r: r
        parts = [F.array(slim(self.rel_struct(x))) if isinstance(x, Rel) else F.transform(F.col(f"{x.name}___rels"), slim) for x in kinds]
        return F.concat(*parts) if parts else F.array()

    def length(self, v) -> Column:
        if isinstance(v, Walk):
            return F.col(f"{v.name}___len").cast("long")
        out = L(0)
        for i in v.items:
            x = self.scope.vars[i]
            if not isinstance(x, Node):
                out = out + (L(1) if isinstance(x, Rel) else F.col(f"{x.name}___len"))
        return out.cast("long")

    # ----------------------------------------------------- expressions
    def expr(self, ast) -> Column:
        return getattr(self, "_" + ast[0])(ast)

    def _lit(self, ast):
        v = ast[1]
        if isinstance(v, int) and not isinstance(v, bool):
            return L(v).cast("long") if -(2**63) <= v < 2**63 else L(str(v)).cast("decimal(38,0)")
        return L(v)

    def _param(self, ast):
        if ast[1] not in self.scope.params:
            raise QueryError(f"Parameter {ast[1]} not found.")
        return self.value(self.scope.params[ast[1]])

    def value(self, v) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[self.value(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.value(x).alias(k) for k, x in v.items()])
        return self._lit(("lit", v))

    def _col(self, ast):
        return F.col(f"`{ast[1]}`")

    def _var(self, ast):
        if ast[1] in self.lam:
            return self.lam[ast[1]]
        v = self.var(ast[1])
        if isinstance(v, Value):
            return F.col(f"`{v.column}`")
        if isinstance(v, Node):
            return self.node_struct(v)
        if isinstance(v, Rel):
            return self.rel_struct(v)
        return F.struct(self.path_nodes(v).alias("_NODES"), self.path_rels(v).alias("_RELS"))

    def _prop(self, ast):
        base, key = ast[1], ast[2]
        if base[0] == "var" and base[1] not in self.lam:
            v = self.var(base[1])
            if isinstance(v, (Node, Rel)):
                return self.prop(v, key)
        c = self.expr(base)
        t = self.type_of(base)
        if isinstance(t, T.StructType):
            for name in t.names:
                if name.upper() == key.upper():
                    return c[name]
            raise QueryError(f"Invalid struct field name: {key}.")
        if isinstance(t, T.MapType):
            return c[key]
        raise QueryError(f"{key} is asked of a value that is no struct, node or relationship.")

    def _op(self, ast):
        op = ast[1]
        if op in ("=", "<>"):
            a, b = self.identity(ast[2]), self.identity(ast[3])
            if a and b:
                same = (a[0] == b[0]) & (a[1] == b[1])
                return same if op == "=" else ~same
        if op in ("AND", "OR", "XOR"):
            x, y = self.expr(ast[2]).cast("boolean"), self.expr(ast[3]).cast("boolean")
            return {"AND": x & y, "OR": x | y, "XOR": x != y}[op]
        a, b = self.arg(ast[2]), self.arg(ast[3])
        if op in ("=", "<>", "<", "<=", ">", ">="):
            x, y = a.c, b.c
            if is_interval(a.t) or is_interval(b.t):
                # A month counts as thirty days in comparisons.
                days = lambda c: (c["months"].cast("decimal(38,0)") * 30 + c["days"]) * 86_400_000_000 + c["micros"]
                x, y = days(x), days(y)
            elif isinstance(b.t, T.StringType) and isinstance(a.t, (T.DateType, T.TimestampNTZType)):
                y = y.cast(a.t)
            elif isinstance(a.t, T.StringType) and isinstance(b.t, (T.DateType, T.TimestampNTZType)):
                x = x.cast(b.t)
            return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return REGISTRY[op](self, a, b)

    def _not(self, ast):
        return ~self.expr(ast[1]).cast("boolean")

    def _neg(self, ast):
        a = self.arg(ast[1])
        return F.struct(*[(-a.c[f]).alias(f) for f in INTERVAL.names]) if is_interval(a.t) else -a.c

    def _isnull(self, ast):
        who = self.identity(ast[1])
        return (who[0] if who else self.expr(ast[1])).isNull()

    def _list(self, ast):
        return F.array(*[self.expr(x) for x in ast[1]])

    def _struct(self, ast):
        return F.struct(*[self.expr(x).alias(k) for k, x in ast[1]])

    def _case(self, ast):
        out = None
        for c, v in ast[1]:
            out = F.when(self.expr(c), self.expr(v)) if out is None else out.when(self.expr(c), self.expr(v))
        return out.otherwise(self.expr(ast[2])) if ast[2] else out

    def _cast(self, ast):
        return cast_to(self, self.arg(ast[1]), ast[2])

    def _index(self, ast):
        a, i = self.arg(ast[1]), self.arg(ast[2])
        if isinstance(a.t, T.StructType):
            return a.c[i.ast[1]]
        return list_extract(self, a, i)

    def _slice(self, ast):
        return list_slice(self, self.arg(ast[1]), ast[2] and self.arg(ast[2]), ast[3] and self.arg(ast[3]))

    def over(self, names: list[str], kinds: list[T.DataType], body):
        """A Python function for Spark's higher-order functions from a lambda body."""
        base = (self.twin or self).scope
        twin_df = base.df
        shadow = dict((self.twin or self).lam)
        for n, k in zip(names, kinds, strict=True):
            twin_df = twin_df.withColumn(f"_lam_{n}", L(None).cast(k))
            shadow[n] = F.col(f"_lam_{n}")
        twin = Binder(base.at(twin_df), shadow)
        return lambda *cols: Binder(self.scope, {**self.lam, **dict(zip(names, cols, strict=True))}, twin, self.columns).expr(body)

    @staticmethod
    def arity(f, n: int):
        return (lambda x: f(x)) if n == 1 else (lambda x, y: f(x, y))

    def _quant(self, ast):
        _, kind, var, of, p = ast
        a = self.arg(of)
        f = self.over([var], [a.t.elementType], p)
        test = lambda x: F.coalesce(f(x), L(False))
        if kind == "ALL":
            return F.forall(a.c, test)
        if kind == "SINGLE":
            return F.size(F.filter(a.c, test)) == 1
        return F.exists(a.c, test) if kind == "ANY" else ~F.exists(a.c, test)

    def _call(self, ast):
        _, name, args, distinct = ast
        if id(ast) in self.columns:
            return self.columns[id(ast)]
        if name in AGGREGATES:
            raise QueryError(f"Aggregate {name} is not allowed here.")
        if (macro := self.graph.catalog._find(self.graph.catalog.macros, name)) is not None:
            return self.expr(expand(macro, args))
        special = getattr(self, "_f_" + name.lower(), None)
        if special:
            return special(*args)
        if name in self.graph.udfs:
            return self.graph.udfs[name](*[self.expr(a) for a in args])
        if name not in REGISTRY:
            raise QueryError(f"function {name} does not exist")
        return REGISTRY[name](self, *[self.arg(a) for a in args])

    # Functions with lambdas
    def _f_list_transform(self, of, lam):
        a = self.arg(of)
        return F.transform(a.c, self.arity(self.over(lam[1], [a.t.elementType], lam[2]), 1))

    def _f_list_filter(self, of, lam):
        a = self.arg(of)
        return F.filter(a.c, self.arity(self.over(lam[1], [a.t.elementType], lam[2]), 1))

    def _f_list_reduce(self, of, lam):
        a = self.arg(of)
        e = a.t.elementType
        f = self.over(lam[1], [e, e], lam[2])
        start = F.when(F.size(a.c) == 0, F.raise_error(L("Cannot execute list_reduce on an empty list."))).otherwise(F.get(a.c, L(0)))
        return F.aggregate(F.slice(a.c, 2, F.greatest(F.size(a.c), L(1))), start, lambda x, y: f(x, y).cast(e))

    # Functions of nodes, relationships and paths
    def graph_var(self, ast):
        return self.scope.vars.get(ast[1]) if ast[0] == "var" and ast[1] not in self.lam else None

    def _f_id(self, ast):
        v = self.graph_var(ast)
        if isinstance(v, Node):
            return self.node_struct(v)["_ID"]
        if isinstance(v, Rel):
            return self.rel_struct(v)["_ID"]
        return self.expr(ast)["_ID"]

    def _f_rowid(self, ast):
        return self._f_id(ast)["offset"]

    def _f_offset(self, ast):
        return self.expr(ast)["offset"]

    def _f_label(self, ast):
        v = self.graph_var(ast)
        return F.col(f"{v.name}___label") if isinstance(v, (Node, Rel)) else self.expr(ast)["_LABEL"]

    _f_labels = _f_label

    def _f_keys(self, ast):
        if isinstance(t := self.type_of(ast), T.StructType) and "_LABEL" not in t.names:
            return F.when(self.expr(ast).isNotNull(), F.array(*[L(n) for n in t.names]))
        v = self.graph_var(ast)
        return F.array(*[L(p) for p in v.props])

    def _f_start_node(self, ast, side="src"):
        v = self.graph_var(ast)
        for x in self.scope.vars.values():
            if isinstance(x, Node) and getattr(v, side, None) == x.name:
                return self.node_struct(x)
        return F.struct(self.rel_struct(v)["_SRC" if side == "src" else "_DST"].alias("_ID"), F.col(f"{v.name}___{side}label").alias("_LABEL"))

    def _f_end_node(self, ast):
        return self._f_start_node(ast, "dst")

    def _f_cost(self, ast):
        return F.col(f"{self.graph_var(ast).name}___cost")

    def _f_nodes(self, ast):
        v = self.graph_var(ast)
        return self.path_nodes(v) if isinstance(v, (Walk, Path)) else self.expr(ast)["_NODES"]

    def _f_rels(self, ast):
        v = self.graph_var(ast)
        return self.path_rels(v) if isinstance(v, (Walk, Path)) else self.expr(ast)["_RELS"]

    _f_relationships = _f_rels

    def _f_length(self, ast):
        v = self.graph_var(ast)
        return self.length(v) if isinstance(v, (Walk, Path)) else F.size(self.expr(ast)["_RELS"]).cast("long")

    def _f_is_trail(self, ast):
        ids = F.transform(self._f_rels(ast), lambda r: r["_ID"])
        return F.size(F.array_distinct(ids)) == F.size(ids)

    def _f_is_acyclic(self, ast):
        ids = F.transform(self._f_nodes(ast), lambda r: r["_ID"])
        return F.size(F.array_distinct(ids)) == F.size(ids)

    def _f_properties(self, ast, key=None):
        if key is None:
            v = self.graph_var(ast)
            return F.struct(*[F.col(f"`{v.name}__{p}`").alias(p) for p in v.props])
        return F.transform(self.expr(ast), lambda x: x[key[1]])

    def _f_struct_extract(self, ast, key):
        return self._prop(("prop", ast, key[1]))

    # ------------------------------------------------------ aggregates
    def aggregate(self, ast) -> Column:
        _, name, args, distinct = ast
        if name == "COUNT_STAR":
            return F.count(L(1))
        who = self.identity(args[0])
        a = self.arg(args[0]) if not who or name != "COUNT" else None
        if name == "COUNT":
            cols = who or [a.c]
            return F.count_distinct(*cols) if distinct else F.count(cols[0])
        if name == "SUM":
            c = a.c.cast("decimal(38,0)") if is_int(a.t) else a.c
            return F.sum_distinct(c) if distinct else F.sum(c)
        if name == "AVG":
            c = a.c.cast("double")
            return F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)
        if name == "COLLECT":
            return F.nullif(F.collect_set(a.c) if distinct else F.collect_list(a.c), F.array().cast(T.ArrayType(a.t)))
        if name in ("MIN", "MAX"):
            return (F.min if name == "MIN" else F.max)(a.c)
        if name == "PERCENTILECONT":
            return F.percentile(a.c.cast("double"), L(float(args[1][1])))
        if name == "PERCENTILEDISC" and isinstance(a.t, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)):
            # Counts per value, added up before the shuffle; these types pass through a double unchanged.
            hidden = f"_ranked{len(self.scope.df.columns)}"
            self.scope.df = self.scope.df.withColumn(hidden, a.c)
            return F.expr(f"percentile_disc({float(args[1][1])}D) WITHIN GROUP (ORDER BY `{hidden}`)").cast(a.t)
        if name == "PERCENTILEDISC":
            ordered = F.array_sort(F.collect_list(a.c))
            at = F.greatest(F.ceil(F.size(ordered) * L(float(args[1][1]))), L(1)).cast("int")
            return F.when(F.size(ordered) > 0, F.element_at(ordered, at))
        bins = args[1][1] if len(args) > 1 else 10
        width = args[2][1] if len(args) > 2 else None
        return histogram(bins, width)(F.array_sort(F.collect_list(a.c.cast("double"))))


def histogram(bins: int, width: float | None):
    """Counts per bin of a sorted list, bins of equal depth or of a fixed width."""
    import math

    def bin_counts(x):
        if x is None or not len(x):
            return None
        span = x[-1] - x[0]
        digits = 0 if span >= 100 else 1 if span >= 10 else 2 if span >= 1 else 3
        name = lambda lo, hi: f"{lo:.{digits}f}-{hi:.{digits}f}"
        out: dict[str, int] = {}
        if width:
            k = max(1, math.ceil(span / width))
            for v in x:
                i = min(k - 1, int((v - x[0]) // width))
                key = name(x[0] + i * width, x[0] + (i + 1) * width)
                out[key] = out.get(key, 0) + 1
            return out
        at, k = 0, min(bins, len(x))
        for i in range(k):
            if at >= len(x):
                break
            end = min(len(x), at + math.ceil((len(x) - at) / (k - i)))
            while end < len(x) and x[end] == x[end - 1]:
                end += 1
            key = name(x[at], x[end - 1])
            out[key] = out.get(key, 0) + end - at
            at = end
        return out

    return F.udf(bin_counts, T.MapType(T.StringType(), T.LongType()))


def expand(macro: tuple, args: list):
    """Macro body with its parameters replaced."""
    params, body = macro[0], macro[1]
    given = {a[1].upper(): a[2] for a in args if a[0] == "named"}
    plain = iter([a for a in args if a[0] != "named"])
    values = {}
    for name, default in params:
        values[name] = given.get(name.upper()) or next(plain, default)
        if values[name] is None:
            raise QueryError(f"macro argument {name} is missing")
    return replace(body, lambda x: values.get(x[1]) if x[0] == "var" else None)


def replace(ast, f):
    """A copy of an expression with each node for which ``f`` gives another replaced."""
    if isinstance(ast, tuple):
        if ast and isinstance(ast[0], str) and (new := f(ast)) is not None:
            return new
        return tuple(replace(x, f) for x in ast)
    if isinstance(ast, list):
        return [replace(x, f) for x in ast]
    return ast


def walk(ast):
    """Every expression node below and including ``ast``."""
    if isinstance(ast, tuple):
        if ast and isinstance(ast[0], str):
            yield ast
        for x in ast:
            yield from walk(x)
    elif isinstance(ast, list):
        for x in ast:
            yield from walk(x)
    elif isinstance(ast, dict):
        for x in ast.values():
            yield from walk(x)


def text_of(c: Column, t: T.DataType) -> Column:
    """Rendering of a value as the language prints it."""
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), F.format_string("%.6f", c))
    if is_interval(t):
        unit = lambda n, name: F.when(n == 0, None).when(n == 1, F.concat(n.cast("string"), L(f" {name}"))).otherwise(F.concat(n.cast("string"), L(f" {name}s")))
        years, months = F.floor(c["months"] / 12).cast("int"), (c["months"] % 12).cast("int")
        clock = F.when(c["micros"] != 0, F.date_format(F.timestamp_micros(c["micros"]).cast("timestamp_ntz"), "HH:mm:ss"))
        return F.when(c.isNotNull(), F.coalesce(F.nullif(F.concat_ws(" ", unit(years, "year"), unit(months, "month"), unit(c["days"], "day"), clock), L("")), L("00:00:00")))
    if isinstance(t, T.ArrayType):
        inner = F.transform(c, lambda x: F.coalesce(text_of(x, t.elementType), L("")))
        return F.concat(L("["), F.array_join(inner, ","), L("]"))
    if isinstance(t, T.StructType):
        parts = [F.concat(L(f"{f.name}: "), F.coalesce(text_of(c[f.name], f.dataType), L(""))) for f in t.fields]
        return F.when(c.isNotNull(), F.concat(L("{"), F.concat_ws(", ", *parts), L("}")))
    if isinstance(t, T.MapType):
        inner = F.transform(F.map_entries(c), lambda e: F.concat(text_of(e["key"], t.keyType), L("="), F.coalesce(text_of(e["value"], t.valueType), L(""))))
        return F.concat(L("{"), F.array_join(inner, ", "), L("}"))
    return c.cast("string")
