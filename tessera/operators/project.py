"""Projection, implicit grouping, ordering, UNWIND and UNION."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.binder import AGGREGATES, Binder, Node, Path, Rel, Scope, Value, Walk, replace, walk
from ..plans.materialize import materialize
from ..plans.parser import QueryError
from .match import where, with_subqueries


def aggregates_in(ast) -> list:
    return [x for x in walk(ast) if x[0] == "call" and x[1] in AGGREGATES]


def columns_of(v, df: DataFrame) -> list[str]:
    if isinstance(v, Value):
        return [v.column]
    return [c for c in df.columns if c.startswith(f"{v.name}__")]


def rename(v, old: str, new: str):
    """The variable under another name."""
    if isinstance(v, Node):
        return Node(new, v.labels, v.props, v.pk)
    if isinstance(v, Rel):
        out = Rel(new, v.labels, v.props)
        out.src, out.dst = getattr(v, "src", None), getattr(v, "dst", None)
        return out
    return Walk(new, v.props)


def literal(scope: Scope, ast, what: str) -> int:
    v = ast[1] if ast[0] == "lit" else scope.params.get(ast[1]) if ast[0] == "param" else None
    if not isinstance(v, int) or v < 0:
        raise QueryError(f"The number of rows to {what} must be a non-negative integer.")
    return v


def number_rows(scope: Scope, ast) -> tuple[Scope, tuple]:
    """Each nextval call of an expression as a column with a value for every row."""
    from .dml import row_numbers

    for call in [x for x in walk(ast) if x[0] == "call" and x[1] == "NEXTVAL" and x[2] and x[2][0][0] == "lit"]:
        seq, temp = scope.graph.catalog.sequence(call[2][0][1]), f"_seq{len(scope.df.columns)}"
        df = materialize(row_numbers(scope.df, temp, -1))
        n = df.count()
        first, left, again, size = seq.spread(n)
        big = lambda x: F.lit(x).cast("decimal(38,0)")
        i = F.col(temp).cast("decimal(38,0)")
        value = i * seq.by + big(first)
        if left < n:
            value = F.when(i < big(left), value).otherwise((i - big(left)) % big(size) * seq.by + big(again))
        value = value.cast("long")
        scope = scope.at(df.withColumn(temp, value))
        ast = replace(ast, lambda x, call=call, temp=temp: ("col", temp) if x is call else None)
    return scope, ast


def project(scope: Scope, clause: dict) -> Scope:
    """WITH and RETURN. Variables stay variables when projected by themselves."""
    items = list(clause["items"])
    if clause["star"]:
        items = [(("var", n), n) for n in scope.vars if not n.startswith("_")] + items
    expanded = []
    for ast, name in items:
        if ast[0] == "allprops":
            v = scope.vars[ast[1][1]]
            expanded += [(("prop", ast[1], p), f"{ast[1][1]}.{p}") for p in v.props]
        else:
            expanded.append((ast, name))
    items = expanded
    for i, (ast, name) in enumerate(items):
        for a in aggregates_in(ast):
            if any(aggregates_in(x) for x in a[2]):
                raise QueryError("Nested aggregation is not supported.")
        wide, new = with_subqueries(scope, ast)
        wide, new = number_rows(wide, new)
        if new is not ast:
            scope, items[i] = wide, (new, name)

    grouped = any(aggregates_in(ast) for ast, _ in items)
    order = list(clause["order"])
    for i, (ast, down) in enumerate(order):
        for item, name in items:  # an ordering expression that is projected is its alias
            if ast == item:
                order[i] = (("var", name), down)
    df, out_vars, outputs = scope.df, {}, []

    if grouped:
        df, scope, items = group(scope, items)
    binder = Binder(scope)
    flat: list = []
    for ast, name in items:
        v = scope.vars.get(ast[1]) if ast[0] == "var" else None
        if v is None and ast[0] == "var":
            v = binder.var(ast[1])
        if v is not None and not isinstance(v, Value):
            if isinstance(v, Path):
                members = {i: scope.vars[i] for i in v.items}
                for i, x in members.items():
                    flat += [F.col(f"`{c}`") for c in columns_of(x, scope.df)]
                    out_vars.setdefault(i, x)
                out_vars[name] = Path(name, v.items)
            else:
                flat += [F.col(f"`{c}`").alias(name + c[len(v.name) :]) for c in columns_of(v, scope.df)]
                out_vars[name] = rename(v, v.name, name)
        else:
            flat.append(binder.expr(ast).alias(name))
            out_vars[name] = Value(name)
        outputs.append(name)
    if len(set(outputs)) < len(outputs):
        raise QueryError("Multiple result columns with the same name are not supported.")

    hidden: list[str] = []
    if order and not grouped and not clause["distinct"]:
        # Ordering may read variables that are not projected.
        pre, keys = [], []
        mixed = Scope(scope.graph, scope.df, {**scope.vars}, scope.params, scope.used)
        for i, (ast, down) in enumerate(order):
            if ast[0] == "var" and ast[1] in out_vars and isinstance(out_vars[ast[1]], Value):
                source = next(a for a, n in items if n == ast[1])
            else:
                source = replace(ast, lambda x: next((a for a, n in items if n == x[1] and isinstance(out_vars.get(n), Value) and x[1] not in scope.vars), None) if x[0] == "var" else None)
            pre.append(Binder(mixed).expr(source).alias(f"_order{i}"))
            keys.append((f"_order{i}", down))
            hidden.append(f"_order{i}")
        df = scope.df.select(*flat, *pre)
    else:
        df = scope.df.select(*flat) if flat else scope.df
        keys = []
        if clause["distinct"]:
            df = df.distinct()
        if order:
            after = Scope(scope.graph, df, out_vars, scope.params, scope.used)
            for i, (ast, down) in enumerate(order):
                df = df.withColumn(f"_order{i}", Binder(after).expr(ast))
                keys.append((f"_order{i}", down))
                hidden.append(f"_order{i}")
    if keys:
        df = df.orderBy(*[F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_last() for k, down in keys])
    if clause["skip"]:
        df = df.offset(literal(scope, clause["skip"], "skip"))
    if clause["limit"]:
        df = df.limit(literal(scope, clause["limit"], "limit"))
    if hidden:
        df = df.drop(*hidden)
    out = Scope(scope.graph, df, out_vars, scope.params, scope.used)
    if clause["where"]:
        out = where(out, clause["where"])
    if clause["do"] == "return":
        final = Binder(out)
        out.df = out.df.select(*[final.expr(("var", n)).alias(n) for n in outputs])
        out.vars = {n: Value(n) for n in outputs}
    return out


def group(scope: Scope, items: list) -> tuple[DataFrame, Scope, list]:
    """Implicit grouping: items without aggregates are the keys."""
    binder = Binder(scope)
    keys, kept_vars, aggs, rest = [], {}, [], []
    for ast, name in items:
        found = aggregates_in(ast)
        if not found:
            v = binder.var(ast[1]) if ast[0] == "var" else None
            if v is not None and not isinstance(v, Value):
                cols = [c for i in getattr(v, "items", [None]) for c in columns_of(scope.vars[i] if i else v, scope.df)]
                keys += [F.col(f"`{c}`") for c in cols]
                kept_vars[ast[1]] = v
                for i in getattr(v, "items", []):
                    kept_vars[i] = scope.vars[i]
                rest.append((ast, name))
            else:
                keys.append(binder.expr(ast).alias(f"_key_{name}"))
                kept_vars[f"_key_{name}"] = Value(f"_key_{name}")
                rest.append((("var", f"_key_{name}"), name))
        else:
            new = ast
            for a in found:
                temp = f"_agg{len(aggs)}"
                aggs.append(binder.aggregate(a).alias(temp))
                new = replace(new, lambda x, a=a, temp=temp: ("col", temp) if x is a else None)
            rest.append((new, name))
    # Keys may also be used inside expressions over aggregates.
    for ast, name in items:
        if not aggregates_in(ast):
            rest = [(replace(x, lambda y, ast=ast, name=name: ("col", f"_key_{name}") if y == ast and f"_key_{name}" in kept_vars else None) if any(y[0] == "col" for y in walk(x)) else x, n) for x, n in rest]
    df = scope.df.groupBy(*keys).agg(*aggs)
    return df, Scope(scope.graph, df, kept_vars, scope.params, scope.used), rest


def unwind(scope: Scope, clause: dict) -> Scope:
    scope, ast = with_subqueries(scope, clause["list"])
    c = Binder(scope).expr(ast)
    if ast == ("list", []) or ast == ("lit", None):
        c = F.array().cast("array<bigint>")
    df = scope.df.select("*", F.explode(c).alias(clause["as"]))
    return Scope(scope.graph, df, {**scope.vars, clause["as"]: Value(clause["as"])}, scope.params, scope.used)


def union(parts: list[DataFrame], every: list[bool]) -> DataFrame:
    out = parts[0]
    for df, keep in zip(parts[1:], every, strict=True):
        if len(df.columns) != len(out.columns):
            raise QueryError("The number of columns to union/union all must be the same.")
        out = out.union(df)
        if not keep:
            out = out.distinct()
    return out
