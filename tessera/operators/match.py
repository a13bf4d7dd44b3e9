"""Pattern matching: pattern graphs to joins.

The join order is left-deep and connected: it starts at what is bound already,
or at a node with a property filter, and always extends along an edge. A node
table is joined only where one of its properties besides the key is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.binder import Binder, Node, Path, Rel, Scope, Value, Walk, walk
from ..plans.parser import QueryError
from . import paths


def conjuncts(ast) -> list:
    if ast is None:
        return []
    if ast[0] == "op" and ast[1] == "AND":
        return conjuncts(ast[2]) + conjuncts(ast[3])
    return [ast]


def usage(clauses) -> dict[str, set]:
    """Properties asked of each variable; "*" where the variable itself is a value."""
    used: dict[str, set] = {}
    bare_ok = {"ID", "LABEL", "LABELS", "COUNT", "ROWID", "LENGTH", "COST"}

    def visit(x):
        if isinstance(x, dict):
            if x.get("node") is not None and x.get("var"):
                used.setdefault(x["var"], set()).update(k for k, _ in x["props"])
            for v in x.values():
                visit(v)
        elif isinstance(x, tuple) and x and isinstance(x[0], str):
            if x[0] == "prop" and x[1][0] == "var":
                used.setdefault(x[1][1], set()).add(x[2])
            elif x[0] == "call" and x[1] in bare_ok and x[2] and x[2][0][0] == "var":
                used.setdefault(x[2][0][1], set()).add("#length" if x[1] in ("LENGTH", "COST") else "#id")
            elif x[0] == "op" and x[1] in ("=", "<>") and x[2][0] == x[3][0] == "var":
                for side in (x[2], x[3]):
                    used.setdefault(side[1], set()).add("#id")
            elif x[0] == "var":
                used.setdefault(x[1], set()).add("*")
            else:
                for y in x:
                    visit(y)
        elif isinstance(x, (list, tuple)):
            for y in x:
                visit(y)

    visit(clauses)
    return used


class Matcher:
    def __init__(self, scope: Scope):
        self.graph, self.catalog = scope.graph, scope.graph.catalog
        self.scope = Scope(scope.graph, scope.df, dict(scope.vars), scope.params, scope.used)
        self.fresh = bool(scope.vars)  # whether there are rows to extend
        self.nodes: dict[str, Node] = {k: v for k, v in scope.vars.items() if isinstance(v, Node)}
        self.placed = set(self.nodes)
        self.edges: list[dict] = []
        self.filters: dict[str, list] = {}
        self.count = 0

    # --------------------------------------------------------- collecting
    def add(self, path: dict) -> None:
        names = []
        for item in path["items"]:
            if item["node"]:
                names.append(self.add_node(item))
        ends = iter(zip(names, names[1:], strict=False))
        members, n = [names[0]], iter(names[1:])
        for item in path["items"]:
            if item["node"]:
                continue
            left, right = next(ends)
            name = item["var"] or self.anonymous("e")
            if item["var"] and (item["var"] in self.scope.vars or any(e["name"] == name for e in self.edges)):
                raise QueryError(f"Bind relationship {name} to relationship with same name is not supported.")
            labels = [self.catalog.rel(x).name for x in item["labels"]] or list(self.catalog.rels)
            self.edges.append({"name": name, "left": left, "right": right, "item": item, "labels": labels})
            members += [name, next(n)]
        if path["name"]:
            self.scope.vars[path["name"]] = Path(path["name"], members)

    def anonymous(self, kind: str) -> str:
        self.count += 1
        return f"_{kind}{len(self.scope.vars)}_{self.count}"

    def add_node(self, item: dict) -> str:
        name = item["var"] or self.anonymous("n")
        labels = [self.catalog.node(x).name for x in item["labels"]]
        if name in self.nodes:
            known = self.nodes[name]
            if labels:
                if name in self.placed:
                    self.filters.setdefault(name, []).append(("label", labels))
                else:
                    known.labels = [x for x in known.labels if x in labels]
        elif name in self.scope.vars:
            raise QueryError(f"Cannot bind {name} as node pattern.")
        else:
            self.nodes[name] = Node(name, labels or list(self.catalog.nodes), [])
        for k, e in item["props"]:
            self.filters.setdefault(name, []).append(("op", "=", ("prop", ("var", name), k), e))
        return name

    def infer(self) -> None:
        """Labels of unlabelled nodes from the endpoints of their relationships."""
        for _ in range(len(self.edges) + 1):
            for e in self.edges:
                if e["item"]["walk"]:
                    continue
                a, b = self.nodes[e["left"]], self.nodes[e["right"]]
                pairs = []
                for name in e["labels"]:
                    for s, d in self.catalog.rels[name].parts:
                        for x, y in {"out": [(s, d)], "back": [(d, s)], "both": [(s, d), (d, s)]}[e["item"]["dir"]]:
                            if x in a.labels and y in b.labels:
                                pairs.append((x, y))
                if e["left"] not in self.placed:
                    a.labels = [x for x in a.labels if any(p[0] == x for p in pairs)]
                if e["right"] not in self.placed:
                    b.labels = [x for x in b.labels if any(p[1] == x for p in pairs)]

    # ------------------------------------------------------------- tables
    def wanted(self, name: str, have: list[str]) -> list[str]:
        asked = self.scope.used.get(name, set())
        if "*" in asked or any(isinstance(v, Path) and name in v.items and self.scope.used.get(v.name, set()) - {"#length"} for v in self.scope.vars.values()):
            return have
        low = {x.lower() for x in asked}
        return [p for p in have if p.lower() in low]

    def node_frame(self, v: Node) -> DataFrame:
        """v__id, v__label and the wanted properties of every row of v's labels."""
        frames, kinds = [], {self.catalog.nodes[x].df.schema[self.catalog.nodes[x].pk].dataType.simpleString() for x in v.labels}
        every = list(dict.fromkeys(p for x in v.labels for p in self.catalog.nodes[x].props))
        v.props = every
        props = self.wanted(v.name, every)
        for label in v.labels:
            t = self.catalog.nodes[label]
            key = F.col(f"`{t.pk}`")
            cols = [(key if len(kinds) == 1 else key.cast("string")).alias(f"{v.name}___id"), F.lit(label).alias(f"{v.name}___label")]
            frames.append(t.df.select(*cols, *[F.col(f"`{p}`").alias(f"{v.name}__{p}") for p in props if p in t.props]))
        if not frames:
            raise QueryError(f"No node table satisfies the pattern of {v.name}.")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def node_needed(self, v: Node) -> bool:
        self.describe(v)
        return any(p != v.pk for p in self.wanted(v.name, v.props))

    def describe(self, v: Node) -> None:
        v.props = list(dict.fromkeys(p for x in v.labels for p in self.catalog.nodes[x].props))
        keys = {self.catalog.nodes[x].pk for x in v.labels}
        v.pk = keys.pop() if len(keys) == 1 and len({self.catalog.nodes[x].df.schema[self.catalog.nodes[x].pk].dataType.simpleString() for x in v.labels}) == 1 else None

    def edge_frame(self, e: dict, a: Node, b: Node) -> DataFrame:
        """Oriented edges: e___l, e___r (keys), their labels and the relationship's columns."""
        name, frames = e["name"], []
        props = list(dict.fromkeys(p for x in e["labels"] for p in self.catalog.rels[x].props))
        want = self.wanted(name, props)
        full = "*" in self.scope.used.get(name, set()) or bool(self.scope.used.get(name)) or any(isinstance(v, Path) and name in v.items for v in self.scope.vars.values())
        text = lambda v: len({self.catalog.nodes[x].df.schema[self.catalog.nodes[x].pk].dataType.simpleString() for x in v.labels}) > 1
        for label in e["labels"]:
            t = self.catalog.rels[label]
            for (s, d), df in t.parts.items():
                for way in {"out": ("f",), "back": ("b",), "both": ("f", "b")}[e["item"]["dir"]]:
                    ll, rl = (s, d) if way == "f" else (d, s)
                    if ll not in a.labels or rl not in b.labels:
                        continue
                    left, right = ("_src", "_dst") if way == "f" else ("_dst", "_src")
                    cols = [F.col(left).cast("string" if text(a) else df.schema[left].dataType).alias(f"{name}___l"), F.lit(ll).alias(f"{name}___ll"), F.col(right).cast("string" if text(b) else df.schema[right].dataType).alias(f"{name}___r"), F.lit(rl).alias(f"{name}___rl")]
                    if full:
                        cols += [F.col("_src").alias(f"{name}___src"), F.lit(s).alias(f"{name}___srclabel"), F.col("_dst").alias(f"{name}___dst"), F.lit(d).alias(f"{name}___dstlabel"), F.lit(label).alias(f"{name}___label"), F.col("_rid").alias(f"{name}___rid")]
                    cols += [F.col(f"`{p}`").alias(f"{name}__{p}") for p in want if p in t.props]
                    frames.append(df.select(*cols))
        e["props"] = props
        if not frames:
            raise QueryError(f"No relationship table satisfies the pattern of {name}.")
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)

    # ------------------------------------------------------------- joining
    def cross(self, df: DataFrame) -> None:
        self.scope.df = self.scope.df.crossJoin(df) if self.fresh else df
        self.fresh = True

    def apply_filters(self, name: str) -> None:
        for f in self.filters.pop(name, []):
            if f[0] == "label":
                self.scope.df = self.scope.df.where(F.col(f"{name}___label").isin(f[1]))
            else:
                self.scope.df = self.scope.df.where(Binder(self.scope).expr(f))

    def place(self, name: str) -> None:
        v = self.nodes[name]
        self.describe(v)
        self.cross(self.node_frame(v))
        self.bound(name)

    def bound(self, name: str) -> None:
        self.placed.add(name)
        self.scope.vars[name] = self.nodes[name]
        self.apply_filters(name)

    def same(self, v: Node, key: str, label: str) -> Column:
        on = F.col(f"{v.name}___id") == F.col(key)
        return on & (F.col(f"{v.name}___label") == F.col(label)) if len(v.labels) > 1 else on

    def extend(self, e: dict) -> None:
        forward = e["left"] in self.placed
        if not forward and e["right"] not in self.placed:
            v = self.nodes[e["left"]]
            if e["item"]["walk"] or self.node_needed(v) or self.filters.get(e["left"]):
                self.place(e["left"])
                forward = True
        if e["item"]["walk"]:
            if not forward:
                flip = {"out": "back", "back": "out", "both": "both"}
                e = {**e, "left": e["right"], "right": e["left"], "item": {**e["item"], "dir": flip[e["item"]["dir"]]}, "flipped": True}
            paths.extend(self, e)
            return
        a, b = self.nodes[e["left"]], self.nodes[e["right"]]
        edges = self.edge_frame(e, a, b)
        name = e["name"]
        if e["left"] not in self.placed and e["right"] not in self.placed:
            self.cross(edges)
            self.from_edge(e["left"], f"{name}___l", f"{name}___ll")
            self.from_edge(e["right"], f"{name}___r", f"{name}___rl")
        else:
            on = None
            for end, key, label in ((e["left"], f"{name}___l", f"{name}___ll"), (e["right"], f"{name}___r", f"{name}___rl")):
                if end in self.placed:
                    c = self.same(self.nodes[end], key, label)
                    on = c if on is None else on & c
            self.scope.df = self.scope.df.join(edges, on)
            for end, key, label in ((e["left"], f"{name}___l", f"{name}___ll"), (e["right"], f"{name}___r", f"{name}___rl")):
                if end not in self.placed:
                    self.from_edge(end, key, label)
        self.scope.df = self.scope.df.drop(f"{name}___l", f"{name}___ll", f"{name}___r", f"{name}___rl")
        rel = Rel(name, e["labels"], e["props"])
        rel.src, rel.dst = (e["left"], e["right"]) if e["item"]["dir"] == "out" else (e["right"], e["left"]) if e["item"]["dir"] == "back" else (None, None)
        self.scope.vars[name] = rel
        for k, x in e["item"]["props"]:
            self.scope.df = self.scope.df.where(Binder(self.scope).expr(("op", "=", ("prop", ("var", name), k), x)))

    def from_edge(self, end: str, key: str, label: str) -> None:
        """Bind a node by the edge's key, joining its table only where needed."""
        if end in self.placed:  # the pattern's other end is the same variable
            self.scope.df = self.scope.df.where(self.same(self.nodes[end], key, label))
            return
        v = self.nodes[end]
        if self.node_needed(v):
            frame = self.node_frame(v)
            on = frame[f"{end}___id"] == self.scope.df[key]
            if len(v.labels) > 1:
                on = on & (frame[f"{end}___label"] == self.scope.df[label])
            self.scope.df = self.scope.df.join(frame, on)
        else:
            self.scope.df = self.scope.df.withColumns({f"{end}___id": F.col(key), f"{end}___label": F.col(label)})
        self.bound(end)

    def run(self, hint: list[str] = ()) -> Scope:
        """Join everything; relationships and nodes named in ``hint`` in its order."""
        self.infer()
        unknown = [n for n in hint if n not in self.nodes and not any(e["name"] == n for e in self.edges)]
        if unknown:
            raise QueryError(f"Cannot bind {unknown[0]} of the join hint: it is no variable of the pattern.")
        rank = {n: i for i, n in enumerate(hint)}
        last = len(rank)
        self.edges.sort(key=lambda e: max(rank.get(e["name"], last), min(rank.get(e["left"], last), rank.get(e["right"], last))))
        if hint and hint[0] in self.nodes and hint[0] not in self.placed:
            self.place(hint[0])
        for name in list(self.placed):
            if name in self.filters:
                self.apply_filters(name)
        pending = list(self.edges)
        while pending or any(n not in self.placed for n in self.nodes):
            ready = [e for e in pending if e["left"] in self.placed or e["right"] in self.placed]
            if not ready and pending:
                # Start where a property is fixed, else at the first plain edge.
                fixed = [e for e in pending if self.filters.get(e["left"]) or self.filters.get(e["right"])]
                e = (fixed or [e for e in pending if not e["item"]["walk"]] or pending)[0]
                if self.filters.get(e["right"]) and not self.filters.get(e["left"]):
                    self.place(e["right"])
                elif self.filters.get(e["left"]) or e["item"]["walk"]:
                    self.place(e["left"])
                ready = [e]
            if ready:
                # Close cycles first: an edge between two bound nodes only removes rows.
                closing = [x for x in ready if x["left"] in self.placed and x["right"] in self.placed]
                e = ready[0] if hint else (closing or ready)[0]
                pending.remove(e)
                self.extend(e)
            else:
                self.place(next(n for n in self.nodes if n not in self.placed))
        return self.scope


def match_paths(scope: Scope, patterns: list[dict], hint: list[str] = ()) -> Scope:
    m = Matcher(scope)
    for p in patterns:
        m.add(p)
    return m.run(hint)


# ------------------------------------------------------- correlated patterns


def correlated(scope: Scope, ast) -> list[str]:
    """Columns of the outer rows that a subquery's patterns and conditions read."""
    names, cols = set(), []

    def visit(x):
        if isinstance(x, dict):
            if x.get("var"):
                names.add(x["var"])
            for v in x.values():
                visit(v)
        elif isinstance(x, tuple) and x and x[0] == "var":
            names.add(x[1])
        elif isinstance(x, (list, tuple)):
            for y in x:
                visit(y)

    visit(ast)
    used = usage(ast)
    for n in sorted(names & set(scope.vars)):
        v = scope.vars[n]
        if isinstance(v, Value):
            cols.append(v.column)
        elif isinstance(v, Node):
            want = {x.lower() for x in used.get(n, ())}
            cols += [c for c in (f"{n}___id", f"{n}___label", *[f"{n}__{p}" for p in v.props if p.lower() in want or "*" in want]) if c in scope.df.columns]
        else:
            cols += [c for c in scope.df.columns if c.startswith(f"{n}__")]
    return list(dict.fromkeys(cols))


def subquery(scope: Scope, body: dict) -> tuple[list[str], Scope]:
    """Distinct outer keys and the pattern matched from them."""
    keys = correlated(scope, body)
    outer = scope.df.select(*[F.col(f"`{c}`") for c in keys]).distinct() if keys else scope.df
    seen = {n: v for n, v in scope.vars.items() if (v.column in keys if isinstance(v, Value) else any(k.startswith(f"{n}__") for k in keys))}
    used = {k: set(v) for k, v in scope.used.items()}
    for k, v in usage(body).items():
        used.setdefault(k, set()).update(v)
    inner = Scope(scope.graph, outer if keys else scope.graph.dummy(), seen, scope.params, used)
    for m in body["matches"]:
        inner = match_paths(inner, m["paths"])
        inner = where(inner, m["where"])
    return keys, inner


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null; the keys come from the left."""
    named = right.select(*[F.col(f"`{k}`").alias(f"_k{i}") if k in keys else F.col(f"`{k}`") for i, k in enumerate(right.columns)])
    place = {k: f"_k{i}" for i, k in enumerate(right.columns) if k in keys}
    on = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(named[place[k]]) for k in keys]) if keys else F.lit(True)
    out = left.join(named, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*place.values())


def with_subqueries(scope: Scope, ast):
    """Attach EXISTS and COUNT subqueries in ``ast`` as columns of the rows."""
    from ..plans.binder import replace

    for sub in [x for x in walk(ast) if x[0] in ("exists", "count") and len(x) == 2 and isinstance(x[1], dict)]:
        keys, inner = subquery(scope, sub[1])
        name = f"_sub{len(scope.df.columns)}"
        if keys:
            counts = inner.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias(name))
        else:
            counts = inner.df.agg(F.count(F.lit(1)).alias(name))
        df = join_keys(scope.df, counts, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
        scope = scope.at(df)
        new = ("col", name) if sub[0] == "count" else ("op", ">", ("col", name), ("lit", 0))
        ast = replace(ast, lambda x, sub=sub, new=new: new if x is sub else None)
    return scope, ast


def where(scope: Scope, condition) -> Scope:
    """Filter rows; EXISTS conditions that stand alone become semi and anti joins."""
    for c in conjuncts(condition):
        negated = c[0] == "not"
        core = c[1] if negated else c
        if core[0] == "exists":
            keys, inner = subquery(scope, core[1])
            if keys:
                found = inner.df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
                scope = scope.at(join_keys(scope.df, found, keys, "left_anti" if negated else "left_semi"))
                continue
        columns = scope.df.columns
        wide, c = with_subqueries(scope, c)
        scope = scope.at(wide.df.where(Binder(wide).expr(c)).select(*[F.col(f"`{x}`") for x in columns]))
    return scope


def match_clause(scope: Scope, clause: dict) -> Scope:
    if not clause["optional"]:
        return where(match_paths(scope, clause["paths"], clause["hint"]), clause["where"])
    if not scope.vars:  # nothing is bound: a single row of nulls where nothing matches
        inner = where(match_paths(scope, clause["paths"]), clause["where"])
        one = scope.graph.dummy().select()
        return inner.at(one.join(inner.df, F.lit(True), "left"))
    keys, inner = subquery(scope, {"matches": [clause]})
    fresh = [c for c in inner.df.columns if c not in scope.df.columns or c not in keys]
    right = inner.df.select(*[F.col(f"`{c}`") for c in [*keys, *[c for c in fresh if c not in keys]]])
    out = scope.at(join_keys(scope.df, right, keys, "left"))
    out.vars = {**inner.vars, **scope.vars}
    return out


__all__ = ["Matcher", "Walk", "conjuncts", "match_clause", "match_paths", "usage", "where", "with_subqueries"]
