"""Variable-length, shortest and weighted paths as loops over a frontier.

All sources are searched together: the frontier is a DataFrame of (source,
current node, cost, hops), extended by one join a level. Only keys travel; the
hops of a path are remembered, as keys, only where the query reads them or where
nodes or relationships must not repeat, and the nodes' and relationships' values
are joined in once at the end. Searches that must visit nodes once, and
unbounded ones, write each level to the shared folder, which keeps plans short
and lets a lost executor redo one level only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.binder import Binder, Node, Rel, Scope, Walk, walk
from ..plans.materialize import Buckets, Waves, materialize
from ..plans.parser import QueryError


def extend(m, e: dict) -> None:
    spec, name = e["item"]["walk"], e["name"]
    top = int(m.graph.settings["var_length_extend_max_depth"])
    low, high = spec["low"], spec["high"] if spec["high"] is not None else top
    if high > top:
        raise QueryError(f"Upper bound of rel {name} exceeds maximum: {top}.")
    if low > high:
        raise QueryError(f"Lower bound of rel {name} is greater than upperBound.")
    kind = spec["kind"]
    if "SHORTEST" in kind and low != 1:
        raise QueryError("Lower bound of shortest/all_shortest path must be 1.")
    if kind == "WALK":
        kind = m.graph.settings["recursive_pattern_semantic"].upper()
    asked = set(m.scope.used.get(name, set()))
    for v in m.scope.vars.values():
        if getattr(v, "items", None) and name in v.items:
            asked |= m.scope.used.get(v.name, set())
    left, right = m.nodes[e["left"]], m.nodes[e["right"]]
    s = Search(m, e, kind, low, high, full=bool(asked - {"#length", "#id"}))

    at = lambda v, key, label: (F.col(f"{v.name}___id").cast(s.type) == F.col(key)) & (F.col(f"{v.name}___label") == F.col(label))
    source = m.scope.df.select(F.col(f"{left.name}___id").cast(s.type).alias("s"), F.col(f"{left.name}___label").alias("sl")).distinct().where("s is not null")
    found = s.run(source)
    ends = {"s": f"{name}___s", "sl": f"{name}___sl", "v": f"{name}___v", "vl": f"{name}___vl", "len": f"{name}___len", "nodes": f"{name}___nodes", "rels": f"{name}___rels", "cost": f"{name}___cost"}
    found = found.select(*[F.col(k).alias(x) for k, x in ends.items() if k in found.columns])
    df = m.scope.df.join(found, at(left, ends["s"], ends["sl"]))
    if e["right"] in m.placed:
        m.scope.df = df.where(at(right, ends["v"], ends["vl"]))
    elif m.node_needed(right):
        m.scope.df = df.join(m.node_frame(right), at(right, ends["v"], ends["vl"]))
    else:  # the key is all that is asked of the end node
        kinds = key_types(m, right.labels)
        key = F.col(ends["v"]).cast(kinds.pop() if len(kinds) == 1 else "string")
        m.scope.df = df.where(F.col(ends["vl"]).isin(right.labels)).withColumns({f"{right.name}___id": key, f"{right.name}___label": F.col(ends["vl"])})
    m.scope.vars[name] = Walk(name, s.node_props)
    m.scope.df = m.scope.df.drop(*[x for k, x in ends.items() if k in ("s", "sl", "v", "vl")])
    if e["right"] not in m.placed:
        m.bound(e["right"])


def key_types(m, labels: list[str]) -> set[str]:
    nodes = m.catalog.nodes
    return {nodes[x].df.schema[nodes[x].pk].dataType.simpleString() for x in labels}


def projected(listed: list | None, have: list[str]) -> list[str]:
    """The properties that a recursive projection names, or all without one."""
    if listed is None:
        return have
    names = {x[2].lower() if x[0] == "prop" else x[1].lower() for x in listed}
    return [p for p in have if p.lower() in names]


#: Sources and edges for each part of a weighted search, as far as there are shuffle partitions.
ROWS_A_PART = 6000


class Search:
    """One recursive pattern: its edges as keys, and its search."""

    def __init__(self, m, e: dict, kind: str, low: int, high: int, full: bool):
        self.m, self.e, self.spec, self.kind, self.low, self.high, self.full = m, e, e["item"]["walk"], kind, low, high, full
        self.labels = list(dict.fromkeys(x for r in e["labels"] for pair in m.catalog.rels[r].parts for x in pair))
        ends = [x for n in (e["left"], e["right"]) for x in m.nodes[n].labels]
        kinds = key_types(m, [*self.labels, *ends])
        self.type = kinds.pop() if len(kinds) == 1 else "string"
        self.only = self.labels[0] if len(self.labels) == 1 else None
        self.key = ["s", "v"] if self.only else ["s", "sl", "v", "vl"]
        self.tracked = full or kind in ("TRAIL", "ACYCLIC")
        self.weighted, self.shortest = "WSHORTEST" in kind, "SHORTEST" in kind
        self.node_props: list[str] = []
        self.scopes = list(self.relationships())
        self.edges = self.edge_table()
        self.middle = self.allowed_nodes()

    # ------------------------------------------------------------- edges
    def relationships(self):
        """(part number, scope, relationship variable) of each table, filtered."""
        m, e, spec = self.m, self.e, self.spec
        props = list(dict.fromkeys(p for x in e["labels"] for p in m.catalog.rels[x].props))
        number = 0
        for label in e["labels"]:
            for (s, d), df in m.catalog.rels[label].parts.items():
                r = Rel("r", [label], props)
                flat = df.select(F.col("_src").alias("r___src"), F.lit(s).alias("r___srclabel"), F.col("_dst").alias("r___dst"), F.lit(d).alias("r___dstlabel"), F.lit(label).alias("r___label"), F.col("_rid").alias("r___rid"), *[(F.col(f"`{p}`") if p in df.columns else F.lit(None).cast(m.graph.prop_type(p))).alias(f"r__{p}") for p in props])
                scope = Scope(m.graph, flat, {spec["r"] or "r": r}, m.scope.params, {})
                for c in conditions(spec, rel=True):
                    scope = scope.at(scope.df.where(Binder(scope).expr(c)))
                for k, x in e["item"]["props"]:
                    scope = scope.at(scope.df.where(Binder(scope).expr(("op", "=", ("prop", ("var", spec["r"] or "r"), k), x))))
                yield number, scope, Rel("r", [label], projected(spec["rel_proj"], props))
                number += 1

    def edge_table(self) -> DataFrame:
        """Oriented edges: a, b, their labels where there are several, rid and weight w."""
        frames, way = [], self.e["item"]["dir"]
        for number, scope, _ in self.scopes:
            cols = [F.struct(F.lit(number).alias("p"), F.col("r___rid").alias("n")).alias("rid")] if self.tracked else []
            if self.weighted:
                cols.append(F.col(f"r__{self.spec['weight']}").cast("double").alias("w"))
            for a, b in ([("src", "dst")] if way in ("out", "both") else []) + ([("dst", "src")] if way in ("back", "both") else []):
                named = [] if self.only else [F.col(f"r___{a}label").alias("al"), F.col(f"r___{b}label").alias("bl")]
                frames.append(scope.df.select(F.col(f"r___{a}").cast(self.type).alias("a"), F.col(f"r___{b}").cast(self.type).alias("b"), *named, *cols))
        edges = union(frames)
        if self.weighted:
            edges = edges.withColumn("w", F.when(F.col("w") < 0, F.raise_error(F.lit("Found negative weight."))).otherwise(F.col("w"))).where("w is not null")
        return materialize(edges) if self.spec["high"] is None or self.high > 3 or self.shortest else edges

    def allowed_nodes(self) -> DataFrame | None:
        """Keys of the nodes that may be intermediate, or None for all."""
        tests = conditions(self.spec, rel=False)
        if not tests:
            return None
        v = Node(self.spec["n"], self.labels, [])
        frame = self.node_frame(v)
        scope = Scope(self.m.graph, frame, {self.spec["n"]: v}, self.m.scope.params, {})
        for c in tests:
            scope = scope.at(scope.df.where(Binder(scope).expr(c)))
        return scope.df.select(F.col(f"{v.name}___id").cast(self.type).alias("v"), *([] if self.only else [F.col(f"{v.name}___label").alias("vl")])).distinct()

    def node_frame(self, v: Node) -> DataFrame:
        from .match import Matcher

        self.m.describe(v)
        return Matcher(Scope(self.m.graph, self.m.graph.dummy(), {}, self.m.scope.params, {v.name: {"*"}})).node_frame(v)

    # ------------------------------------------------------------ search
    def run(self, source: DataFrame) -> DataFrame:
        """Rows (s, sl, v, vl, len[, nodes, rels, cost]) of the paths found."""
        if self.only:  # a source of another label has no path along these relationships
            start = source.where(F.col("sl") == self.only).select("s", F.col("s").alias("v"), F.lit(0).alias("len"))
        else:
            start = source.select("s", F.col("s").alias("v"), "sl", F.col("sl").alias("vl"), F.lit(0).alias("len"))
        if self.tracked:
            label = [] if self.only else [F.lit("").alias("bl")]
            hop = F.struct(F.lit(None).cast(self.type).alias("b"), *label, F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("n")).alias("rid"))
            start = start.withColumn("path", F.slice(F.array(hop), 1, 0))
        if self.weighted:
            start = start.withColumn("cost", F.lit(0.0))
        found = self.weighted_paths(start) if self.weighted else self.levels(start)
        if self.full:
            found = self.filled(found)
        if self.only:
            found = found.withColumns({"sl": F.lit(self.only), "vl": F.lit(self.only)})
        return found

    def step(self, front: DataFrame) -> DataFrame:
        """Every path one hop longer."""
        if self.middle is not None:
            on = [c for c in self.key if c in ("v", "vl")]
            past = front.where("len > 0").join(self.middle, on, "left_semi")
            front = front.where("len = 0").unionByName(past)
        if self.kind == "ACYCLIC":  # what is left behind becomes an intermediate node
            same = lambda x: (x["b"] == F.col("v")) if self.only else (x["b"] == F.col("v")) & (x["bl"] == F.col("vl"))
            front = front.where((F.col("len") == 0) | ~F.exists(F.slice("path", F.lit(1), F.greatest(F.col("len") - 1, F.lit(0))), same))
        on = F.col("v") == F.col("a")
        j = front.join(self.edges, on if self.only else on & (F.col("vl") == F.col("al")))
        if self.kind == "TRAIL":
            j = j.where(~F.exists("path", lambda x: x["rid"] == F.col("rid")))
        cols = [F.col("s"), F.col("b").alias("v"), *([] if self.only else [F.col("sl"), F.col("bl").alias("vl")]), (F.col("len") + 1).alias("len")]
        if self.tracked:
            cols.append(F.array_append("path", F.struct("b", *([] if self.only else ["bl"]), "rid")).alias("path"))
        if self.weighted:
            cols.append((F.col("cost") + F.col("w")).alias("cost"))
        return j.select(*cols)

    def cheapest(self, rows: DataFrame) -> DataFrame:
        """One row of each pair of ends: the cheapest, then shortest, then smallest path."""
        rest = [c for c in rows.columns if c not in self.key]
        if not self.tracked:  # of one level, or of levels that never cost the same
            return rows.groupBy(*self.key).agg(F.min_by("len", "cost").alias("len"), F.min("cost").alias("cost")) if self.weighted else rows.dropDuplicates(self.key)
        order = [*[c for c in ("cost",) if c in rest], *[c for c in rest if c != "cost"]]
        return rows.groupBy(*self.key).agg(F.min(F.struct(*order)).alias("x")).select(*self.key, *[F.col(f"x.{c}").alias(c) for c in rest])

    def unseen(self, new: DataFrame, waves: Waves) -> DataFrame:
        """Rows of the next level that improve on all earlier ones."""
        seen = waves.every().select(*self.key, *(["cost"] if self.weighted else []))
        if not self.tracked and not self.kind.startswith("ALL"):
            # One aggregation over old and new rows together: no join, no sort.
            none = F.lit(None).cast("double")
            old = seen.select(*self.key, F.lit(0).alias("f"), F.lit(0).alias("len"), *([F.col("cost").alias("old"), none.alias("cost")] if self.weighted else []))
            new = new.select(*self.key, F.lit(1).alias("f"), "len", *([none.alias("old"), "cost"] if self.weighted else []))
            costs = [F.min("old").alias("old"), F.min("cost").alias("cost")] if self.weighted else []
            both = old.unionByName(new).groupBy(*self.key).agg(F.min("f").alias("f"), F.max("len").alias("len"), *costs)
            return both.where("cost is not null and (old is null or cost < old)" if self.weighted else "f = 1")
        if not self.weighted:
            new = new.join(seen.distinct(), self.key, "left_anti")
            return self.cheapest(new) if self.kind == "SHORTEST" else new
        best = seen.groupBy(*self.key).agg(F.min("cost").alias("old"))
        if self.kind == "WSHORTEST":
            return self.cheapest(new).join(best, self.key, "left").where("old is null or cost < old")
        least = new.groupBy(*self.key).agg(F.min("cost").alias("least"))
        new = new.join(least, self.key).where("cost = least").drop("least")
        return new.join(best, self.key, "left").where("old is null or cost <= old")

    def levels(self, start: DataFrame) -> DataFrame:
        if not (self.shortest or self.spec["high"] is None or self.high > 3):
            out, front = [start] if self.low == 0 else [], start
            for level in range(1, self.high + 1):
                front = self.step(front)
                if level >= self.low:
                    out.append(front)
            return reduce(lambda a, b: a.unionByName(b), out)
        waves = Waves(self.m.graph.spark, start.schema)
        waves.add(start)
        for _ in range(self.high):
            front = self.step(waves.last())
            if not waves.add(self.unseen(front, waves) if self.shortest else front):
                break
        return waves.every(self.low) if self.low < len(waves.paths) else start.limit(0)

    def weighted_paths(self, start: DataFrame) -> DataFrame:
        """Rounds of relaxation. A row is kept where it is cheaper than (ALL: as
        cheap as) every earlier row of its ends; the cheapest of all rounds remain."""
        if self.kind == "WSHORTEST" and not self.tracked:
            return self.least_costs(start)
        waves = Waves(self.m.graph.spark, start.schema)
        waves.add(start)
        for _ in range(self.high):
            if not waves.add(self.unseen(self.step(waves.last()), waves)):
                break
        rows = self.apart(waves.every())
        if self.kind == "WSHORTEST":
            return self.cheapest(rows)
        best = rows.groupBy(*self.key).agg(F.min("cost").alias("old"))
        return rows.join(best, self.key).where("cost = old").drop("old")

    def apart(self, rows: DataFrame) -> DataFrame:
        """Rows whose ends differ."""
        differ = F.col("s") != F.col("v")
        return rows.where(differ if self.only else differ | (F.col("sl") != F.col("vl"))).where("len > 0")

    def least_costs(self, start: DataFrame) -> DataFrame:
        """The relaxation where only cost and length are asked.

        The rows of all rounds stay dealt out by their ends, so a round shuffles
        what it steps from and what it reaches, once each, and no earlier row again.
        """
        spark, start = self.m.graph.spark, materialize(start)
        least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rounds = Buckets(spark, self.key, max(1, min(least, (start.count() + self.edges.count()) // ROWS_A_PART)))
        try:
            rounds.add(rounds.dealt(start))
            last = 0
            for n in range(self.high):
                at = lambda test: F.min(F.when(test, F.col("cost")))
                front = rounds.every().groupBy(*self.key).agg(at(F.col("len") < n).alias("old"), at(F.col("len") == n).alias("cost"))
                front = front.where("cost is not null and (old is null or cost < old)").drop("old").withColumn("len", F.lit(n))
                new = rounds.dealt(self.step(front).drop("len")).groupBy(*self.key).agg(F.min("cost").alias("cost"))
                if not rounds.add(new.select(*self.key, F.lit(n + 1).alias("len"), "cost")):
                    break
                last = n + 1
            rows = self.apart(rounds.every())
        finally:
            rounds.forget()
        # The cheapest, then the shortest: the first round that has the least cost.
        costs = [f"_c{n}" for n in range(last + 1)]
        rows = rows.groupBy(*self.key).agg(*[F.min(F.when(F.col("len") == n, F.col("cost"))).alias(c) for n, c in enumerate(costs)])
        rows = rows.withColumn("cost", F.least(*costs, F.lit(None).cast("double")))
        return rows.select(*self.key, F.coalesce(*[F.when(F.col(c) == F.col("cost"), F.lit(n)) for n, c in enumerate(costs)]).alias("len"), "cost")

    # ------------------------------------------------------------ values
    def filled(self, found: DataFrame) -> DataFrame:
        """The paths with nodes (intermediate ones) and rels as arrays of their values."""
        m, spec = self.m, self.spec
        v = Node("n", self.labels, [])
        frame = self.node_frame(v)
        self.node_props = projected(spec["node_proj"], v.props)
        struct = Binder(Scope(m.graph, frame, {"n": v}, {}, {})).node_struct(Node("n", self.labels, self.node_props, v.pk))
        nodes = frame.select(F.col("n___id").cast(self.type).alias("b"), *([] if self.only else [F.col("n___label").alias("bl")]), struct.alias("node"))
        rels = union([scope.df.select(F.struct(F.lit(number).alias("p"), F.col("r___rid").alias("n")).alias("rid"), Binder(scope).rel_struct(r).alias("rel")) for number, scope, r in self.scopes]).dropDuplicates(["rid"])

        found = materialize(found.withColumn("pid", F.monotonically_increasing_id()))
        hops = found.select("pid", F.posexplode("path").alias("i", "hop")).select("pid", "i", "hop.*")
        hops = hops.join(rels, "rid").join(nodes, ["b"] if self.only else ["b", "bl"])
        lists = hops.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("i", "rel", "node")), by_place).alias("l"))
        lists = lists.select("pid", F.transform("l", lambda x: x["rel"]).alias("rels"), F.transform(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["node"]).alias("nodes"))
        kinds = {f.name: f.dataType for f in lists.schema.fields}
        out = found.join(lists, "pid", "left").drop("pid", "path")
        out = out.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("rels", "nodes")})
        if self.e.get("flipped"):
            out = out.withColumns({c: F.reverse(c) for c in ("rels", "nodes")})
        return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def by_place(a: Column, b: Column) -> Column:
    return (a["i"] - b["i"]).cast("int")


def conditions(spec: dict, rel: bool) -> list:
    """The conjuncts of a recursive filter on relationships, or those on nodes."""
    from .match import conjuncts

    out = []
    for c in conjuncts(spec["where"]):
        names = {x[1] for x in walk(c) if x[0] == "var"}
        if spec["r"] in names and spec["n"] in names:
            raise QueryError("A recursive filter cannot combine node and relationship in one predicate.")
        if (spec["r"] in names) == rel and (rel or spec["n"] in names):
            out.append(c)
    return out
