"""Counts of chains of relationships, and of pairs, without listing the matches.

`MATCH (:A)-[:R]->(:B)-[:S]->(:C) RETURN count(*)` needs, for each node in the
middle, only how many ways lead there: every hop joins these numbers with the
relationships and sums them up by the node reached, so the work grows with the
relationships, not with the matches. The last hop multiplies by degrees.

`MATCH (a:A), (b:B) WHERE a.k = b.k AND a.x > b.y RETURN a.k, count(*)` needs, for
each value of x, only how many rows of b with the same k lie below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.binder import Binder, Scope, walk
from ..plans.materialize import materialize
from .match import Matcher, conjuncts, match_paths, where


def chain_of(clauses: list[dict]) -> dict | None:
    """The path of a text that only counts the matches of one chain, else None."""
    if len(clauses) != 2 or clauses[0]["do"] != "match" or clauses[1]["do"] != "return":
        return None
    m, r = clauses
    plain = not (m["optional"] or m["where"] or m["hint"] or r["star"] or r["distinct"] or r["order"] or r["skip"] or r["limit"]) and len(m["paths"]) == 1
    if not plain or len(r["items"]) != 1 or r["items"][0][0][:2] != ("call", "COUNT_STAR"):
        return None
    path = m["paths"][0]
    names = [x["var"] for x in path["items"] if x["var"]]
    simple = not path["name"] and len(set(names)) == len(names) and not any(x["props"] or x.get("walk") for x in path["items"])
    return path if simple and len(path["items"]) >= 5 else None


def chain_count(graph, path: dict, name: str, params: dict) -> DataFrame:
    m = Matcher(Scope(graph, graph.dummy(), {}, params, {}))
    m.add(path)
    m.infer()
    at = None
    for i, e in enumerate(m.edges):
        frame = m.edge_frame(e, m.nodes[e["left"]], m.nodes[e["right"]])
        left, right = [F.col(f"{e['name']}___{c}") for c in ("l", "ll")], [F.col(f"{e['name']}___{c}") for c in ("r", "rl")]
        if i == len(m.edges) - 1:
            degree = frame.groupBy(left[0].alias("k"), left[1].alias("kl")).agg(F.count(F.lit(1)).alias("d"))
            return at.join(degree, ["k", "kl"]).agg(F.coalesce(F.sum(F.col("n") * F.col("d")), F.lit(0)).cast("long").alias(name))
        if at is None:
            at = frame.groupBy(right[0].alias("k"), right[1].alias("kl")).agg(F.count(F.lit(1)).alias("n"))
        else:
            held = frame.select(left[0].alias("k"), left[1].alias("kl"), right[0].alias("to"), right[1].alias("tol"))
            at = at.join(held, ["k", "kl"]).groupBy(F.col("to").alias("k"), F.col("tol").alias("kl")).agg(F.sum("n").alias("n"))
    raise AssertionError("a chain has two relationships at least")


#: Parts of conditions that give the same on a row alone and on each of its pairs.
PLAIN = {"op", "prop", "var", "lit", "param", "not", "isnull", "neg"}
FLIPPED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
ATOMS = (T.NumericType, T.StringType, T.DateType, T.TimestampNTZType, T.TimestampType, T.BooleanType)


def pairs_of(clauses: list[dict]) -> dict | None:
    """The two sides of a text that only counts pairs of rows which equalities and
    at most one inequality link, by the equal values; else None.

    Gives the sides' conditions, ``equal`` (pairs of properties), ``range``
    (an operator and two properties, the left side's first) and the items.
    """
    if len(clauses) != 2 or clauses[0]["do"] != "match" or clauses[1]["do"] != "return":
        return None
    m, r = clauses
    plain = not (m["optional"] or m["hint"] or r["star"] or r["distinct"] or r["order"] or r["skip"] or r["limit"] or r["where"]) and len(m["paths"]) == 2
    if not plain or any(p["name"] or any(x.get("walk") for x in p["items"]) for p in m["paths"]):
        return None
    names = [{x["var"] for x in p["items"] if x["var"]} for p in m["paths"]]
    if names[0] & names[1] or any(walk_of(e) - PLAIN for p in m["paths"] for x in p["items"] for _, e in x["props"]):
        return None
    out = {"sides": ([], []), "equal": [], "range": None, "paths": m["paths"], "items": r["items"]}
    for c in conjuncts(m["where"]):
        if walk_of(c) - PLAIN:
            return None
        asked = {x[1] for x in walk(c) if x[0] == "var"}
        if not asked & names[1]:
            out["sides"][0].append(c)
        elif not asked & names[0]:
            out["sides"][1].append(c)
        elif c[0] == "op" and c[1] in FLIPPED and all(x[0] == "prop" and x[1][0] == "var" for x in c[2:4]):
            op, x, y = c[1:4] if c[2][1][1] in names[0] else (FLIPPED[c[1]], c[3], c[2])
            if op == "=":
                out["equal"].append((x, y))
            elif out["range"] is None:
                out["range"] = (op, x, y)
            else:
                return None
        else:
            return None
    known = [x for pair in out["equal"] for x in pair]
    counted = [ast[:2] == ("call", "COUNT_STAR") for ast, _ in r["items"]]
    fits = any(counted) and all(n or ast in known for n, (ast, _) in zip(counted, r["items"], strict=True))
    return out if fits and len({n for _, n in r["items"]}) == len(r["items"]) else None


def walk_of(ast) -> set[str]:
    return {x[0] for x in walk(ast)}


def pair_count(graph, pairs: dict, used: dict, params: dict) -> DataFrame | None:
    """The counts without listing the pairs; None where the values' types differ.

    Rows of equal values are counted first. An inequality needs, for each value
    of one side, how many rows of the other lie below it: values are dealt out
    by their order, summed up part by part and then within each part, so no task
    holds more than its part, however few the equal values are.
    """
    sides = []
    for path, tests in zip(pairs["paths"], pairs["sides"], strict=True):
        scope = match_paths(Scope(graph, graph.dummy(), {}, params, used), [path])
        for c in tests:
            scope = where(scope, c)
        sides.append(scope)
    asked = [*pairs["equal"], *([pairs["range"][1:]] if pairs["range"] else [])]
    held: list[list] = [[], []]
    kinds = {}
    for i, both in enumerate(asked):
        cols = [Binder(s).expr(x) for s, x in zip(sides, both, strict=True)]
        types = [s.df.select(c.alias("x")).schema[0].dataType for s, c in zip(sides, cols, strict=True)]
        if types[0] != types[1] and not all(isinstance(t, T.IntegralType) for t in types) or not all(isinstance(t, ATOMS) for t in types):
            return None
        for j in (0, 1):
            kinds[both[j]] = (f"k{i}", types[j])
            held[j].append((cols[j] if types[0] == types[1] else cols[j].cast("long")).alias(f"k{i}"))
    values = [f"k{i}" for i in range(len(asked))]
    keys = [f"k{i}" for i in range(len(pairs["equal"]))]
    complete = " AND ".join(f"{v} IS NOT NULL" for v in values) or "true"
    left, right = (s.df.select(*h).where(complete).groupBy(*values).agg(F.count(F.lit(1)).alias("n")) for s, h in zip(sides, held, strict=True))
    if pairs["range"] is None:
        right = right.withColumnRenamed("n", "m")
        linked = left.join(right, keys) if keys else left.crossJoin(right)
        linked = linked.select(*keys, (F.col("n") * F.col("m")).alias("n"))
    else:
        op = pairs["range"][0]
        if op in ("<", "<="):  # as the other side's > and >=
            left, right, op = right, left, FLIPPED[op]
        linked = above(left, right, keys, values[-1], op == ">=")
    by = list(dict.fromkeys(kinds[ast][0] for ast, _ in pairs["items"] if ast[0] != "call"))
    if by:
        linked = linked.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")
    else:
        linked = linked.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return linked.select(*[(F.col("n") if ast[0] == "call" else F.col(kinds[ast][0]).cast(kinds[ast][1])).alias(name) for ast, name in pairs["items"]])


def above(left: DataFrame, right: DataFrame, keys: list[str], value: str, same: bool) -> DataFrame:
    """Of each (keys, value) of ``left``, n rows, the number of pairs with rows of
    ``right`` that have the keys and a smaller value, or the ``same``."""
    none = F.lit(0).cast("long")
    both = left.withColumn("m", none).unionByName(right.select(*keys, value, none.alias("n"), F.col("n").alias("m")))
    both = both.groupBy(*keys, value).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    # Written, so that the parts are the same ones in both sums.
    both = materialize(both.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()))
    parts = both.groupBy(*keys, "part").agg(F.sum("m").alias("own"))
    before = parts.select(*keys, "part", (F.sum("own").over(Window.partitionBy(*keys).orderBy("part")) - F.col("own")).alias("before"))
    inside = F.sum("m").over(Window.partitionBy(*keys, "part").orderBy(value))
    both = both.withColumn("inside", inside if same else inside - F.col("m")).where("n > 0")
    return both.join(before, [*keys, "part"]).select(*keys, (F.col("n") * (F.col("before") + F.col("inside"))).alias("n"))
