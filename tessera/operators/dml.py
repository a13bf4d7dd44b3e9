"""CREATE, SET, DELETE and MERGE as new versions of tables.

Input rows are materialised first, so their side effects happen once; every
table that changes is replaced by a DataFrame written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.binder import Binder, Node, Rel, Scope, Value
from ..plans.materialize import materialize
from ..plans.parser import QueryError
from .match import Matcher, match_paths


def numbered(df: DataFrame) -> DataFrame:
    """Rows with a relationship id that is unique among all written so far."""
    import uuid

    base = (uuid.uuid4().int >> 91) << 24
    return df.withColumn("_rid", F.lit(base) + F.monotonically_increasing_id())


def row_numbers(df: DataFrame, name: str, top: int) -> DataFrame:
    """``df`` with a column of gapless numbers that go on after ``top``.

    Numbers within a partition come from the scan itself; only one row a
    partition, its count, is summed up in order and sent to every task.
    """
    rows = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(top + 1)
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn(name, at).drop("_at", "_part", "_before")


def default(graph, table, prop: str, kind):
    """Default value of a property, or the next numbers of a SERIAL."""
    ast = table.defaults.get(prop)
    return Binder(Scope(graph, graph.dummy(), {}, {}, {})).expr(ast).cast(kind) if ast else F.lit(None).cast(kind)


def insert_nodes(graph, name: str, rows: DataFrame) -> int:
    """Append rows (a subset of the table's columns) after checking the key; gives their number."""
    t = graph.catalog.nodes[name]
    if t.types.get(t.pk, "").upper() == "SERIAL" and t.pk not in rows.columns:
        top = t.df.agg(F.coalesce(F.max(t.pk), F.lit(-1))).first()[0]
        rows = row_numbers(rows, t.pk, top)
    cols = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else default(graph, t, f.name, f.dataType)).alias(f.name) for f in t.df.schema.fields]
    new = materialize(rows.select(*cols))
    if not new.where(F.col(f"`{t.pk}`").isNull()).isEmpty():
        raise QueryError("Found NULL, which violates the non-null constraint of the primary key column.")
    twice = new.groupBy(t.pk).count().where("count > 1").select(t.pk).limit(1).collect() or new.join(t.df.select(t.pk), t.pk, "left_semi").select(t.pk).limit(1).collect()
    if twice:
        raise QueryError(f"Found duplicated primary key value {twice[0][0]}, which violates the uniqueness constraint of the primary key column.")
    t.df = t.df.unionByName(new)
    graph.catalog.version += 1
    return new.count()


def insert_rels(graph, name: str, pair: tuple[str, str], rows: DataFrame) -> int:
    """Append rows (_src, _dst, properties); both ends must exist. Gives their number."""
    t = graph.catalog.rels[name]
    if pair not in t.parts:
        raise QueryError(f"Relationship {name} has no pair from {pair[0]} to {pair[1]}.")
    old = t.parts[pair]
    cols = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else default(graph, t, f.name, f.dataType)).alias(f.name) for f in old.schema.fields if f.name != "_rid"]
    new = materialize(numbered(rows.select(*cols)).select(*old.columns))
    for side, label in (("_src", pair[0]), ("_dst", pair[1])):
        n = graph.catalog.nodes[label]
        lost = new.join(n.df.select(F.col(f"`{n.pk}`").alias(side)), side, "left_anti").limit(1).collect()
        if lost:
            raise QueryError(f"Unable to find primary key value {lost[0][side]}.")
    merged = old.unionByName(new)
    for side, single in (("_src", t.mult.endswith("_ONE")), ("_dst", t.mult.startswith("ONE_"))):
        if single and not merged.groupBy(side).count().where("count > 1").isEmpty():
            raise QueryError(f"A node has more than one neighbour in {name}, which violates the rel multiplicity constraint {t.mult}.")
    t.parts[pair] = merged
    graph.catalog.version += 1
    return new.count()


def first_of_each_key(rows: DataFrame, pk: str, known: DataFrame) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Rows that may be inserted, and (reason, rows) of those that may not.

    Of rows with the same key the first stays, unless ``known`` has the key. A
    key that very many rows share is aggregated before it is shuffled.
    """
    key = F.col(f"`{pk}`")
    at = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))
    first = at.where(key.isNotNull()).groupBy(key.alias("_k")).agg(F.min("_at").alias("_first"))
    first = materialize(first.join(known.select(key.alias("_k")), "_k", "left_anti"))
    on = at["_at"] == first["_first"]
    good = at.join(first, on, "left_semi").drop("_at")
    twice = at.where(key.isNotNull()).join(first, on, "left_anti").drop("_at")
    duplicate = "Found duplicated primary key value {}, which violates the uniqueness constraint of the primary key column."
    return good, [("Found NULL, which violates the non-null constraint of the primary key column.", at.where(key.isNull()).drop("_at")), (duplicate, twice)]


def sequenced(scope: Scope, item: dict) -> tuple[Scope, dict]:
    """A pattern element whose nextval calls are columns of the rows."""
    from .project import number_rows

    props = []
    for k, e in item["props"]:
        scope, e = number_rows(scope, e)
        props.append((k, e))
    return scope, {**item, "props": props}


def create(scope: Scope, clause: dict) -> Scope:
    """One new node or relationship per input row and pattern element."""
    graph = scope.graph
    scope = scope.at(materialize(scope.df) if scope.vars else scope.df)
    keyed = Scope(graph, scope.df, dict(scope.vars), scope.params, scope.used)
    for path in clause["paths"]:
        names = []
        for item in path["items"]:
            if not item["node"]:
                continue
            name = item["var"] or f"_c{len(keyed.vars)}"
            names.append(name)
            if name in keyed.vars:
                continue
            if len(item["labels"]) != 1:
                raise QueryError(f"Create node {name} expects a single node label.")
            t = graph.catalog.node(item["labels"][0])
            keyed, item = sequenced(keyed, item)
            b = Binder(keyed)
            types = {f.name.lower(): f for f in t.df.schema.fields}
            given = {}
            for k, e in item["props"]:
                if k.lower() not in types:
                    raise QueryError(f"Cannot find property {k} for {name}.")
                f = types[k.lower()]
                given[f.name] = b.expr(e).cast(f.dataType)
            if t.pk not in given:
                if t.types.get(t.pk, "").upper() != "SERIAL":
                    raise QueryError(f"Create node {name} expects primary key {t.pk} as input.")
                top = t.df.agg(F.coalesce(F.max(t.pk), F.lit(-1))).first()[0]
                keyed = keyed.at(row_numbers(keyed.df, "_serial", top))
                given[t.pk] = F.col("_serial")
            cols = {f"{name}__{f.name}": given.get(f.name, default(graph, t, f.name, f.dataType)) for f in t.df.schema.fields}
            df = materialize(keyed.df.withColumns({f"{name}___id": given[t.pk], f"{name}___label": F.lit(t.name), **cols}).drop("_serial"))
            insert_nodes(graph, t.name, df.select(*[F.col(f"`{name}__{p}`").alias(p) for p in t.props]))
            keyed = Scope(graph, df, {**keyed.vars, name: Node(name, [t.name], t.props, t.pk)}, keyed.params, keyed.used)
        ends = iter(zip(names, names[1:], strict=False))
        for item in path["items"]:
            if item["node"]:
                continue
            left, right = next(ends)
            src, dst = (right, left) if item["dir"] == "back" else (left, right)
            if len(item["labels"]) != 1:
                raise QueryError("Create rel expects a single rel label.")
            t = graph.catalog.rel(item["labels"][0])
            keyed, item = sequenced(keyed, item)
            b = Binder(keyed)
            sample = next(iter(t.parts.values())).schema
            given = {next(f.name for f in sample.fields if f.name.lower() == k.lower()): b.expr(e) for k, e in item["props"]}
            for pair in t.parts:
                rows = keyed.df.where((F.col(f"{src}___label") == pair[0]) & (F.col(f"{dst}___label") == pair[1]))
                if pair[0] in keyed.vars[src].labels and pair[1] in keyed.vars[dst].labels:
                    insert_rels(graph, t.name, pair, rows.select(F.col(f"{src}___id").alias("_src"), F.col(f"{dst}___id").alias("_dst"), *[c.alias(k) for k, c in given.items()]))
            if item["var"]:
                keyed.vars[item["var"]] = Rel(item["var"], [t.name], list(given))
                keyed.df = keyed.df.withColumns({f"{item['var']}___src": F.col(f"{src}___id"), f"{item['var']}___srclabel": F.col(f"{src}___label"), f"{item['var']}___dst": F.col(f"{dst}___id"), f"{item['var']}___dstlabel": F.col(f"{dst}___label"), f"{item['var']}___label": F.lit(t.name), f"{item['var']}___rid": F.lit(0).cast("long"), **{f"{item['var']}__{k}": c for k, c in given.items()}})
    return keyed


def assign(scope: Scope, items: list) -> Scope:
    """SET: one new value per node or relationship, that of the last of its rows."""
    graph = scope.graph
    df = materialize(scope.df.withColumn("_at", F.monotonically_increasing_id()))
    scope = scope.at(df)
    for target, e in items:
        if target[0] != "prop" or target[1][0] != "var":
            raise QueryError("SET expects a property of a variable.")
        v = scope.vars[target[1][1]]
        b = Binder(scope)
        value = b.expr(e)
        if isinstance(v, Node):
            for label in v.labels:
                t = graph.catalog.nodes[label]
                prop = next((p for p in t.props if p.lower() == target[2].lower()), None)
                if prop is None:
                    continue
                kind = t.df.schema[prop].dataType
                new = scope.df.where(F.col(f"{v.name}___label") == label).select(F.col(f"{v.name}___id").cast(t.df.schema[t.pk].dataType).alias("_k"), value.cast(kind).alias("_v"), "_at").groupBy("_k").agg(F.max_by("_v", "_at").alias("_v"), F.lit(True).alias("_hit"))
                old = t.df.join(new, t.df[f"`{t.pk}`"] == new["_k"], "left")
                t.df = materialize(old.select(*[(F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(f"`{p}`")) if p == prop else F.col(f"`{p}`")).alias(p) for p in t.props]))
        else:
            for label in v.labels:
                t = graph.catalog.rels[label]
                prop = next((p for p in t.props if p.lower() == target[2].lower()), None)
                if prop is None:
                    continue
                for pair, old in list(t.parts.items()):
                    kind = old.schema[prop].dataType
                    new = scope.df.where(F.col(f"{v.name}___label") == label).select(F.col(f"{v.name}___rid").alias("_k"), value.cast(kind).alias("_v"), "_at").groupBy("_k").agg(F.max_by("_v", "_at").alias("_v"), F.lit(True).alias("_hit"))
                    joined = old.join(new, old["_rid"] == new["_k"], "left")
                    t.parts[pair] = materialize(joined.select(*[(F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(f"`{p}`")) if p == prop else F.col(f"`{p}`")).alias(p) for p in old.columns]))
        column = next((c for c in df.columns if c.lower() == f"{v.name}__{target[2]}".lower()), None)
        if column:
            scope = scope.at(materialize(scope.df.withColumn(column, value.cast(df.schema[column].dataType))))
    graph.catalog.version += 1
    return scope.at(scope.df.drop("_at"))


def delete(scope: Scope, clause: dict) -> Scope:
    graph = scope.graph
    scope = scope.at(materialize(scope.df))
    vars_ = [scope.vars[e[1]] for e in clause["what"]]
    for v in (x for x in vars_ if isinstance(x, Rel)):
        gone = scope.df.select(F.col(f"{v.name}___rid").alias("_rid")).distinct()
        for label in v.labels:
            t = graph.catalog.rels[label]
            for pair, df in list(t.parts.items()):
                t.parts[pair] = materialize(df.join(gone, "_rid", "left_anti").select(*df.columns))
    for v in (x for x in vars_ if isinstance(x, Node)):
        for label in v.labels:
            t = graph.catalog.nodes[label]
            gone = scope.df.where(F.col(f"{v.name}___label") == label).select(F.col(f"{v.name}___id").cast(t.df.schema[t.pk].dataType).alias("_k")).where("_k is not null").distinct()
            for r in graph.catalog.rels.values():
                for pair, df in list(r.parts.items()):
                    for side, end in (("_src", pair[0]), ("_dst", pair[1])):
                        if end != label:
                            continue
                        if clause["detach"]:
                            df = df.join(gone, df[side] == gone["_k"], "left_anti")
                        elif not df.join(gone, df[side] == gone["_k"], "left_semi").isEmpty():
                            raise QueryError("A node has connected edges, which cannot be deleted. Please delete the edges first or try DETACH DELETE.")
                    if clause["detach"]:
                        r.parts[pair] = materialize(df)
            t.df = materialize(t.df.join(gone, t.df[f"`{t.pk}`"] == gone["_k"], "left_anti"))
    graph.catalog.version += 1
    return scope


def merge(scope: Scope, clause: dict) -> Scope:
    """Match each row's pattern, or create it once per distinct key.

    Rows whose key was created by an earlier row of the same statement count as
    matched for ON MATCH.
    """
    graph, path = scope.graph, clause["path"]
    df = materialize(scope.df.withColumn("_row", F.monotonically_increasing_id()))
    base = Scope(graph, df, {**scope.vars, "_row": Value("_row")}, scope.params, scope.used)
    found = match_paths(base, [path])
    hit = materialize(found.df)
    rest = df.join(hit.select("_row").distinct(), "_row", "left_anti")
    b = Binder(base)
    keys = [b.expr(e).alias(f"_m{i}") for i, e in enumerate(e for item in path["items"] for _, e in item["props"] if e[0] != "lit")]
    bound = [F.col(c) for item in path["items"] if item["node"] and item["var"] in scope.vars for c in (f"{item['var']}___id", f"{item['var']}___label")]
    marked = materialize(rest.select("*", F.row_number().over(Window.partitionBy(*(keys + bound or [F.lit(1)])).orderBy("_row")).alias("_nth")))
    first = marked.where("_nth = 1").drop("_nth")
    if not first.isEmpty():
        create(base.at(first), {"paths": [path]})
        if clause["create"]:
            again = match_paths(base.at(first), [path])
            assign(again, clause["create"])
    if clause["match"]:
        later = marked.where("_nth > 1").drop("_nth")
        again = match_paths(base.at(later), [path])
        old = Scope(graph, hit, found.vars, found.params, found.used)
        cols = [c for c in hit.columns if c in again.df.columns]
        both = old.df.select(*cols).unionByName(again.df.select(*cols))
        assign(old.at(both), clause["match"])
    out = match_paths(base.at(df), [path])
    out.df = out.df.drop("_row")
    out.vars.pop("_row", None)
    return out


__all__ = ["Matcher", "assign", "create", "delete", "insert_nodes", "insert_rels", "merge", "numbered", "reduce"]
