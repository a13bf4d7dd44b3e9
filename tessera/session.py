"""The graph session: text in, DataFrames out."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.tables import TABLE_FUNCTIONS
from .operators import dml, project
from .operators.counts import chain_count, chain_of, pair_count, pairs_of
from .operators.match import match_clause, usage, where
from .plans.binder import Binder, Scope, Value
from .plans.catalog import Catalog, NodeTable, RelTable, Sequence
from .plans.materialize import materialize
from .plans.parser import QueryError
from .plans.statements import parse
from .sources import files
from .types import spark_type, type_name

# Settings and their defaults.
SETTINGS = {
    "threads": 8, "timeout": 0, "var_length_extend_max_depth": 30, "sparse_frontier_threshold": 1000, "enable_semi_mask": True, "progress_bar": False, "home_directory": "", "file_search_path": "",
    "recursive_pattern_semantic": "WALK", "recursive_pattern_factor": 100, "warning_limit": 2**63 - 1, "spill_to_disk": True, "enable_plan_optimizer": True, "enable_internal_catalog": False, "checkpoint_threshold": 16777216, "auto_checkpoint": True, "force_checkpoint_on_close": True,
}


def as_tuples(x):
    """An expression read from JSON."""
    return tuple(as_tuples(y) for y in x) if isinstance(x, list) else x


class Prepared:
    """A parsed text whose parameters are bound at each execution."""

    def __init__(self, graph: Graph, text: str):
        self.graph, self.statements = graph, parse(text)

    def execute(self, **params) -> DataFrame | None:
        return self.graph.run_all(self.statements, params)


class Graph:
    """Node and relationship tables of one or more named graphs, and their queries."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs = {"main": Catalog()}
        self.current = "main"
        self.settings = dict(SETTINGS)
        self.udfs: dict = {}
        self.attached: dict = {}
        self.extensions: set[str] = set()
        self.warnings: list[tuple[int, DataFrame]] = []  # numbers of rows and rows
        self.copies = 0
        self.objects: dict = {}
        self.seed: int | None = None
        self.saved: Catalog | None = None
        self._dummy: DataFrame | None = None

    @property
    def catalog(self) -> Catalog:
        return self.graphs[self.current]

    @catalog.setter
    def catalog(self, c: Catalog) -> None:
        self.graphs[self.current] = c

    # ------------------------------------------------------- registration
    def add_nodes(self, name: str, df: DataFrame, pk: str) -> Graph:
        """Use a DataFrame as a node table; ``pk`` must be unique and not null."""
        self.catalog.nodes[name] = NodeTable(name, df, pk, self.catalog.number())
        return self

    def add_rels(self, name: str, df: DataFrame, ends: tuple[str, str], src: str, dst: str, rid: str | None = None, props: list[str] | None = None) -> Graph:
        """Use a DataFrame as relationships from label ``ends[0]`` to ``ends[1]``.

        ``src`` and ``dst`` hold the keys of the end nodes. ``rid`` names a column
        that tells parallel relationships apart; without it their contents do.
        """
        props = [c for c in df.columns if c not in (src, dst)] if props is None else props
        number = F.col(f"`{rid}`").cast("long") if rid else F.xxhash64(F.lit(name), F.lit(ends[0]), F.lit(ends[1]), *[F.col(f"`{c}`") for c in dict.fromkeys([src, dst, *props])])
        part = df.select(F.col(f"`{src}`").alias("_src"), F.col(f"`{dst}`").alias("_dst"), number.alias("_rid"), *[F.col(f"`{p}`") for p in props])
        part = part.where("_src is not null and _dst is not null")
        if name in self.catalog.rels:
            self.catalog.rels[name].parts[ends] = part
        else:
            self.catalog.rels[name] = RelTable(name, {ends: part}, self.catalog.number())
        return self

    def add_object(self, name: str, df) -> Graph:
        """A DataFrame, pandas frame or Arrow table that LOAD FROM finds by name."""
        self.objects[name] = df if isinstance(df, DataFrame) else self.spark.createDataFrame(df)
        return self

    def add_function(self, name: str, f, returns: str = "STRING") -> Graph:
        """A scalar function: a Python callable, or a UDF made by Spark's decorators."""
        self.udfs[name.upper()] = f if hasattr(f, "returnType") else F.udf(f, spark_type(returns))
        return self

    def remove_function(self, name: str) -> None:
        if self.udfs.pop(name.upper(), None) is None:
            raise QueryError(f"function {name} doesn't exist.")

    def dummy(self) -> DataFrame:
        if self._dummy is None:
            self._dummy = self.spark.range(1).select(F.lit(1).alias("_one"))
        return self._dummy

    def prop_type(self, name: str) -> T.DataType:
        for t in (*self.catalog.nodes.values(), *(df for r in self.catalog.rels.values() for df in r.parts.values())):
            df = t.df if isinstance(t, NodeTable) else t
            if name in df.columns:
                return df.schema[name].dataType
        return T.StringType()

    def union_parts(self, rel: RelTable) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rel.parts.values())

    # ---------------------------------------------------------- execution
    def query(self, text: str, **params) -> DataFrame | None:
        """Run every statement of a text; the result is that of the last."""
        return self.run_all(parse(text), params)

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def run_all(self, statements: list[dict], params: dict) -> DataFrame | None:
        out = None
        for s in statements:
            out = getattr(self, "_do_" + s["do"])(s, params)
        return out

    def message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "result string")

    def _do_query(self, s: dict, params: dict) -> DataFrame:
        parts = [self.single(p, params) for p in s["parts"]]
        return parts[0] if len(parts) == 1 else project.union(parts, s["all"])

    def single(self, clauses: list[dict], params: dict) -> DataFrame:
        if (chain := chain_of(clauses)) is not None:
            return chain_count(self, chain, clauses[1]["items"][0][1], params)
        if (pairs := pairs_of(clauses)) is not None and (counted := pair_count(self, pairs, usage(clauses), params)) is not None:
            return counted
        scope = Scope(self, self.dummy(), {}, params, usage(clauses))
        for c in clauses:
            scope = self.clause(scope, c)
        last = clauses[-1]["do"] if clauses else ""
        if last == "call":
            return scope.df.select(*[F.col(f"`{v.column}`").alias(n) for n, v in scope.vars.items()])
        return scope.df if last == "return" else self.message("done")

    def clause(self, scope: Scope, c: dict) -> Scope:
        kind = c["do"]
        if kind == "match":
            return match_clause(scope, c)
        if kind in ("with", "return"):
            return project.project(scope, c)
        if kind == "unwind":
            return project.unwind(scope, c)
        if kind == "create":
            return dml.create(scope, c)
        if kind == "set":
            return dml.assign(scope, c["items"])
        if kind == "delete":
            return dml.delete(scope, c)
        if kind == "merge":
            return dml.merge(scope, c)
        if kind == "call":
            return self.call(scope, c)
        return self.load(scope, c)

    def constant(self, ast, params: dict):
        """Python value of a literal, parameter, list or struct."""
        kind = ast[0]
        if kind == "lit":
            return ast[1]
        if kind == "param":
            return params[ast[1]]
        if kind == "list":
            return [self.constant(x, params) for x in ast[1]]
        if kind == "struct":
            return {k: self.constant(x, params) for k, x in ast[1]}
        if kind == "var":
            return ast[1]
        return Binder(Scope(self, self.dummy(), {}, params, {})).scope.df.select(Binder(Scope(self, self.dummy(), {}, params, {})).expr(ast)).first()[0]

    def call(self, scope: Scope, c: dict) -> Scope:
        if c["name"] not in TABLE_FUNCTIONS:
            raise QueryError(f"{c['name']} is not a table function.")
        args = [self.constant(a, scope.params) for a in c["args"]]
        if c["name"] == "PROJECT_GRAPH":
            args[1:] = [dict.fromkeys(a) if isinstance(a, list) else a for a in args[1:]]
        df = TABLE_FUNCTIONS[c["name"]](self, *args)
        if df is None:
            df = self.message("done")
        names = c["yield"] or [(x, x) for x in df.columns]
        df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in names])
        if scope.vars:
            df = scope.df.crossJoin(df)
        out = Scope(self, df, {**scope.vars, **{b: Value(b) for _, b in names}}, scope.params, scope.used)
        return where(out, c["where"])

    def source(self, src: dict, options: dict, params: dict, schema: T.StructType | None = None) -> DataFrame:
        if "files" in src:
            base = self.settings["file_search_path"]
            found = [f if "/" in f or not base else f"{base}/{f}" for f in src["files"]]
            return files.read(self.spark, found, options, schema)
        if "query" in src:
            return self._do_query(src["query"], params)
        found = params.get(src["param"]) if "param" in src else self.objects.get(src["object"])
        if found is None and self.catalog.has(src.get("object", "")):
            found = self.catalog.node(src["object"]).df
        if found is None and self.spark.catalog.tableExists(src.get("object", "")):
            found = self.spark.table(src["object"])
        if found is None:
            raise QueryError(f"No file format or object found for {src}.")
        return found if isinstance(found, DataFrame) else self.spark.createDataFrame(found)

    def load(self, scope: Scope, c: dict) -> Scope:
        schema = T.StructType([T.StructField(n, spark_type(t, self.catalog.types)) for n, t in c["heads"]]) if c["heads"] else None
        options = {k: self.constant(v, scope.params) for k, v in c["options"].items()}
        df = self.source(c["source"], options, scope.params, schema)
        if scope.vars:
            df = scope.df.crossJoin(df)
        out = Scope(self, df, {**scope.vars, **{n: Value(n) for n in df.columns if n not in scope.df.columns or not scope.vars}}, scope.params, scope.used)
        return where(out, c["where"])

    # ---------------------------------------------------------------- DDL
    def _exists(self, s: dict) -> bool:
        if self.catalog.has(s["name"]):
            if s.get("quiet"):
                return True
            raise QueryError(f"{s['name']} already exists in catalog.")
        return False

    def _do_node(self, s: dict, params: dict) -> DataFrame:
        if self._exists(s):
            return self.message(f"{s['name']} already exists.")
        if "query" in s:
            df = materialize(self._do_query(s["query"], params))
            self.catalog.nodes[s["name"]] = NodeTable(s["name"], df, df.columns[0], self.catalog.number())
        else:
            schema = T.StructType([T.StructField(n, spark_type(t, self.catalog.types)) for n, t, _, _ in s["columns"]])
            t = NodeTable(s["name"], self.spark.createDataFrame([], schema), s["pk"], self.catalog.number(), partition=s["partition"])
            t.types = {n: k.upper() for n, k, _, _ in s["columns"]}
            t.defaults = {n: d for n, _, d, _ in s["columns"] if d is not None}
            self.catalog.nodes[s["name"]] = t
        return self.message(f"Table {s['name']} has been created.")

    def _do_rel(self, s: dict, params: dict) -> DataFrame:
        if self._exists(s):
            return self.message(f"{s['name']} already exists.")
        extra = [T.StructField(n, spark_type(t, self.catalog.types)) for n, t, _, _ in s["columns"]]
        parts = {}
        for a, b in s["pairs"]:
            na, nb = self.catalog.node(a), self.catalog.node(b)
            fields = [T.StructField("_src", na.df.schema[na.pk].dataType), T.StructField("_dst", nb.df.schema[nb.pk].dataType), T.StructField("_rid", T.LongType()), *extra]
            parts[na.name, nb.name] = self.spark.createDataFrame([], T.StructType(fields))
        t = RelTable(s["name"], parts, self.catalog.number(), s["mult"])
        t.types = {n: k.upper() for n, k, _, _ in s["columns"]}
        t.defaults = {n: d for n, _, d, _ in s["columns"] if d is not None}
        self.catalog.rels[s["name"]] = t
        if "query" in s:
            df = self._do_query(s["query"], params)
            pair = next(iter(parts))
            extra = [T.StructField(f.name, f.dataType) for f in df.schema.fields[2:]]
            old = parts[pair]
            for f in extra:
                old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
            t.parts[pair] = old
            dml.insert_rels(self, t.name, pair, df.toDF("_src", "_dst", *df.columns[2:]))
        return self.message(f"Table {s['name']} has been created.")

    def _do_sequence(self, s: dict, params: dict) -> DataFrame:
        if s["name"] in self.catalog.sequences:
            if s["quiet"]:
                return self.message("exists")
            raise QueryError(f"{s['name']} already exists in catalog.")
        down = s["by"] < 0
        low = s["min"] if s["min"] is not None else -(2**63) if down else 1
        high = s["max"] if s["max"] is not None else -1 if down else 2**63 - 1
        start = s["start"] if s["start"] is not None else high if down else low
        self.catalog.sequences[s["name"]] = Sequence(s["name"], start, s["by"], low, high, s["cycle"])
        return self.message(f"Sequence {s['name']} has been created.")

    def _do_type(self, s: dict, params: dict) -> DataFrame:
        spark_type(s["of"], self.catalog.types)
        self.catalog.types[s["name"]] = s["of"]
        return self.message(f"Type {s['name']} has been created.")

    def _do_macro(self, s: dict, params: dict) -> DataFrame:
        if s["name"] in self.catalog.macros:
            raise QueryError(f"Macro {s['name']} already exists.")
        self.catalog.macros[s["name"]] = (s["args"], s["body"], s["text"])
        return self.message(f"Macro: {s['name']} has been created.")

    def _do_graph(self, s: dict, params: dict) -> DataFrame:
        if s["name"] in self.graphs and not s["quiet"]:
            raise QueryError(f"Graph {s['name']} already exists.")
        self.graphs.setdefault(s["name"], Catalog())
        return self.message(f"Graph {s['name']} has been created.")

    def _do_use(self, s: dict, params: dict) -> DataFrame:
        if s["name"] not in self.graphs:
            raise QueryError(f"No database or graph named {s['name']}.")
        self.current = s["name"]
        return self.message(f"Used {s['name']}.")

    def _do_index(self, s: dict, params: dict) -> DataFrame:
        self.catalog.node(s["table"])
        self.catalog.indexes[s["name"]] = {"table": s["table"], "kind": s["kind"], "columns": s["columns"]}
        return self.message(f"Index {s['name']} has been created.")

    def _do_drop(self, s: dict, params: dict) -> DataFrame:
        c, kind, name = self.catalog, s["kind"], s["name"]
        stores = {"TABLE": None, "SEQUENCE": c.sequences, "MACRO": c.macros, "GRAPH": self.graphs, "INDEX": c.indexes, "TYPE": c.types}
        if kind not in stores:
            raise QueryError(f"cannot drop {kind}")
        if kind == "TABLE":
            node, rel = c._find(c.nodes, name), c._find(c.rels, name)
            if node is not None:
                for r in c.rels.values():
                    if any(node.name in pair for pair in r.parts):
                        raise QueryError(f"Cannot delete node table {node.name} because it is referenced by relationship table {r.name}.")
                del c.nodes[node.name]
            elif rel is not None:
                del c.rels[rel.name]
            elif not s["quiet"]:
                raise QueryError(f"Table {name} does not exist.")
        elif name in stores[kind]:
            del stores[kind][name]
            if kind == "GRAPH" and self.current == name:
                self.current = "main"
        elif not s["quiet"]:
            raise QueryError(f"{kind.title()} {name} does not exist.")
        c.version += 1
        return self.message(f"{kind.title()} {name} has been dropped.")

    def _do_alter(self, s: dict, params: dict) -> DataFrame:
        c = self.catalog
        node, rel = c._find(c.nodes, s["table"]), c._find(c.rels, s["table"])
        t = node or rel
        if t is None:
            raise QueryError(f"Table {s['table']} does not exist.")

        def change(f):
            if node is not None:
                node.df = f(node.df)
            else:
                rel.parts = {k: f(df) for k, df in rel.parts.items()}

        if "add" in s:
            name, kind, default, _ = s["add"]
            if name in t.props:
                if s["quiet"]:
                    return self.message("exists")
                raise QueryError(f"{t.name} table already has property {name}.")
            value = Binder(Scope(self, self.dummy(), {}, params, {})).expr(default) if default is not None else F.lit(None)
            change(lambda df: df.withColumn(name, value.cast(spark_type(kind, c.types))))
            t.types[name] = kind.upper()
            if default is not None:
                t.defaults[name] = default
        elif "drop" in s:
            if s["drop"] not in t.props:
                if s["quiet"]:
                    return self.message("absent")
                raise QueryError(f"{t.name} table does not have property {s['drop']}.")
            if node is not None and s["drop"] == node.pk:
                raise QueryError(f"Cannot drop property {s['drop']} in table {t.name} because it is used as primary key.")
            change(lambda df: df.drop(s["drop"]))
        elif "rename_column" in s:
            old, new = s["rename_column"]
            if old not in t.props:
                raise QueryError(f"{t.name} table does not have property {old}.")
            change(lambda df: df.withColumnRenamed(old, new))
            if node is not None and node.pk == old:
                node.pk = new
        elif "rename" in s:
            new = s["rename"]
            if node is not None:
                c.nodes[new] = c.nodes.pop(t.name)
                for r in c.rels.values():
                    r.parts = {tuple(new if x == t.name else x for x in k): v for k, v in r.parts.items()}
            else:
                c.rels[new] = c.rels.pop(t.name)
            t.name = new
        elif "add_pair" in s:
            a, b = (c.node(x) for x in s["add_pair"])
            like = next(iter(rel.parts.values()))
            fields = [T.StructField("_src", a.df.schema[a.pk].dataType), T.StructField("_dst", b.df.schema[b.pk].dataType), *like.schema.fields[2:]]
            rel.parts[a.name, b.name] = self.spark.createDataFrame([], T.StructType(fields))
        else:
            rel.parts.pop(tuple(s["drop_pair"]), None)
        c.version += 1
        return self.message(f"Table {s['table']} altered.")

    def _do_comment(self, s: dict, params: dict) -> DataFrame:
        (self.catalog._find(self.catalog.nodes, s["table"]) or self.catalog.rel(s["table"])).comment = s["text"]
        return self.message(f"Table {s['table']} comment updated.")

    # ----------------------------------------------------------------- IO
    def warn(self, message: str, rejected: DataFrame, key: str, src: dict) -> int:
        """Keep rejected rows for SHOW_WARNINGS, in the shared folder, and only up to
        ``warning_limit`` where that is set; gives the number of all."""
        path = src["files"][0] if len(src.get("files", ())) == 1 else None
        line = F.concat_ws(",", *[(c.cast("string") if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(c)) for f in rejected.schema.fields for c in [F.col(f"`{f.name}`")]])
        named = F.replace(F.lit(message), F.lit("{}"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("None")))
        kept = materialize(rejected.select(F.lit(self.copies).cast("long").alias("query_id"), named.alias("message"), F.lit(path).cast("string").alias("file_path"), F.lit(None).cast("long").alias("line_number"), line.alias("skipped_line_or_record")))
        n = kept.count()
        room = max(0, int(self.settings["warning_limit"]) - sum(k for k, _ in self.warnings))
        if n > room:
            kept = materialize(kept.limit(room))
        if min(n, room):
            self.warnings.append((min(n, room), kept))
        return n

    def _do_copy_from(self, s: dict, params: dict) -> DataFrame:
        options = {k: self.constant(v, params) for k, v in s["options"].items()}
        c, lost = self.catalog, 0
        self.copies += 1
        node = c._find(c.nodes, s["table"])
        if node is not None:
            names = s["columns"] or [p for p in node.props if node.types.get(p) != "SERIAL"]
            schema = T.StructType([node.df.schema[n] for n in names])
            df = files.read_by_column(self.spark, s["source"]["files"], names) if s["by_column"] else self.source(s["source"], options, params, schema if "files" in s["source"] else None)
            df = df.toDF(*names)
            if options.get("IGNORE_ERRORS") or options.get("SKIP_DUPLICATE_PK"):
                df, rejected = dml.first_of_each_key(df, node.pk, node.df)
                if options.get("IGNORE_ERRORS"):
                    lost += sum(self.warn(m, bad, node.pk, s["source"]) for m, bad in rejected)
            n = dml.insert_nodes(self, node.name, df)
        else:
            rel = c.rel(s["table"])
            pair = (options.pop("FROM"), options.pop("TO")) if "FROM" in options else next(iter(rel.parts))
            like = rel.parts[pair]
            names = ["_src", "_dst", *(s["columns"] or rel.props)]
            schema = T.StructType([T.StructField(n, like.schema[n].dataType) for n in names])
            df = self.source(s["source"], options, params, schema if "files" in s["source"] else None).toDF(*names)
            if options.get("IGNORE_ERRORS"):
                for side, label in zip(("_src", "_dst"), pair, strict=True):
                    keys = c.nodes[label].df.select(F.col(f"`{c.nodes[label].pk}`").alias(side))
                    lost += self.warn("Unable to find primary key value {}.", df.join(keys, side, "left_anti").select(*names), side, s["source"])
                    df = df.join(keys, side, "left_semi").select(*names)
            n = dml.insert_rels(self, rel.name, pair, df)
        told = f" {lost} warnings encountered during copy. Use 'CALL show_warnings() RETURN *' to view the actual warnings. Query ID: {self.copies}" if lost else ""
        return self.message(f"{n} tuples have been copied to the {s['table']} table.{told}")

    def _do_copy_to(self, s: dict, params: dict) -> DataFrame:
        df = self._do_query(s["query"], params)
        files.write(df, s["path"], {k: self.constant(v, params) for k, v in s["options"].items()})
        return self.message(f"Copied to {s['path']}.")

    def _do_export(self, s: dict, params: dict) -> DataFrame:
        """Schema as statements, data as Parquet, one folder a table."""
        c, script, copies = self.catalog, [], []
        for t in c.nodes.values():
            cols = ", ".join(f"`{f.name}` {t.types.get(f.name) or type_name(f.dataType)}" for f in t.df.schema.fields)
            script.append(f"CREATE NODE TABLE `{t.name}` ({cols}, PRIMARY KEY(`{t.pk}`));")
            t.df.write.mode("overwrite").parquet(f"{s['path']}/{t.name}.parquet")
            copies.append({"table": t.name, "path": f"{t.name}.parquet"})
        for r in c.rels.values():
            one = next(iter(r.parts.values()))
            cols = [f"FROM `{a}` TO `{b}`" for a, b in r.parts] + [f"`{f.name}` {r.types.get(f.name) or type_name(f.dataType)}" for f in one.schema.fields if f.name in r.props] + [r.mult]
            script.append(f"CREATE REL TABLE `{r.name}` ({', '.join(cols)});")
            for a, b in r.parts:
                r.parts[a, b].drop("_rid").select("_src", "_dst", *[f"`{p}`" for p in r.props]).write.mode("overwrite").parquet(f"{s['path']}/{r.name}_{a}_{b}.parquet")
                copies.append({"table": r.name, "from": a, "to": b, "path": f"{r.name}_{a}_{b}.parquet"})
        for t in (*c.nodes.values(), *c.rels.values()):
            copies += [{"default": k, "of": t.name, "ast": ast} for k, ast in t.defaults.items()]
            copies += [{"comment": t.comment, "of": t.name}] if t.comment else []
        for x in c.sequences.values():
            copies.append({"sequence": {"name": x.name, "start": x.start, "by": x.by, "low": x.low, "high": x.high, "cycle": x.cycle, "value": x.value}})
        named = [("schema", f"CREATE TYPE `{n}` AS {of};") for n, of in c.types.items()]
        named += [("schema", f"CREATE MACRO `{n}`({', '.join(a if d is None else f'{a} := {json.dumps(d[1])}' for a, d in args)}) AS {text};") for n, (args, _, text) in c.macros.items()]
        copies += [{"index": n, "as": x} for n, x in c.indexes.items()]
        lines = named + [("schema", x) for x in script] + [("copy", json.dumps(x)) for x in copies]
        self.spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(lines)], "i int, kind string, line string").coalesce(1).write.mode("overwrite").json(f"{s['path']}/statements")
        return self.message("Exported database successfully.")

    def _do_import(self, s: dict, params: dict) -> DataFrame:
        for r in self.spark.read.json(f"{s['path']}/statements").orderBy("i").collect():
            if r["kind"] == "schema":
                self.query(r["line"])
            else:
                x = json.loads(r["line"])
                if "path" not in x:
                    self.restore(x)
                    continue
                df = self.spark.read.parquet(f"{s['path']}/{x['path']}")
                if "from" in x:
                    dml.insert_rels(self, x["table"], (x["from"], x["to"]), df)
                else:
                    dml.insert_nodes(self, x["table"], df)
        return self.message("Imported database successfully.")

    def restore(self, x: dict) -> None:
        """A default, comment, sequence or index of an exported database."""
        c = self.catalog
        if "sequence" in x:
            c.sequences[x["sequence"]["name"]] = Sequence(**x["sequence"])
        elif "index" in x:
            c.indexes[x["index"]] = x["as"]
        else:
            t = c._find(c.nodes, x["of"]) or c.rel(x["of"])
            if "comment" in x:
                t.comment = x["comment"]
            else:
                t.defaults[x["default"]] = as_tuples(x["ast"])

    # ------------------------------------------------------------- session
    def _do_attach(self, s: dict, params: dict) -> DataFrame:
        """Open an exported database, or a folder of Parquet files, as a graph of its own."""
        kind = str(self.constant(s["options"].get("DBTYPE", ("lit", "parquet")), params)).lower()
        if s["name"] in self.graphs:
            raise QueryError(f"Duplicate attached database name: {s['name']}. Attached database name must be unique.")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(s["path"])
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise QueryError(f"Cannot open database {s['path']}: it does not exist.")
        before, self.graphs[s["name"]], self.current = self.current, Catalog(), s["name"]
        try:
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{s['path']}/statements")):
                self._do_import({"path": s["path"]}, params)
            else:
                for found in fs.listStatus(path):
                    name = found.getPath().getName()
                    if name.endswith(".parquet"):
                        df = self.spark.read.parquet(found.getPath().toString())
                        self.add_nodes(name[: -len(".parquet")], df, df.columns[0])
        except Exception:
            del self.graphs[s["name"]]
            raise
        finally:
            self.current = before
        self.attached[s["name"]] = (kind, s["path"])
        return self.message("Attached database successfully.")

    def _do_detach(self, s: dict, params: dict) -> DataFrame:
        if self.attached.pop(s["name"], None) is None:
            raise QueryError(f"Database: {s['name']} doesn't exist.")
        del self.graphs[s["name"]]
        if self.current == s["name"]:
            self.current = "main"
        return self.message("Detached database successfully.")

    def _do_extension(self, s: dict, params: dict) -> DataFrame:
        self.extensions.add(s["name"].upper())
        return self.message(f"Extension: {s['name']} is available.")

    def _do_setting(self, s: dict, params: dict) -> DataFrame:
        if s["name"] not in self.settings:
            raise QueryError(f"Invalid option name: {s['name']}.")
        self.settings[s["name"]] = self.constant(s["value"], params)
        return self.message(f"{s['name']} has been set.")

    def _do_begin(self, s: dict, params: dict) -> DataFrame:
        if self.saved is not None:
            raise QueryError("Connection already has an active transaction.")
        self.saved = self.catalog.snapshot()
        return self.message("BEGIN")

    def _do_commit(self, s: dict, params: dict) -> DataFrame:
        if self.saved is None:
            raise QueryError("No active transaction for COMMIT.")
        self.saved = None
        return self.message("COMMIT")

    def _do_rollback(self, s: dict, params: dict) -> DataFrame:
        if self.saved is None:
            raise QueryError("No active transaction for ROLLBACK.")
        self.catalog, self.saved = self.saved, None
        return self.message("ROLLBACK")

    def _do_checkpoint(self, s: dict, params: dict) -> DataFrame:
        for t in self.catalog.nodes.values():
            t.df = materialize(t.df)
        for r in self.catalog.rels.values():
            r.parts = {k: materialize(df) for k, df in r.parts.items()}
        return self.message("CHECKPOINT")

    def _do_analyze(self, s: dict, params: dict) -> DataFrame:
        return self.spark.createDataFrame([(t.name, t.df.count()) for t in self.catalog.nodes.values()] + [(r.name, self.union_parts(r).count()) for r in self.catalog.rels.values()], "name string, cardinality long")

    def plan_text(self, df: DataFrame, mode: str) -> str:
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def _do_explain(self, s: dict, params: dict) -> DataFrame:
        df = getattr(self, "_do_" + s["of"]["do"])(s["of"], params)
        return self.spark.createDataFrame([(self.plan_text(df, s["mode"]),)], "`explain result` string")

    def _do_profile(self, s: dict, params: dict) -> DataFrame:
        import time

        df = getattr(self, "_do_" + s["of"]["do"])(s["of"], params)
        began = time.time()
        n = df.count()
        return self.spark.createDataFrame([(self.plan_text(df, "formatted"), n, time.time() - began)], "`profile result` string, rows long, seconds double")
