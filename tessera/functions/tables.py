"""Table functions of CALL: catalog listings and projected graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parser import QueryError
from ..types import type_name

VERSION = "0.1.0"
EXTENSIONS = (("ALGO", "Graph algorithms"), ("FTS", "Full text search"), ("JSON", "JSON functions"), ("VECTOR", "Vector search"))


def rows(graph, schema: str, data: list) -> DataFrame:
    return graph.spark.createDataFrame(data, schema)


def show_tables(graph):
    c = graph.catalog
    data = [(t.number, t.name, "NODE", "local(tessera)", t.comment) for t in c.nodes.values()] + [(t.number, t.name, "REL", "local(tessera)", t.comment) for t in c.rels.values()]
    return rows(graph, "`id` long, `name` string, `type` string, `database name` string, `comment` string", data)


def declared(table, field) -> str:
    return table.types.get(field.name) or type_name(field.dataType)


def table_info(graph, name):
    c = graph.catalog
    if (t := c._find(c.nodes, name)) is not None:
        data = [(i, f.name, declared(t, f), str(t.defaults[f.name][1]) if f.name in t.defaults else "NULL", f.name == t.pk) for i, f in enumerate(t.df.schema.fields)]
        return rows(graph, "`property id` long, `name` string, `type` string, `default expression` string, `primary key` boolean", data)
    r = c.rel(name)
    fields = [f for f in next(iter(r.parts.values())).schema.fields if f.name in r.props]
    data = [(i + 1, f.name, declared(r, f), str(r.defaults[f.name][1]) if f.name in r.defaults else "NULL", "both") for i, f in enumerate(fields)]
    return rows(graph, "`property id` long, `name` string, `type` string, `default expression` string, `storage_direction` string", data)


def show_connection(graph, name):
    c = graph.catalog
    data = [(s, d, c.nodes[s].pk, c.nodes[d].pk) for s, d in c.rel(name).parts]
    return rows(graph, "`source table name` string, `destination table name` string, `source table primary key` string, `destination table primary key` string", data)


def stats_info(graph, name):
    c = graph.catalog
    t = c._find(c.nodes, name)
    if t is None:
        return graph.union_parts(c.rel(name)).agg(F.count(F.lit(1)).alias("cardinality"))
    return t.df.agg(F.count(F.lit(1)).alias("cardinality"), *[F.approx_count_distinct(f"`{p}`").alias(f"{p}_distinct_count") for p in t.props])


def storage_info(graph, name):
    c = graph.catalog
    t = c._find(c.nodes, name)
    df = t.df if t is not None else graph.union_parts(c.rel(name))
    return rows(graph, "table_name string, column_name string, data_type string", [(name, f.name, type_name(f.dataType)) for f in df.schema.fields])


def show_functions(graph):
    from ..plans.binder import AGGREGATES, Binder
    from .scalar import REGISTRY

    scalar = sorted({*REGISTRY, *(n[3:].upper() for n in dir(Binder) if n.startswith("_f_"))})
    data = [(n, "SCALAR", "") for n in scalar] + [(n, "AGGREGATE", "") for n in sorted(AGGREGATES)] + [(n, "TABLE", "") for n in sorted(TABLE_FUNCTIONS)]
    return rows(graph, "name string, type string, signature string", data)


def files_of(graph) -> list[tuple[str, str, int]]:
    c = graph.catalog
    out = []
    for t in c.nodes.values():
        out.append(("node", t.name, len(t.df.inputFiles())))
    for r in c.rels.values():
        out.append(("rel", r.name, sum(len(df.inputFiles()) for df in r.parts.values())))
    return out


def project_graph(graph, name, nodes, rels):
    if name in graph.catalog.projected:
        raise QueryError(f"Projected graph {name} already exists.")
    graph.catalog.projected[name] = {"type": "NATIVE", "nodes": nodes, "rels": rels}
    return None


def project_graph_cypher(graph, name, query):
    graph.catalog.projected[name] = {"type": "CYPHER", "query": query}
    return None


def drop_projected_graph(graph, name):
    if graph.catalog.projected.pop(name, None) is None:
        raise QueryError(f"Projected graph {name} does not exist.")
    return None


def projected_graph_info(graph, name):
    p = graph.catalog.projected.get(name)
    if p is None:
        raise QueryError(f"Projected graph {name} does not exist.")
    if p["type"] == "CYPHER":
        return rows(graph, "`cypher statement` string", [(p["query"],)])
    data = [("NODE", n, str(f or "")) for n, f in p["nodes"].items()] + [("REL", n, str(f or "")) for n, f in p["rels"].items()]
    return rows(graph, "`table type` string, `table name` string, `predicate` string", data)


def show_warnings(graph):
    none = rows(graph, "query_id long, message string, file_path string, line_number long, skipped_line_or_record string", [])
    return reduce(DataFrame.unionByName, [df for _, df in graph.warnings], none)


def clear_warnings(graph):
    graph.warnings.clear()
    return None


def cache_column(graph, table, column):
    graph.catalog.node(table).df.select(f"`{column}`").persist()
    return None


def current_setting(graph, name):
    if name.lower() not in graph.settings:
        raise QueryError(f"Invalid option name: {name}.")
    return rows(graph, f"`{name}` string", [(str(graph.settings[name.lower()]),)])


TABLE_FUNCTIONS = {
    "CURRENT_SETTING": current_setting,
    "CATALOG_VERSION": lambda g: rows(g, "version long", [(g.catalog.version,)]),
    "DB_VERSION": lambda g: rows(g, "version string", [(VERSION,)]),
    "STORAGE_VERSION": lambda g: rows(g, "version long", [(1,)]),
    "SHOW_TABLES": show_tables,
    "SHOW_GRAPHS": lambda g: rows(g, "name string, type string", [(n, "GRAPH") for n in g.graphs]),
    "FSM_INFO": lambda g: rows(g, "start_page_idx long, num_pages long", []),
    "SHOW_WARNINGS": show_warnings,
    "TABLE_INFO": table_info,
    "SHOW_CONNECTION": show_connection,
    "STATS_INFO": stats_info,
    "STORAGE_INFO": storage_info,
    "SHOW_ATTACHED_DATABASES": lambda g: rows(g, "name string, `database type` string", [(n, k) for n, (k, _) in g.attached.items()]),
    "SHOW_SEQUENCES": lambda g: rows(g, "`name` string, `database name` string, `start value` long, `increment` long, `min value` long, `max value` long, `cycle` boolean", [(s.name, "local(tessera)", s.start, s.by, s.low, s.high, s.cycle) for s in g.catalog.sequences.values()]),
    "SHOW_FUNCTIONS": show_functions,
    "BM_INFO": lambda g: rows(g, "mem_limit long, mem_usage long", [(0, 0)]),
    "FILE_INFO": lambda g: rows(g, "category string, name string, num_files long", files_of(g)),
    "DISK_SIZE_INFO": lambda g: rows(g, "category string, name string, num_pages long, size_bytes long", [(k, n, f, None) for k, n, f in files_of(g)]),
    "SHOW_LOADED_EXTENSIONS": lambda g: rows(g, "`extension name` string, `extension source` string, `extension path` string", [(n, "OFFICIAL", "") for n in sorted(g.extensions)]),
    "SHOW_OFFICIAL_EXTENSIONS": lambda g: rows(g, "name string, description string", list(EXTENSIONS)),
    "SHOW_INDEXES": lambda g: rows(g, "table_name string, index_name string, index_type string, property_names array<string>, extension_loaded boolean, index_definition string", [(i["table"], n, i["kind"], i["columns"], True, "") for n, i in g.catalog.indexes.items()]),
    "SHOW_PROJECTED_GRAPHS": lambda g: rows(g, "name string, type string", [(n, p["type"]) for n, p in g.catalog.projected.items()]),
    "PROJECTED_GRAPH_INFO": projected_graph_info,
    "SHOW_MACROS": lambda g: rows(g, "name string, definition string", [(n, m[2]) for n, m in g.catalog.macros.items()]),
    "_CACHE_ARRAY_COLUMN_LOCALLY": cache_column,
    "CLEAR_WARNINGS": clear_warnings,
    "PROJECT_GRAPH": project_graph,
    "PROJECT_GRAPH_CYPHER": project_graph_cypher,
    "DROP_PROJECTED_GRAPH": drop_projected_graph,
}
TABLE_FUNCTIONS["DISK_INFO"] = TABLE_FUNCTIONS["DISK_SIZE_INFO"]
