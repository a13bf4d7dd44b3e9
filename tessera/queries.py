"""The registered queries: the star schema as a property graph, each query in the
graph language with its SQL equivalent over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .query_families import FAMILIES, KNOWS_FAMILIES, SESSIONS, WALKS
from .session import Graph


NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"), "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Vec": ("embeddings", "vec_id"), "User": ("events", "user_id")}
ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# name: (table, ends, source key, destination key, row id, properties), one entry a pair of ends
RELS = {
    "IN_REGION": [("nation", ("Nation", "Region"), "n_nationkey", "n_regionkey", None, [])],
    "FROM_NATION": [("customer", ("Customer", "Nation"), "c_custkey", "c_nationkey", None, []), ("supplier", ("Supplier", "Nation"), "s_suppkey", "s_nationkey", None, [])],
    "PLACED": [("orders", ("Customer", "Orders"), "o_custkey", "o_orderkey", "o_orderkey", [])],
    "HOLDS": [("lineitem", ("Orders", "Part"), "l_orderkey", "l_partkey", "_line", ITEM)],
    "SUPPLIED_BY": [("lineitem", ("Orders", "Supplier"), "l_orderkey", "l_suppkey", "_line", ITEM)],
    "DID": [("events", ("User", "Event"), "user_id", "event_id", "event_id", [])],
    "KNOWS": [("customer", ("Customer", "Customer"), "c_custkey", "to", None, ["w"])],
}


def knows_edges(customers: DataFrame) -> DataFrame:
    """A sparse directed graph over all customers: each knows the next one, one of
    the three after that, and every fourth one somebody far away."""
    n = customers.agg(F.count(F.lit(1)).alias("n"))  # a single row
    c = customers.select("c_custkey", "c_nationkey").crossJoin(F.broadcast(n))
    to = ["(c_custkey + 1) % n", "(c_custkey + 2 + c_nationkey % 3) % n", "if(c_custkey % 4 = 0, (c_custkey * 7 + c_nationkey) % n, null)"]
    c = c.select("c_custkey", F.explode(F.array(*map(F.expr, to))).alias("to")).where("to is not null")
    return c.select("c_custkey", "to", (F.col("c_custkey") % 5 + F.col("to") % 3 + 1).alias("w")).distinct()


def graph_of(spark: SparkSession, sf_dir: str, text: str | None = None) -> Graph:
    """Tables as nodes and foreign keys as relationships; no rows are read yet.

    Opening a file costs a read of its footer, so with ``text`` only the labels
    that the query names, and the ends of its relationships, are registered.
    """
    named = None if text is None else set(re.findall(r"\w+", text))
    rels = [r for r in RELS if named is None or r in named]
    ends = {x for r in rels for part in RELS[r] for x in part[1]}
    opened: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    g = Graph(spark)
    for label, (name, key) in NODES.items():
        if named is None or label in named or label in ends:
            g.add_nodes(label, t(name).select(key).distinct() if label == "User" else t(name), key)
    for r in rels:
        for name, pair, src, dst, rid, props in RELS[r]:
            df = knows_edges(t(name)) if r == "KNOWS" else t(name)
            df = df.withColumn("_line", F.col("l_orderkey") * 10 + F.col("l_linenumber")) if name == "lineitem" else df
            g.add_rels(r, df, pair, src, dst, rid=rid, props=props)
    g.query("CREATE MACRO revenue(price, discount, tax:=0.0) AS price * (1.0 - discount) * (1.0 + tax)")
    return g


KNOWS = """knows AS (SELECT DISTINCT c_custkey AS a, t AS b, c_custkey % 5 + t % 3 + 1 AS w FROM (
    SELECT c_custkey, unnest([(c_custkey + 1) % n, (c_custkey + 2 + c_nationkey % 3) % n, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey * 7 + c_nationkey) % n END]) AS t
    FROM customer, (SELECT count(*) AS n FROM customer)) WHERE t IS NOT NULL)"""

# name: (graph query, SQL or None)
PAIRS: dict[str, tuple[str, str | None]] = {
    "match_two_hop_agg": (
        "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.c_acctbal > 0 RETURN r.r_name AS region, count(*) AS n, round(avg(c.c_acctbal), 4) AS bal ORDER BY region",
        "SELECT r_name AS region, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY r_name",
    ),
    "match_revenue_by_nation": (
        "MATCH (n:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(o:Orders)-[l:HOLDS]->(p:Part) WHERE o.o_orderstatus = 'F' RETURN n.n_name AS nation, round(sum(revenue(l.l_extendedprice, l.l_discount)), 2) AS revenue, count(DISTINCT o) AS orders",
        "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY n_name",
    ),
    "aggregate_pricing_summary": (
        "MATCH (o:Orders)-[l:HOLDS]->(p) WHERE l.l_shipdate <= timestamp('1998-09-02') RETURN l.l_returnflag AS flag, l.l_linestatus AS status, round(sum(l.l_quantity), 2) AS qty, round(sum(l.l_extendedprice * (1.0 - l.l_discount) * (1.0 + l.l_tax)), 1) AS charge, round(avg(l.l_discount), 6) AS disc, min(l.l_tax) AS low, max(l.l_tax) AS high, count(*) AS n",
        "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS charge, round(avg(l_discount), 6) AS disc, min(l_tax) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "count_rel_table": ("MATCH (:Orders)-[e:HOLDS]->(:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem"),
    "count_extend_chain": ("MATCH (:Customer)-[:PLACED]->(:Orders)-[:SUPPLIED_BY]->(:Supplier) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "rel_degree_top": (
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS id, count(*) AS degree ORDER BY degree DESC, id LIMIT 10",
        "SELECT o_custkey AS id, count(*) AS degree FROM orders GROUP BY 1 ORDER BY degree DESC, id LIMIT 10",
    ),
    "count_anti_edge": (
        "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(c:Customer) WHERE id(a) <> id(c) AND NOT (a)-[:KNOWS]->(c) RETURN count(*) AS n",
        f"WITH {KNOWS} SELECT count(*) AS n FROM knows x JOIN knows y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM knows z WHERE z.a = x.a AND z.b = y.b)",
    ),
    "triangle_intersect": (
        "MATCH (a:Customer)-[:KNOWS]->(b:Customer)-[:KNOWS]->(c:Customer), (a)-[:KNOWS]->(c) RETURN a.c_custkey AS a, b.c_custkey AS b, c.c_custkey AS c",
        f"WITH {KNOWS} SELECT x.a AS a, x.b AS b, y.b AS c FROM knows x JOIN knows y ON x.b = y.a JOIN knows z ON z.a = x.a AND z.b = y.b",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS id, count(o) AS n, max(o.o_totalprice) AS top",
        "SELECT c_custkey AS id, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1",
    ),
    "exists_subquery": (
        "MATCH (p:Part) WHERE EXISTS { MATCH (o:Orders)-[l:HOLDS]->(p) WHERE l.l_quantity > 49 } RETURN p.p_brand AS brand, count(*) AS n",
        "SELECT p_brand AS brand, count(*) AS n FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) GROUP BY 1",
    ),
    "not_exists_pattern": (
        "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.c_mktsegment AS segment, count(*) AS n",
        "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
    ),
    "count_subquery": (
        "MATCH (s:Supplier) RETURN s.s_suppkey AS id, COUNT { MATCH (o:Orders)-[l:SUPPLIED_BY]->(s) WHERE l.l_returnflag = 'R' } AS n",
        "SELECT s_suppkey AS id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS n FROM supplier",
    ),
    "multi_label_node": (
        "MATCH (a:Customer:Supplier)-[:FROM_NATION]->(n:Nation) RETURN label(a) AS kind, n.n_name AS nation, count(*) AS n, round(sum(coalesce(a.c_acctbal, a.s_acctbal)), 2) AS bal",
        "SELECT kind, n_name AS nation, count(*) AS n, round(sum(bal), 2) AS bal FROM (SELECT 'Customer' AS kind, c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT 'Supplier', s_nationkey, s_acctbal FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1, 2",
    ),
    "undirected_match": (
        "MATCH (a:Customer)-[e:KNOWS]-(b:Customer) RETURN a.c_custkey AS id, count(*) AS n, sum(e.w) AS w",
        f"WITH {KNOWS} SELECT id, count(*) AS n, sum(w)::DECIMAL(38,0) AS w FROM (SELECT a AS id, w FROM knows UNION ALL SELECT b, w FROM knows) GROUP BY 1",
    ),
    "multi_rel_label": (
        "MATCH (o:Orders)-[e:HOLDS|SUPPLIED_BY]->(x) RETURN label(e) AS rel, label(x) AS kind, count(*) AS n",
        "SELECT rel, kind, count(*) AS n FROM (SELECT 'HOLDS' AS rel, 'Part' AS kind, l_orderkey FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', 'Supplier', l_orderkey FROM lineitem) GROUP BY 1, 2",
    ),
    "unwind_list": (
        "UNWIND [3, 1, 2] AS x UNWIND range(1, x) AS y RETURN x, collect(y) AS ys, sum(y) AS s",
        "SELECT x, range(1, x + 1) AS ys, (x * (x + 1) // 2)::DECIMAL(38,0) AS s FROM (SELECT unnest([3, 1, 2])::BIGINT AS x)",
    ),
    "with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(*) AS n, sum(o.o_totalprice) AS total WHERE n >= 15 RETURN c.c_name AS name, n, round(total, 2) AS total",
        "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) >= 15",
    ),
    "distinct_order_skip_limit": (
        "MATCH (p:Part) RETURN DISTINCT p.p_type AS kind, p.p_size AS size ORDER BY size DESC, kind SKIP 5 LIMIT 20",
        "SELECT DISTINCT p_type AS kind, p_size AS size FROM part ORDER BY size DESC, kind LIMIT 20 OFFSET 5",
    ),
    "order_by_nulls": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 WITH c.c_custkey AS id, max(o.o_totalprice) AS top RETURN id, top ORDER BY top, id LIMIT 30",
        "SELECT c_custkey AS id, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1 ORDER BY top NULLS LAST, id LIMIT 30",
    ),
    "union_distinct": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "union_all": (
        "MATCH (n:Nation) RETURN n.n_name AS name UNION ALL MATCH (r:Region) RETURN r.r_name AS name",
        "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    ),
    "case_expression": (
        "MATCH (o:Orders) RETURN CASE WHEN o.o_totalprice > 250000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o.o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done, count(*) AS n",
        "SELECT CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, (CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END)::BIGINT AS done, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "cross_product_filter": (
        "MATCH (r:Region), (n:Nation) WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey > 3 RETURN r.r_name AS r, n.n_name AS n",
        "SELECT r_name AS r, n_name AS n FROM region, nation WHERE r_regionkey = n_regionkey AND n_nationkey > 3",
    ),
    "collect_and_list": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS region, list_sort(collect(n.n_name)) AS names RETURN region, size(names) AS n, list_to_string('|', names) AS joined, names[1] AS first, list_contains(names, 'FRANCE') AS france",
        "SELECT r_name AS region, count(*) AS n, string_agg(n_name, '|' ORDER BY n_name) AS joined, min(n_name) AS first, bool_or(n_name = 'FRANCE') AS france FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "percentiles": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS segment, percentilecont(c.c_acctbal, 0.5) AS median, percentiledisc(c.c_acctbal, 0.25) AS q1",
        "SELECT c_mktsegment AS segment, quantile_cont(c_acctbal, 0.5) AS median, quantile_disc(c_acctbal, 0.25) AS q1 FROM customer GROUP BY 1",
    ),
    "sum_is_wide": ("MATCH (p:Part) RETURN sum(p.p_size) AS s, avg(p.p_size) AS a, count(DISTINCT p.p_brand) AS b", "SELECT sum(p_size)::DECIMAL(38,0) AS s, avg(p_size) AS a, count(DISTINCT p_brand) AS b FROM part"),
    "functions_math": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_retailprice AS x, p.p_size AS s RETURN k, s / 7 AS q, s % 7 AS m, abs(-x) AS a, floor(x) AS f, ceil(x) AS c, round(sqrt(x), 6) AS sq, round(ln(x), 6) AS l, round(log(x), 6) AS lg, sign(x - 1000.0) AS sg, bitwise_xor(k, 5) AS bx, k & 6 AS ba, k << 2 AS sh, even(x) AS ev, round(s ^ 2, 3) AS pw",
        "SELECT p_partkey AS k, (p_size // 7)::BIGINT AS q, (p_size % 7)::BIGINT AS m, abs(-p_retailprice) AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_retailprice), 6) AS sq, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS lg, sign(p_retailprice - 1000)::BIGINT AS sg, xor(p_partkey, 5) AS bx, p_partkey & 6 AS ba, p_partkey << 2 AS sh, even(p_retailprice) AS ev, round(pow(p_size, 2), 3) AS pw FROM part",
    ),
    "functions_string": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_name AS s, p.p_brand AS b RETURN k, upper(s) AS u, initcap(s) AS ic, left(s, 3) AS l3, right(s, -2) AS r2, substr(s, 2, 4) AS sub, reverse(b) AS rev, lpad(b, 12, '*') AS lp, replace(b, '#', '-') AS rp, s STARTS WITH 'a' AS st, s CONTAINS 'e' AS ce, split_part(s, ' ', 1) AS sp, size(s) AS len, levenshtein(b, 'Brand#11') AS lev, concat(b, NULL, '/', s) AS cc, md5(b) AS h, s =~ '.*o.*' AS full, regexp_replace(b, '[0-9]', 'x') AS rr",
        "SELECT p_partkey AS k, upper(p_name) AS u, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS ic, left(p_name, 3) AS l3, right(p_name, greatest(length(p_name) - 2, 0)) AS r2, substr(p_name, 2, 4) AS sub, reverse(p_brand) AS rev, lpad(p_brand, 12, '*') AS lp, replace(p_brand, '#', '-') AS rp, starts_with(p_name, 'a') AS st, contains(p_name, 'e') AS ce, split_part(p_name, ' ', 1) AS sp, length(p_name) AS len, levenshtein(p_brand, 'Brand#11') AS lev, concat(p_brand, NULL, '/', p_name) AS cc, md5(p_brand) AS h, regexp_full_match(p_name, '.*o.*') AS full, regexp_replace(p_brand, '[0-9]', 'x') AS rr FROM part",
    ),
    "functions_date": (
        "MATCH (o:Orders) WITH o.o_orderkey AS k, o.o_orderdate AS t, CAST(o.o_orderdate AS DATE) AS d RETURN k, date_part('year', d) AS y, date_part('month', d) AS m, date_part('dow', d) AS dow, date_part('week', d) AS w, date_trunc('month', d) AS tr, dayname(d) AS dn, monthname(d) AS mn, last_day(d) AS ld, d + 10 AS plus, d - date('1992-01-01') AS gap, century(t) AS c, to_epoch_ms(t) AS ms, d + interval('1 month') AS nm",
        "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) AS dow, weekofyear(o_orderdate) AS w, date_trunc('month', o_orderdate)::DATE AS tr, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, last_day(o_orderdate) AS ld, (o_orderdate::DATE + 10)::DATE AS plus, (o_orderdate::DATE - DATE '1992-01-01')::BIGINT AS gap, century(o_orderdate) AS c, epoch_ms(o_orderdate) AS ms, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS nm FROM orders",
    ),
    "time_bucket_events": (
        "MATCH (e:Event) RETURN time_bucket(interval('1 day'), e.ts) AS day, e.event_type AS kind, count(*) AS n, round(sum(e.value), 4) AS v",
        "SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    ),
    "functions_list": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 5, p.p_size % 7] AS l RETURN k, list_sum(l) AS s, list_distinct(l)[1] AS d1, list_position(l, 5) AS pos, list_transform(l, x -> x * 2) AS dbl, list_filter(l, x -> x > 5) AS big, list_reduce(l, (a, b) -> a + b) AS red, list_reverse(l) AS rev, l[1:2] AS head, any(x IN l WHERE x = 5) AS has5, all(x IN l WHERE x >= 0) AS pos0, list_unique(l) AS u, size(l) AS n",
        "SELECT p_partkey AS k, list_sum(l)::BIGINT AS s, l[1] AS d1, list_position(l, 5)::BIGINT AS pos, list_transform(l, lambda x: x * 2) AS dbl, list_filter(l, lambda x: x > 5) AS big, list_sum(l)::BIGINT AS red, list_reverse(l) AS rev, l[1:2] AS head, true AS has5, true AS pos0, list_unique(l)::BIGINT AS u, 3::BIGINT AS n FROM (SELECT p_partkey, [p_size::BIGINT, 5, p_size % 7] AS l FROM part)",
    ),
    "functions_vector": (
        "MATCH (v:Vec), (q:Vec) WHERE q.vec_id = 0 AND v.vec_id <> 0 RETURN v.vec_id AS id, round(array_distance(v.embedding, q.embedding), 5) AS d, round(array_cosine_similarity(v.embedding, q.embedding), 5) AS c, round(array_inner_product(v.embedding, q.embedding), 5) AS ip ORDER BY d, id LIMIT 10",
        "SELECT v.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2])))), 5) AS d, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS c, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS ip FROM embeddings v, embeddings q WHERE q.vec_id = 0 AND v.vec_id <> 0 ORDER BY d, id LIMIT 10",
    ),
    "functions_struct_map": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, {name: n.n_name, region: n.n_regionkey} AS s, map(['a', 'b'], [n.n_nationkey, 7]) AS m RETURN k, s.name AS name, struct_extract(s, 'region') AS region, map_extract(m, 'a') AS a, cardinality(m) AS n, map_keys(m) AS keys, typeof(s) AS t",
        "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, [n_nationkey::BIGINT] AS a, 2::BIGINT AS n, ['a', 'b'] AS keys, 'STRUCT(name STRING, region INT32)' AS t FROM nation",
    ),
    "functions_cast": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, CAST(c.c_acctbal AS INT64) AS i, to_string(c.c_nationkey) AS s, to_int16(c.c_nationkey) AS sm, CAST('2020-01-02' AS DATE) AS d, to_double(c.c_custkey) AS f, CAST(c.c_acctbal > 0 AS STRING) AS b",
        "SELECT c_custkey AS k, round_even(c_acctbal, 0)::BIGINT AS i, c_nationkey::VARCHAR AS s, c_nationkey::SMALLINT AS sm, DATE '2020-01-02' AS d, c_custkey::DOUBLE AS f, CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS b FROM customer",
    ),
    "functions_utility": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, coalesce(NULL, c.c_name) AS n, ifnull(NULL, 1) AS i, nullif(c.c_nationkey, 3) AS z, count_if(c.c_nationkey) AS ci, constant_or_null(1, NULL) AS con, greatest(c.c_nationkey, 5) AS g, c.c_nationkey IN [1, 2, NULL] AS inl, sha256(c.c_name) AS h",
        "SELECT c_custkey AS k, c_name AS n, 1::BIGINT AS i, nullif(c_nationkey, 3) AS z, (c_nationkey <> 0)::SMALLINT AS ci, NULL::BIGINT AS con, greatest(c_nationkey, 5)::BIGINT AS g, c_nationkey IN (1, 2) AS inl, sha256(c_name) AS h FROM customer",
    ),
    "walk_fixed_length": (
        "MATCH (a:Customer)-[e:KNOWS*2..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, length(e) AS len, count(*) AS n",
        f"WITH {KNOWS} SELECT a, b, len, count(*) AS n FROM (SELECT x.a, y.b, 2::BIGINT AS len FROM knows x JOIN knows y ON x.b = y.a UNION ALL SELECT x.a, z.b, 3 FROM knows x JOIN knows y ON x.b = y.a JOIN knows z ON y.b = z.a) GROUP BY 1, 2, 3",
    ),
    "trail_paths": (
        "MATCH (a:Customer)-[e:KNOWS*TRAIL 1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, length(e) AS len, count(*) AS n",
        f"WITH {KNOWS} SELECT a, b, len, count(*) AS n FROM (SELECT a, b, 1::BIGINT AS len FROM knows UNION ALL SELECT x.a, y.b, 2 FROM knows x JOIN knows y ON x.b = y.a WHERE (x.a, x.b) <> (y.a, y.b) UNION ALL SELECT x.a, z.b, 3 FROM knows x JOIN knows y ON x.b = y.a JOIN knows z ON y.b = z.a WHERE (x.a, x.b) <> (y.a, y.b) AND (y.a, y.b) <> (z.a, z.b) AND (x.a, x.b) <> (z.a, z.b)) GROUP BY 1, 2, 3",
    ),
    "acyclic_paths": (
        "MATCH (a:Customer)-[e:KNOWS*ACYCLIC 3..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n",
        f"WITH {KNOWS} SELECT x.a AS a, z.b AS b, count(*) AS n FROM knows x JOIN knows y ON x.b = y.a JOIN knows z ON y.b = z.a WHERE x.b <> y.b GROUP BY 1, 2",
    ),
    "shortest_path_length": (
        "MATCH (a:Customer)-[e:KNOWS*SHORTEST 1..6]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, length(e) AS len",
        f"WITH RECURSIVE {KNOWS}, walk(a, b, len) AS (SELECT a, b, 1::BIGINT FROM knows UNION SELECT walk.a, k.b, len + 1 FROM walk JOIN knows k ON walk.b = k.a WHERE len < 6) SELECT a, b, min(len) AS len FROM walk WHERE a <> b GROUP BY 1, 2",
    ),
    "all_shortest_count": (
        "MATCH (a:Customer)-[e:KNOWS*ALL SHORTEST 1..6]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, length(e) AS len, count(*) AS n",
        f"WITH RECURSIVE {KNOWS}, walk(a, b, len, n) AS (SELECT a, b, 1::BIGINT, 1::BIGINT FROM knows UNION ALL SELECT walk.a, k.b, len + 1, sum(n)::BIGINT FROM walk JOIN knows k ON walk.b = k.a WHERE len < 6 GROUP BY 1, 2, 3), best AS (SELECT a, b, min(len) AS len FROM walk GROUP BY 1, 2) SELECT walk.a, walk.b, walk.len, sum(n)::BIGINT AS n FROM walk JOIN best USING (a, b, len) WHERE walk.a <> walk.b GROUP BY 1, 2, 3",
    ),
    "weighted_shortest_cost": (
        "MATCH (a:Customer)-[e:KNOWS*WSHORTEST(w) 1..8]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, cost(e) AS cost",
        f"WITH RECURSIVE {KNOWS}, walk(a, b, len, cost) AS (SELECT a, b, 1, w::DOUBLE FROM knows UNION ALL SELECT walk.a, k.b, len + 1, min(cost + k.w) FROM walk JOIN knows k ON walk.b = k.a WHERE len < 8 GROUP BY 1, 2, 3) SELECT a, b, min(cost) AS cost FROM walk WHERE a <> b GROUP BY 1, 2",
    ),
    "recursive_filter": (
        "MATCH (a:Customer)-[e:KNOWS*1..2 (r, n | WHERE r.w > 3 AND n.c_acctbal > 0)]->(b:Customer) RETURN length(e) AS len, count(*) AS n",
        f"WITH {KNOWS}, big AS (SELECT * FROM knows WHERE w > 3) SELECT len, count(*) AS n FROM (SELECT 1::BIGINT AS len FROM big UNION ALL SELECT 2 FROM big x JOIN customer ON c_custkey = x.b AND c_acctbal > 0 JOIN big y ON x.b = y.a) GROUP BY 1",
    ),
    "path_nodes": (
        "MATCH p = (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS id, length(p) AS len, size(nodes(p)) AS k, list_to_string('>', list_transform(nodes(p), x -> x._LABEL)) AS labels",
        "SELECT c_custkey AS id, 2::BIGINT AS len, 3::BIGINT AS k, 'Customer>Nation>Region' AS labels FROM customer",
    ),
    "reachable_count": (
        "MATCH (a:Customer {c_custkey: 1})-[:KNOWS*SHORTEST 1..30]->(b:Customer) RETURN count(DISTINCT b) AS n",
        f"WITH RECURSIVE {KNOWS}, reach(b, len) AS (SELECT b, 1 FROM knows WHERE a = 1 UNION SELECT k.b, len + 1 FROM reach JOIN knows k ON reach.b = k.a WHERE len < 30) SELECT count(DISTINCT b) AS n FROM reach WHERE b <> 1",
    ),
    "primary_key_lookup": ("MATCH (o:Orders {o_orderkey: 7})<-[:PLACED]-(c:Customer) RETURN c.c_name AS name, o.o_totalprice AS price", "SELECT c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 7"),
    "generic_join": (
        "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND s.s_acctbal > c.c_acctbal RETURN c.c_nationkey AS k, count(*) AS n",
        "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > c_acctbal GROUP BY 1",
    ),
    "load_from_parquet": ("LOAD FROM '{sf}/part.parquet' WHERE p_size > 40 RETURN p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1"),
    "blob_functions": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, octet_length(encode(n.n_name)) AS n, decode(encode(n.n_name)) AS s", "SELECT n_nationkey AS k, strlen(n_name) AS n, n_name AS s FROM nation"),
    "boolean_logic": (
        "MATCH (c:Customer) RETURN c.c_acctbal > 0 XOR c.c_nationkey > 10 AS x, NOT (c.c_acctbal > 0 OR c.c_nationkey IS NULL) AS y, c.c_name IS NOT NULL AS z, count(*) AS n",
        "SELECT (c_acctbal > 0) <> (c_nationkey > 10) AS x, NOT (c_acctbal > 0 OR c_nationkey IS NULL) AS y, c_name IS NOT NULL AS z, count(*) AS n FROM customer GROUP BY 1, 2, 3",
    ),
    "document_labels": ("MATCH (d:Document) RETURN d.lang AS lang, count(*) AS n, sum(size(d.text)) AS chars, max(octet_length(encode(d.text))) AS top", "SELECT lang, count(*) AS n, sum(length(text))::DECIMAL(38,0) AS chars, max(strlen(text)) AS top FROM documents GROUP BY 1"),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = PAIRS[name][0].replace("{sf}", sf_dir)
    return graph_of(spark, sf_dir, text).query(text)


def changed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL, COPY, CREATE, MERGE, SET and DELETE on a graph of its own."""
    g = Graph(spark)
    g.add_object("nations", spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as id", "n_name as name", "n_regionkey as region"))
    g.query("""
        CREATE NODE TABLE N(id INT64, name STRING, region INT64, note STRING DEFAULT 'none', PRIMARY KEY(id));
        CREATE REL TABLE NEXT(FROM N TO N, gap INT64);
        COPY N(id, name, region) FROM nations;
        COPY NEXT FROM (MATCH (a:N), (b:N) WHERE a.id + 1 = b.id RETURN a.id, b.id, b.region - a.region);
        MATCH (a:N) WHERE a.id < 5 SET a.note = concat('low', a.id);
        MERGE (a:N {id: 100}) ON CREATE SET a.name = 'new', a.region = 0;
        MERGE (a:N {id: 3}) ON MATCH SET a.region = 9;
        MATCH (a:N {id: 7}) DETACH DELETE a""")
    return g.query("MATCH (a:N) OPTIONAL MATCH (a)-[e:NEXT]->(b:N) RETURN a.id AS id, a.name AS name, a.region AS region, a.note AS note, b.id AS next, e.gap AS gap")


CHANGED_SQL = """
    WITH n AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation),
    e AS (SELECT a.id AS a, b.id AS b, b.region - a.region AS gap FROM n a JOIN n b ON a.id + 1 = b.id WHERE a.id <> 7 AND b.id <> 7),
    m AS (SELECT id, name, CASE WHEN id = 3 THEN 9 ELSE region END AS region, CASE WHEN id < 5 THEN 'low' || id ELSE 'none' END AS note FROM n WHERE id <> 7 UNION ALL SELECT 100, 'new', 0, 'none')
    SELECT id, name, region, note, e.b AS next, gap FROM m LEFT JOIN e ON e.a = m.id"""

PAIRS |= FAMILIES | {name: (text, f"WITH {KNOWS}, {WALKS} {sql}") for name, (text, sql) in KNOWS_FAMILIES.items()}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run, name) for name in PAIRS} | {"changed_graph": changed_graph} | {name: f for name, (f, _) in SESSIONS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in PAIRS.items() if sql} | {"changed_graph": CHANGED_SQL} | {name: sql for name, (_, sql) in SESSIONS.items()}
