"""Registered queries for the families of functions, table functions, files and
changes of tables, each over whole tables and with its SQL equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.materialize import remove_at_exit, shared_dir
from .session import Graph

# name: (graph query, SQL)
FAMILIES: dict[str, tuple[str, str]] = {
    "functions_trigonometry": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 100.0 AS x RETURN k, round(acos(x), 6) AS ac, round(asin(x), 6) AS asn, round(atan(x), 6) AS at, round(atan2(x, 2.0), 6) AS at2, round(cos(x), 6) AS c, round(sin(x), 6) AS s, round(tan(x), 6) AS t, round(cot(x), 6) AS ct, round(degrees(x), 6) AS dg, round(radians(x), 6) AS rd, round(pi(), 6) AS p",
        "SELECT p_partkey AS k, round(acos(x), 6) AS ac, round(asin(x), 6) AS asn, round(atan(x), 6) AS at, round(atan2(x, 2.0), 6) AS at2, round(cos(x), 6) AS c, round(sin(x), 6) AS s, round(tan(x), 6) AS t, round(cot(x), 6) AS ct, round(degrees(x), 6) AS dg, round(radians(x), 6) AS rd, round(pi(), 6) AS p FROM (SELECT p_partkey, p_size::DOUBLE / 100 AS x FROM part)",
    ),
    "functions_powers_and_bits": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS s RETURN k, round(cbrt(s), 6) AS cb, round(log2(s), 6) AS l2, round(log10(s), 6) AS l10, round(pow(s, 3), 3) AS pw, negate(s) AS ng, ceiling(s / 2.0) AS ce, factorial(s % 15) AS fa, round(gamma(s / 10.0), 4) AS ga, round(lgamma(s), 4) AS lg, bitwise_and(k, 12) AS ba, bitwise_or(k, 12) AS bo, bitshift_left(k, 3) AS bl, bitshift_right(k, 1) AS br, round(s, 1) AS rn",
        "SELECT p_partkey AS k, round(cbrt(p_size), 6) AS cb, round(log2(p_size), 6) AS l2, round(log10(p_size), 6) AS l10, round(pow(p_size, 3), 3) AS pw, -p_size AS ng, ceil(p_size / 2.0) AS ce, factorial(p_size % 15)::BIGINT AS fa, round(gamma(p_size / 10.0), 4) AS ga, round(lgamma(p_size), 4) AS lg, p_partkey & 12 AS ba, p_partkey | 12 AS bo, p_partkey << 3 AS bl, p_partkey >> 1 AS br, round(p_size::DOUBLE, 1) AS rn FROM part",
    ),
    "functions_string_case_and_trim": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_name AS s, c.c_mktsegment AS m RETURN k, lower(m) AS lo, tolower(m) AS tl, lcase(m) AS lc, ucase(s) AS uc, toupper(s) AS tu, trim(concat('  ', m, ' ')) AS tr, ltrim(concat('  ', m)) AS lt, rtrim(concat(m, '  ')) AS rt, repeat(left(m, 2), 3) AS rp, rpad(m, 14, '.') AS pd, substring(s, 3, 5) AS sb, concat_ws('-', m, s, 'x') AS cw",
        "SELECT c_custkey AS k, lower(c_mktsegment) AS lo, lower(c_mktsegment) AS tl, lower(c_mktsegment) AS lc, upper(c_name) AS uc, upper(c_name) AS tu, c_mktsegment AS tr, c_mktsegment AS lt, c_mktsegment AS rt, repeat(left(c_mktsegment, 2), 3) AS rp, rpad(c_mktsegment, 14, '.') AS pd, substr(c_name, 3, 5) AS sb, concat_ws('-', c_mktsegment, c_name, 'x') AS cw FROM customer",
    ),
    "functions_string_tests": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_mktsegment AS m RETURN k, array_extract(m, 2) AS second, contains(m, 'UIL') AS has, starts_with(m, 'BU') AS sw, prefix(m, 'A') AS pf, ends_with(m, 'NG') AS ew, suffix(m, 'E') AS sf, m ENDS WITH 'Y' AS op, regexp_full_match(m, '[A-M].*') AS fm, regexp_matches(m, 'O[A-Z]E') AS rm",
        "SELECT c_custkey AS k, substr(c_mktsegment, 2, 1) AS second, contains(c_mktsegment, 'UIL') AS has, starts_with(c_mktsegment, 'BU') AS sw, starts_with(c_mktsegment, 'A') AS pf, ends_with(c_mktsegment, 'NG') AS ew, ends_with(c_mktsegment, 'E') AS sf, ends_with(c_mktsegment, 'Y') AS op, regexp_full_match(c_mktsegment, '[A-M].*') AS fm, regexp_matches(c_mktsegment, 'O[A-Z]E') AS rm FROM customer",
    ),
    "functions_regexp_and_split": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_name AS s RETURN k, regexp_replace(s, '[0-9]$', 'X') AS last, regexp_replace(s, '0', 'o', 'g') AS every, regexp_replace(s, '([A-Za-z]+)#([0-9])', '\\\\2\\\\1') AS swapped, regexp_extract(s, '[1-9]+') AS ex, regexp_extract_all(s, '[1-9]') AS ea, regexp_split_to_array(s, '#') AS rs, string_split(s, '#') AS ss, str_split(s, '0') AS st, string_to_array(s, 'r') AS sa",
        "SELECT c_custkey AS k, regexp_replace(c_name, '[0-9]$', 'X') AS last, regexp_replace(c_name, '0', 'o', 'g') AS every, regexp_replace(c_name, '([A-Za-z]+)#([0-9])', '\\2\\1') AS swapped, regexp_extract(c_name, '[1-9]+') AS ex, regexp_extract_all(c_name, '[1-9]') AS ea, regexp_split_to_array(c_name, '#') AS rs, string_split(c_name, '#') AS ss, string_split(c_name, '0') AS st, string_split(c_name, 'r') AS sa FROM customer",
    ),
    "functions_vector_products": (
        "MATCH (v:Vec) WITH v.vec_id AS k, v.embedding AS e RETURN k, round(array_squared_distance(e, list_reverse(e)), 4) AS sd, round(array_dot_product(e, e), 4) AS dp, array_cross_product(array_value(1, k, 2), array_value(3, 1, k)) AS cp",
        "SELECT vec_id AS k, round(list_sum(list_transform(list_zip(e, list_reverse(e)), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 4) AS sd, round(list_inner_product(e, e), 4) AS dp, [vec_id * vec_id - 2, 6 - vec_id, 1 - 3 * vec_id] AS cp FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    ),
    "functions_list_making": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS s RETURN k, list_creation(s, 1) AS lc, list_concat([s], [k]) AS l1, list_cat([s], [k]) AS l2, array_concat([s], [k]) AS l3, array_cat([s], [k]) AS l4, list_append([s], 5) AS a1, array_append([s], 5) AS a2, array_push_back([s], 5) AS a3, list_prepend([s], 5) AS p1, array_prepend([s], 5) AS p2, array_push_front([s], 5) AS p3, list_slice([s, 4, k, 9], 2, 3) AS s1, array_slice([s, 4, k, 9], 1, 2) AS s2, list_reverse_sort([s, 4, 30]) AS rs, list_sort([s, 4, 30]) AS so",
        "SELECT p_partkey AS k, [s, 1] AS lc, [s, p_partkey] AS l1, [s, p_partkey] AS l2, [s, p_partkey] AS l3, [s, p_partkey] AS l4, [s, 5] AS a1, [s, 5] AS a2, [s, 5] AS a3, [5, s] AS p1, [5, s] AS p2, [5, s] AS p3, [4, p_partkey] AS s1, [s, 4] AS s2, list_reverse_sort([s, 4, 30]) AS rs, list_sort([s, 4, 30]) AS so FROM (SELECT p_partkey, p_size::BIGINT AS s FROM part)",
    ),
    "functions_list_tests": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 7, p.p_size % 7] AS l RETURN k, list_extract(l, 2) AS e1, list_element(l, -3) AS e2, list_indexof(l, 7) AS i1, array_position(l, 7) AS i2, array_indexof(l, 99) AS i3, list_has(l, 3) AS h1, array_contains(l, 3) AS h2, array_has(l, 7) AS h3, list_product(l) AS pr, list_any_value(l) AS av, none(x IN l WHERE x > 40) AS no, single(x IN l WHERE x = 7) AS si, list_has_all(l, [7, 3]) AS ha, list_unique(l) AS un",
        "SELECT p_partkey AS k, l[2] AS e1, l[1] AS e2, list_position(l, 7)::BIGINT AS i1, list_position(l, 7)::BIGINT AS i2, 0::BIGINT AS i3, list_contains(l, 3) AS h1, list_contains(l, 3) AS h2, true AS h3, list_product(l)::BIGINT AS pr, l[1] AS av, len(list_filter(l, lambda x: x > 40)) = 0 AS no, len(list_filter(l, lambda x: x = 7)) = 1 AS si, list_has_all(l, [7, 3]) AS ha, list_unique(l)::BIGINT AS un FROM (SELECT p_partkey, [p_size::BIGINT, 7, p_size % 7] AS l FROM part)",
    ),
    "functions_cast_numbers": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_nationkey AS n RETURN k, to_int64(n) AS a, to_int32(n) AS b, to_int8(n) AS c, to_uint64(n) AS d, to_uint32(n) AS e, to_uint16(n) AS f, to_uint8(n) AS g, to_float(n) AS h, to_bool(string(n > 5)) AS i, to_serial(n) AS j, string(n) AS s, string(to_int128(n)) AS t, string(to_uint128(n)) AS u",
        "SELECT c_custkey AS k, n::BIGINT AS a, n::INTEGER AS b, n::TINYINT AS c, n::BIGINT AS d, n::BIGINT AS e, n::INTEGER AS f, n::SMALLINT AS g, n::FLOAT AS h, n > 5 AS i, n::BIGINT AS j, n::VARCHAR AS s, n::VARCHAR AS t, n::VARCHAR AS u FROM (SELECT c_custkey, c_nationkey AS n FROM customer)",
    ),
    "functions_cast_others": (
        "MATCH (o:Orders) WITH o.o_orderkey AS k, o.o_orderdate AS t, string(CAST(o.o_orderdate AS DATE)) AS s RETURN k, to_date(s) AS a, date(s) AS b, timestamp(s) + to_interval('1 day') AS c, date(s) + duration('2 days') AS d, string(uuid('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11')) AS e, string(to_uuid('a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11')) AS f, octet_length(blob('a\\\\xAA')) AS g, octet_length(to_blob('abc')) AS h, size(string(gen_random_uuid())) AS u",
        "SELECT o_orderkey AS k, o_orderdate::DATE AS a, o_orderdate::DATE AS b, o_orderdate::DATE + INTERVAL 1 DAY AS c, (o_orderdate::DATE + 2)::DATE AS d, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS e, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS f, 2::BIGINT AS g, 3::BIGINT AS h, 36::BIGINT AS u FROM orders",
    ),
    "functions_comparison": (
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_nationkey AS n RETURN k, equals(n, 5) AS e, not_equals(n, 5) AS ne, greater_than(n, 5) AS g, greater_than_equals(n, 5) AS ge, less_than(n, 5) AS l, less_than_equals(n, 5) AS le, least(n, 5) AS least, random() < 1.0 AS r, CASE WHEN n < 0 THEN error('no') ELSE 'ok' END AS er, hash(n) = hash(n) AS h",
        "SELECT c_custkey AS k, n = 5 AS e, n <> 5 AS ne, n > 5 AS g, n >= 5 AS ge, n < 5 AS l, n <= 5 AS le, least(n, 5)::BIGINT AS least, true AS r, 'ok' AS er, true AS h FROM (SELECT c_custkey, c_nationkey AS n FROM customer)",
    ),
    "functions_date_making": (
        "MATCH (o:Orders) WITH o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_orderdate AS t RETURN k, datepart('quarter', d) AS q, datetrunc('year', d) AS y, least(d, date('1995-06-01')) AS le, make_date(date_part('year', d), 2, 3) AS md, epoch_ms(to_epoch_ms(t)) AS em, to_timestamp(k) AS ts, current_date() > d AS cd, current_timestamp() > t AS ct",
        "SELECT o_orderkey AS k, quarter(o_orderdate) AS q, date_trunc('year', o_orderdate)::DATE AS y, least(o_orderdate::DATE, DATE '1995-06-01') AS le, make_date(year(o_orderdate), 2, 3) AS md, o_orderdate AS em, epoch_ms(o_orderkey * 1000) AS ts, true AS cd, true AS ct FROM orders",
    ),
    "functions_interval_making": (
        "MATCH (o:Orders) WITH o.o_orderkey AS k, CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) AS t RETURN k, t + to_years(1) AS y, t + to_months(2) AS mo, t + to_days(3) AS d, t + to_hours(4) AS h, t + to_minutes(5) AS mi, t + to_seconds(6) AS s, t + to_milliseconds(7) AS ms, t + to_microseconds(8) AS us",
        "SELECT o_orderkey AS k, t + INTERVAL 1 YEAR AS y, t + INTERVAL 2 MONTH AS mo, t + INTERVAL 3 DAY AS d, t + INTERVAL 4 HOUR AS h, t + INTERVAL 5 MINUTE AS mi, t + INTERVAL 6 SECOND AS s, t + INTERVAL 7 MILLISECOND AS ms, t + INTERVAL 8 MICROSECOND AS us FROM (SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS t FROM orders)",
    ),
    "functions_struct_map_union": (
        "MATCH (n:Nation) WITH n.n_nationkey AS k, struct_pack(a := n.n_nationkey, b := n.n_name) AS s, map([1, 2], ['x', n.n_name]) AS m, union_value(num := n.n_regionkey) AS u RETURN k, s.a AS a, s.b AS b, keys(s) AS ks, element_at(m, 2) AS e, map_values(m) AS v, union_tag(u) AS t, union_extract(u, 'num') AS x",
        "SELECT n_nationkey AS k, n_nationkey AS a, n_name AS b, ['a', 'b'] AS ks, [n_name] AS e, ['x', n_name] AS v, 'num' AS t, n_regionkey AS x FROM nation",
    ),
    "functions_node_and_rel": (
        "MATCH (c:Customer)-[e:FROM_NATION]->(n:Nation) RETURN c.c_custkey AS k, offset(id(c)) AS o, offset(id(start_node(e))) AS s, offset(id(end_node(e))) AS d, labels(n) AS l, label(e) AS r, id(start_node(e)) = id(c) AS same",
        "SELECT c_custkey AS k, c_custkey AS o, c_custkey AS s, c_nationkey::BIGINT AS d, 'Nation' AS l, 'FROM_NATION' AS r, true AS same FROM customer",
    ),
    "functions_path": (
        "MATCH p = (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS k, size(rels(p)) AS a, size(relationships(p)) AS b, is_trail(p) AS t, is_acyclic(p) AS y, list_transform(rels(p), x -> x._LABEL) AS l, properties(nodes(p), 'n_name')[2] AS n",
        "SELECT c_custkey AS k, 2::BIGINT AS a, 2::BIGINT AS b, true AS t, true AS y, ['FROM_NATION', 'IN_REGION'] AS l, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "histogram_of_values": (
        "MATCH (p:Part) WITH p.p_brand AS brand, histogram(p.p_size, 1000000) AS h UNWIND map_keys(h) AS size RETURN brand, size, map_extract(h, size)[1] AS n",
        "SELECT p_brand AS brand, printf('%.1f-%.1f', p_size::DOUBLE, p_size::DOUBLE) AS size, count(*) AS n FROM part GROUP BY 1, 2",
    ),
    "aggregates_of_groups": (
        "MATCH (o:Orders) RETURN o.o_orderstatus AS status, min(o.o_orderkey) AS lo, count(DISTINCT o.o_custkey) AS customers",
        "SELECT o_orderstatus AS status, min(o_orderkey) AS lo, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    ),
    "node_label_filter": (
        "MATCH (a:Customer:Supplier)-[:FROM_NATION]->(n:Nation) MATCH (a:Supplier) RETURN n.n_name AS nation, count(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "count_long_chain": (
        "MATCH (:Region)<-[:IN_REGION]-(:Nation)<-[:FROM_NATION]-(c:Customer)-[:PLACED]->(:Orders)-[:HOLDS]->(:Part) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey",
    ),
    "count_wide_chain": (
        "MATCH (:Customer)-[:FROM_NATION]->(:Nation)<-[:FROM_NATION]-(:Customer) RETURN count(*) AS n",
        "SELECT sum(n * n)::BIGINT AS n FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)",
    ),
    "join_order_hint": (
        "MATCH (c:Customer)-[f:FROM_NATION]->(n:Nation)-[i:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' HINT ((r JOIN i) JOIN n) JOIN (f JOIN c) RETURN n.n_name AS nation, count(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
    ),
    "exists_mark_column": (
        "MATCH (c:Customer) RETURN EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 } AS rich, count(*) AS n",
        "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS rich, count(*) AS n FROM customer GROUP BY 1",
    ),
    "literal_rules": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:FROM_NATION]-(c:Customer) WHERE c.c_acctbal > 1000000 WITH n.n_nationkey AS k, collect(c.c_custkey) AS l RETURN k, size(l) AS none, k / 4 AS q, [1, 2, 3][2:9] AS s, 5 IN [1, NULL] AS i, range(3, 1) AS r, concat('a', NULL) AS c, log(100) AS lg",
        "SELECT n_nationkey AS k, NULL::BIGINT AS none, (n_nationkey // 4)::BIGINT AS q, [2, 3]::BIGINT[] AS s, false AS i, []::BIGINT[] AS r, 'a' AS c, 2.0::DOUBLE AS lg FROM nation",
    ),
    "unwind_drops_nothing_rows": (
        "MATCH (n:Nation) UNWIND CASE WHEN n.n_regionkey > 2 THEN [n.n_regionkey, 9] ELSE NULL END AS x RETURN n.n_name AS name, x",
        "SELECT n_name AS name, unnest([n_regionkey, 9]) AS x FROM nation WHERE n_regionkey > 2",
    ),
    "regexp_backslashes": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, regexp_extract(c.c_name, '\\\\d+') AS d, regexp_matches(c.c_name, '#0+\\\\d*1$') AS m",
        "SELECT c_custkey AS k, regexp_extract(c_name, '\\d+') AS d, regexp_matches(c_name, '#0+\\d*1$') AS m FROM customer",
    ),
    "no_such_rows": ("MATCH (c:Customer) WHERE false RETURN c.c_custkey AS k, c.c_name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE false"),
    "rel_property_rows": (
        "MATCH (o:Orders)-[l:HOLDS {l_returnflag: 'R'}]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n, round(sum(l.l_quantity), 1) AS q",
        "SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity), 1) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1",
    ),
}

KNOWS_FAMILIES: dict[str, tuple[str, str]] = {
    "walk_from_zero": (
        "MATCH (a:Customer)-[e:KNOWS*0..2]->(b:Customer) RETURN length(e) AS len, count(*) AS n",
        "SELECT len, count(*) AS n FROM (SELECT 0::BIGINT AS len FROM customer UNION ALL SELECT 1 FROM knows UNION ALL SELECT 2 FROM knows x JOIN knows y ON x.b = y.a) GROUP BY 1",
    ),
    "walk_undirected": (
        "MATCH (a:Customer)-[e:KNOWS*2..2]-(b:Customer) RETURN a.c_custkey AS a, count(*) AS n",
        "SELECT x.a AS a, count(*) AS n FROM both_ways x JOIN both_ways y ON x.b = y.a GROUP BY 1",
    ),
    "all_weighted_shortest": (
        "MATCH (a:Customer)-[e:KNOWS*ALL WSHORTEST(w) 1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, cost(e) AS cost, count(*) AS n",
        "SELECT a, b, cost::DOUBLE AS cost, count(*) AS n FROM walks JOIN (SELECT a, b, min(cost) AS cost FROM walks WHERE a <> b GROUP BY 1, 2) USING (a, b, cost) GROUP BY 1, 2, 3",
    ),
    "shortest_path_values": (
        "MATCH p = (a:Customer)-[e:KNOWS*SHORTEST 1..2]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, list_sum(properties(rels(e), 'w')) > 0 AS heavy, size(nodes(p)) AS k",
        "SELECT a, b, true AS heavy, min(len) + 1 AS k FROM (SELECT a, b, 1::BIGINT AS len FROM knows UNION ALL SELECT x.a, y.b, 2 FROM knows x JOIN knows y ON x.b = y.a) WHERE a <> b GROUP BY 1, 2",
    ),
    "recursive_projection": (
        "MATCH (a:Customer)-[e:KNOWS*2..2 (r, n | {r.w}, {n.c_name})]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, properties(rels(e), 'w') AS ws, properties(nodes(e), 'c_name') AS via",
        "SELECT x.a AS a, y.b AS b, [x.w, y.w] AS ws, [c_name] AS via FROM knows x JOIN knows y ON x.b = y.a JOIN customer ON c_custkey = x.b",
    ),
    "rel_parallel_directions": (
        "MATCH (a:Customer)-[e:KNOWS]->(b:Customer), (b)-[f:KNOWS]->(a) RETURN a.c_custkey AS a, b.c_custkey AS b, e.w + f.w AS w",
        "SELECT x.a AS a, x.b AS b, x.w + y.w AS w FROM knows x JOIN knows y ON x.a = y.b AND x.b = y.a",
    ),
}
WALKS = """both_ways AS (SELECT a, b FROM knows UNION ALL SELECT b, a FROM knows),
walks AS (SELECT a, b, w AS cost FROM knows UNION ALL SELECT x.a, y.b, x.w + y.w FROM knows x JOIN knows y ON x.b = y.a
    UNION ALL SELECT x.a, z.b, x.w + y.w + z.w FROM knows x JOIN knows y ON x.b = y.a JOIN knows z ON y.b = z.a)"""


# ------------------------------------------------------------- whole sessions


def session_of(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph of its own: nations as nodes, neighbours by key as relationships."""
    g = Graph(spark)
    g.add_object("nations", spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as long) as id", "n_name as name", "cast(n_regionkey as long) as region"))
    g.query("""
        CREATE NODE TABLE N(id INT64, name STRING, region INT64, PRIMARY KEY(id));
        CREATE REL TABLE NEXT(FROM N TO N, gap INT64);
        COPY N FROM nations;
        COPY NEXT FROM (MATCH (a:N), (b:N) WHERE a.id + 1 = b.id RETURN a.id, b.id, b.region - a.region)""")
    return g


def folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def altered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALTER in all its forms, COMMENT, DROP and a user-defined type."""
    g = session_of(spark, sf_dir)
    g.query("""
        CREATE TYPE score AS INT64;
        ALTER TABLE N ADD points score DEFAULT 7;
        ALTER TABLE N ADD gone STRING; ALTER TABLE N DROP gone;
        ALTER TABLE N RENAME region TO area;
        ALTER TABLE NEXT ADD kind STRING DEFAULT 'plain';
        COMMENT ON TABLE N IS 'nations';
        CREATE NODE TABLE Gone(id INT64, PRIMARY KEY(id)); DROP TABLE Gone; DROP TABLE IF EXISTS Gone;
        ALTER TABLE N RENAME TO Land""")
    return g.query("MATCH (a:Land)-[e:NEXT]->(b:Land) RETURN a.id AS id, a.area AS area, a.points AS points, e.kind AS kind, b.name AS next")


def relationship_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET and DELETE of relationships, by pattern and by property."""
    g = session_of(spark, sf_dir)
    g.query("MATCH (a:N)-[e:NEXT]->(b:N) WHERE e.gap = 0 SET e.gap = a.id * 10; MATCH (a:N)-[e:NEXT]->(:N) WHERE a.id % 5 = 0 DELETE e")
    return g.query("MATCH (a:N)-[e:NEXT]->(b:N) RETURN a.id AS a, b.id AS b, e.gap AS gap")


def sequence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = session_of(spark, sf_dir)
    g.query("CREATE SEQUENCE s START WITH 10 INCREMENT BY 5")
    rows = g.query("MATCH (a:N) RETURN a.name AS name, nextval('s') AS v")
    g.add_object("given", rows)
    return g.query("LOAD FROM given RETURN count(name) AS n, min(v) AS low, max(v) AS high, count(DISTINCT v) AS kinds, currval('s') AS now")


def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = session_of(spark, sf_dir)
    g.query("BEGIN TRANSACTION; MATCH (a:N) SET a.name = 'lost'; ROLLBACK; BEGIN TRANSACTION; MATCH (a:N) WHERE a.id = 3 SET a.name = 'kept'; COMMIT; CHECKPOINT")
    return g.query("MATCH (a:N) RETURN a.id AS id, a.name AS name")


def prepared_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = session_of(spark, sf_dir)
    ready = g.prepare("MATCH (a:N) WHERE a.region = $region AND a.name <> $other RETURN a.id AS id, a.name AS name, $region AS region")
    ready.execute(region=0, other="x")
    return ready.execute(region=2, other="CHINA")


def copies_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO CSV and Parquet, read back by COPY FROM and LOAD with options."""
    g, path = session_of(spark, sf_dir), folder(spark)
    g.query(f"""
        COPY (MATCH (a:N) RETURN a.id AS id, a.name AS name, [a.region, a.id] AS both) TO '{path}/n.csv' (HEADER=true, DELIM='|');
        COPY (MATCH (a:N) RETURN a.id AS id, a.name AS name) TO '{path}/n.parquet' (COMPRESSION='zstd');
        CREATE NODE TABLE Csv(id INT64, name STRING, `both` INT64[], PRIMARY KEY(id));
        COPY Csv FROM '{path}/n.csv' (HEADER=true, DELIM='|');
        CREATE NODE TABLE Par(id INT64, name STRING, PRIMARY KEY(id));
        COPY Par FROM '{path}/n.parquet'""")
    return g.query("MATCH (c:Csv), (p:Par) WHERE c.id = p.id RETURN c.id AS id, c.name AS a, p.name AS b, c.`both`[1] AS region")


def numpy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NumPy files, written through the file system of the shared folder."""
    import io

    import numpy as np

    g, path = session_of(spark, sf_dir), folder(spark)
    jvm = spark._jvm
    for name, data in (("id", np.arange(25)), ("v", np.arange(50, dtype="f8").reshape(25, 2))):
        buf = io.BytesIO()
        np.save(buf, data)
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.npy")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(buf.getvalue()))
        out.close()
    g.query(f"CREATE NODE TABLE V(id INT64, v DOUBLE[2], PRIMARY KEY(id)); COPY V FROM ('{path}/id.npy', '{path}/v.npy') BY COLUMN")
    return g.query("MATCH (a:N), (b:V) WHERE a.id = b.id RETURN a.name AS name, b.v[1] AS x, b.v[2] AS y")


def exported_and_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = session_of(spark, sf_dir), folder(spark)
    g.query(f"CREATE MACRO twice(x) AS x * 2; EXPORT DATABASE '{path}'")
    other = Graph(spark)
    other.query(f"ATTACH '{path}' AS side (DBTYPE parquet); USE side")
    return other.query("MATCH (a:N)-[e:NEXT]->(b:N) RETURN a.name AS a, twice(b.id) AS b, e.gap AS gap")


def graphs_of_their_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = session_of(spark, sf_dir)
    g.query("CREATE GRAPH side; USE GRAPH side; CREATE NODE TABLE N(id INT64, PRIMARY KEY(id)); UNWIND range(1, 4) AS x CREATE (:N {id: x}); USE GRAPH main")
    main = g.query("MATCH (a:N) RETURN 'main' AS graph, count(*) AS n")
    g.query("USE GRAPH side")
    return main.union(g.query("MATCH (a:N) RETURN 'side' AS graph, count(*) AS n"))


def listed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW_TABLES, TABLE_INFO, SHOW_CONNECTION, SHOW_SEQUENCES, SHOW_MACROS, SHOW_INDEXES, SHOW_GRAPHS."""
    g = session_of(spark, sf_dir)
    g.query("COMMENT ON TABLE N IS 'nations'; CREATE SEQUENCE s START WITH 4; CREATE MACRO twice(x) AS x * 2")
    parts = [
        "CALL show_tables() RETURN 'table' AS what, name AS a, type AS b, comment AS c",
        "CALL table_info('N') RETURN 'column' AS what, name AS a, type AS b, string(`primary key`) AS c",
        "CALL show_connection('NEXT') RETURN 'ends' AS what, `source table name` AS a, `destination table name` AS b, `source table primary key` AS c",
        "CALL show_sequences() RETURN 'sequence' AS what, name AS a, string(`start value`) AS b, string(`increment`) AS c",
        "CALL show_macros() RETURN 'macro' AS what, name AS a, definition AS b, '' AS c",
        "CALL show_graphs() RETURN 'graph' AS what, name AS a, type AS b, '' AS c",
        "CALL current_setting('recursive_pattern_semantic') RETURN 'setting' AS what, recursive_pattern_semantic AS a, '' AS b, '' AS c",
        "CALL show_functions() WHERE name IN ['LOWER', 'COLLECT', 'SHOW_TABLES'] RETURN 'function' AS what, name AS a, type AS b, '' AS c",
        "CALL stats_info('N') RETURN 'stats' AS what, string(cardinality) AS a, '' AS b, '' AS c",
    ]
    return g.query(" UNION ALL ".join(parts))


def projected_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = session_of(spark, sf_dir)
    g.query("CALL project_graph('P', ['N'], ['NEXT']); CALL project_graph('Q', ['N'], ['NEXT']); CALL drop_projected_graph('Q')")
    return g.query("CALL show_projected_graphs() RETURN 'graph' AS what, name AS a, type AS b UNION ALL CALL projected_graph_info('P') RETURN 'part' AS what, `table name` AS a, `table type` AS b")


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY with IGNORE_ERRORS: duplicate and null keys become warnings."""
    g = session_of(spark, sf_dir)
    g.add_object("again", spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("case when s_suppkey % 2 = 0 then cast(s_nationkey as long) end as id", "s_name as name", "cast(0 as long) as region"))
    g.query("COPY N FROM again (IGNORE_ERRORS=true)")
    return g.query("CALL show_warnings() RETURN message CONTAINS 'duplicated' AS twice, count(*) AS n")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function of the caller, then its removal."""

    @F.pandas_udf("long")
    def triple(x: pd.Series) -> pd.Series:
        return x * 3

    g = session_of(spark, sf_dir)
    g.add_function("triple", triple)
    out = g.query("MATCH (a:N) RETURN a.id AS id, triple(a.id) AS v")
    g.remove_function("triple")
    return out


def plans_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN gives a plan, PROFILE the rows as well."""
    g = session_of(spark, sf_dir)
    g.add_object("plan", g.query("EXPLAIN MATCH (a:N) RETURN a.id AS id"))
    g.add_object("profile", g.query("PROFILE MATCH (a:N) RETURN a.id AS id"))
    return g.query("LOAD FROM plan RETURN 'explain' AS what, `explain result` CONTAINS 'Scan' AS ok, 0 AS n UNION ALL LOAD FROM profile RETURN 'profile' AS what, `profile result` CONTAINS 'Scan' AS ok, rows AS n")


def more_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CALL functions whose values depend on the engine: that they answer, and how much."""
    g = session_of(spark, sf_dir)
    g.query("INSTALL json; LOAD json; CALL project_graph_cypher('P', 'MATCH (a:N) RETURN a'); ANALYZE; CALL clear_warnings()")
    parts = [
        "CALL db_version() RETURN 'db_version' AS what, size(version) > 0 AS ok",
        "CALL catalog_version() RETURN 'catalog_version' AS what, version > 0 AS ok",
        "CALL storage_version() RETURN 'storage_version' AS what, version > 0 AS ok",
        "CALL storage_info('N') RETURN 'storage_info' AS what, count(*) = 3 AS ok",
        "CALL show_attached_databases() RETURN concat('attached ', string(count(*))) AS what, count(*) = 0 AS ok",
        "CALL bm_info() RETURN 'bm_info' AS what, mem_limit >= 0 AS ok",
        "CALL fsm_info() RETURN concat('fsm_info ', string(count(*))) AS what, count(*) >= 0 AS ok",
        "CALL file_info() RETURN 'file_info' AS what, count(*) = 2 AS ok",
        "CALL disk_size_info() RETURN 'disk_size_info' AS what, count(*) = 2 AS ok",
        "CALL show_loaded_extensions() RETURN 'loaded' AS what, count(*) = 1 AS ok",
        "CALL show_official_extensions() RETURN 'official' AS what, count(*) > 0 AS ok",
        "CALL show_indexes() RETURN concat('indexes ', string(count(*))) AS what, count(*) = 0 AS ok",
        "CALL show_warnings() RETURN concat('warnings ', string(count(*))) AS what, count(*) = 0 AS ok",
        "CALL show_projected_graphs() RETURN 'projected' AS what, count(*) = 1 AS ok",
    ]
    return g.query(" UNION ALL ".join(parts))


def merged_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE of relationships: those that exist are set, the others created."""
    g = session_of(spark, sf_dir)
    g.query("MATCH (a:N), (b:N) WHERE a.id + 1 = b.id OR a.id = b.id + 20 MERGE (a)-[e:NEXT]->(b) ON MATCH SET e.gap = 100 ON CREATE SET e.gap = 200")
    return g.query("MATCH (a:N)-[e:NEXT]->(b:N) RETURN a.id AS a, b.id AS b, e.gap AS gap")


def more_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship table over several pairs of node tables, changed by ALTER."""
    g = session_of(spark, sf_dir)
    g.query("""
        CREATE NODE TABLE M(id INT64, PRIMARY KEY(id));
        MATCH (a:N) WITH DISTINCT a.region AS r CREATE (:M {id: r});
        ALTER TABLE NEXT ADD FROM N TO M;
        MATCH (a:N), (m:M) WHERE a.region = m.id CREATE (a)-[:NEXT {gap: -1}]->(m)""")
    return g.query("MATCH (a:N)-[e:NEXT]->(b) RETURN label(b) AS kind, count(*) AS n, min(e.gap) AS low")


def csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters inside quoted values, nulls and headers given by the query."""
    g, path = session_of(spark, sf_dir), folder(spark)
    g.query(f"COPY (MATCH (a:N) RETURN a.id AS id, concat(a.name, ';', a.region) AS name, CASE WHEN a.id % 2 = 0 THEN a.region END AS region) TO '{path}/n.csv' (HEADER=true, DELIM=';')")
    return g.query(f"LOAD WITH HEADERS (k INT64, what STRING, r INT64) FROM '{path}/n.csv' (HEADER=true, DELIM=';') RETURN k, what, r")


def loaded_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOAD FROM a DataFrame given as a parameter, joined with matched rows."""
    g = session_of(spark, sf_dir)
    given = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_nationkey as long) as nation", "s_acctbal as bal")
    return g.query("LOAD FROM $given WITH nation, count(*) AS n, round(sum(bal), 2) AS total MATCH (a:N) WHERE a.id = nation RETURN a.name AS name, n, total", given=given)


_N = "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation"
_NEXT = f"WITH n AS ({_N}), e AS (SELECT a.id AS a, b.id AS b, b.region - a.region AS gap FROM n a JOIN n b ON a.id + 1 = b.id)"
SESSIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "altered_tables": (altered_tables, f"{_NEXT} SELECT x.id, x.region AS area, 7::BIGINT AS points, 'plain' AS kind, y.name AS next FROM n x JOIN e ON e.a = x.id JOIN n y ON y.id = e.b"),
    "relationship_changes": (relationship_changes, f"{_NEXT} SELECT a, b, CASE WHEN gap = 0 THEN a * 10 ELSE gap END AS gap FROM e WHERE a % 5 <> 0"),
    "sequence_values": (sequence_values, "SELECT count(*) AS n, 10::BIGINT AS low, 5 + 5 * count(*) AS high, count(*) AS kinds, 5 + 5 * count(*) AS now FROM nation"),
    "transaction_rollback": (transaction_rollback, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 3 THEN 'kept' ELSE n_name END AS name FROM nation"),
    "prepared_parameters": (prepared_parameters, "SELECT n_nationkey::BIGINT AS id, n_name AS name, 2::BIGINT AS region FROM nation WHERE n_regionkey = 2 AND n_name <> 'CHINA'"),
    "copies_of_files": (copies_of_files, "SELECT n_nationkey::BIGINT AS id, n_name AS a, n_name AS b, n_regionkey::BIGINT AS region FROM nation"),
    "numpy_columns": (numpy_columns, "SELECT n_name AS name, 2.0::DOUBLE * n_nationkey AS x, 2.0::DOUBLE * n_nationkey + 1 AS y FROM nation"),
    "exported_and_attached": (exported_and_attached, f"{_NEXT} SELECT name AS a, 2 * b AS b, gap FROM e JOIN n ON id = a"),
    "graphs_of_their_own": (graphs_of_their_own, "SELECT 'main' AS graph, count(*) AS n FROM nation UNION ALL SELECT 'side', 4"),
    "listed_tables": (
        listed_tables,
        """SELECT * FROM (VALUES ('table', 'N', 'NODE', 'nations'), ('table', 'NEXT', 'REL', ''), ('column', 'id', 'INT64', 'True'), ('column', 'name', 'STRING', 'False'), ('column', 'region', 'INT64', 'False'), ('ends', 'N', 'N', 'id'),
        ('sequence', 's', '4', '1'), ('macro', 'twice', 'x * 2', ''), ('graph', 'main', 'GRAPH', ''), ('setting', 'WALK', '', ''), ('function', 'LOWER', 'SCALAR', ''), ('function', 'COLLECT', 'AGGREGATE', ''), ('function', 'SHOW_TABLES', 'TABLE', '')) AS t(what, a, b, c)
        UNION ALL SELECT 'stats', count(*)::VARCHAR, '', '' FROM nation""",
    ),
    "projected_graphs": (projected_graphs, "SELECT * FROM (VALUES ('graph', 'P', 'NATIVE'), ('part', 'N', 'NODE'), ('part', 'NEXT', 'REL')) AS t(what, a, b)"),
    "rejected_rows": (rejected_rows, "SELECT s_suppkey % 2 = 0 AS twice, count(*) AS n FROM supplier GROUP BY 1"),
    "user_function": (user_function, "SELECT n_nationkey::BIGINT AS id, 3 * n_nationkey::BIGINT AS v FROM nation"),
    "more_listings": (more_listings, "SELECT what, true AS ok FROM (SELECT unnest(['db_version', 'catalog_version', 'storage_version', 'storage_info', 'attached 0', 'bm_info', 'fsm_info 0', 'file_info', 'disk_size_info', 'loaded', 'official', 'indexes 0', 'warnings 0', 'projected']) AS what)"),
    "merged_relationships": (merged_relationships, f"{_NEXT} SELECT a, b, 100::BIGINT AS gap FROM e UNION ALL SELECT a.id, b.id, 200 FROM n a JOIN n b ON a.id = b.id + 20"),
    "more_ends": (more_ends, f"{_NEXT} SELECT 'N' AS kind, count(*) AS n, min(gap) AS low FROM e UNION ALL SELECT 'M', count(*), -1 FROM n"),
    "csv_options": (csv_options, "SELECT n_nationkey::BIGINT AS k, n_name || ';' || n_regionkey AS what, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::BIGINT END AS r FROM nation"),
    "loaded_parameters": (loaded_parameters, "SELECT n_name AS name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "plans_of_queries": (plans_of_queries, "SELECT 'explain' AS what, true AS ok, 0::BIGINT AS n UNION ALL SELECT 'profile', true, count(*) FROM nation"),
}
