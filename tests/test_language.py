"""Semantics of the language on small graphs made by statements."""

import datetime

import pytest

from tessera.plans.parser import QueryError
from tessera.session import Graph


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(g, text, **params):
    got = rows(g.query(text, **params))
    assert len(got) == 1
    return got[0] if len(got[0]) > 1 else got[0][0]


@pytest.fixture(scope="module")
def demo(spark):
    g = Graph(spark)
    g.query("""
        CREATE NODE TABLE User(name STRING, age INT64, PRIMARY KEY(name));
        CREATE NODE TABLE City(name STRING PRIMARY KEY, population INT64);
        CREATE REL TABLE Follows(FROM User TO User, since INT64);
        CREATE REL TABLE LivesIn(FROM User TO City);
        CREATE (:User {name: 'Adam', age: 30}), (:User {name: 'Karissa', age: 40}), (:User {name: 'Zhang', age: 50}), (:User {name: 'Noura', age: 25});
        CREATE (:City {name: 'Waterloo', population: 150000}), (:City {name: 'Guelph', population: 75000});
        UNWIND [{a: 'Adam', b: 'Karissa', y: 2020}, {a: 'Adam', b: 'Zhang', y: 2020}, {a: 'Karissa', b: 'Zhang', y: 2021}, {a: 'Zhang', b: 'Noura', y: 2022}] AS r
          MATCH (a:User {name: r.a}), (b:User {name: r.b}) CREATE (a)-[:Follows {since: r.y}]->(b);
        UNWIND [{a: 'Adam', c: 'Waterloo'}, {a: 'Noura', c: 'Guelph'}] AS r MATCH (a:User {name: r.a}), (c:City {name: r.c}) CREATE (a)-[:LivesIn]->(c)""")
    return g


@pytest.fixture
def g(spark):
    return Graph(spark)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("RETURN -2 ^ 2", 4.0),
        ("RETURN 7 / 2", 3),
        ("RETURN 1 IN [2, NULL]", False),
        ("RETURN range(3, 1)", []),
        ("RETURN range(1, 3)", [1, 2, 3]),
        ("RETURN [1, 2, 3, 4][2:3]", [2, 3]),
        ("RETURN [1, 2, 3][-1]", 3),
        ("RETURN log(100)", 2.0),
        ("RETURN initcap('hELLO wORLD')", "Hello world"),
        ("RETURN concat('a', NULL, 'b')", "ab"),
        ("RETURN 5 IS NULL OR true", True),
        ("RETURN NULL AND false", False),
        ("RETURN map_extract(map(['a'], [1]), 'b')", []),
        ("RETURN coalesce(NULL, 3)", 3),
        ("RETURN list_sort([3, NULL, 1])", [None, 1, 3]),
        ("RETURN list_transform([1, 2], x -> x * 10)", [10, 20]),
        ("RETURN single(x IN [1, 2, 3] WHERE x > 2)", True),
        ("RETURN none(x IN [1, 2, 3] WHERE x > 3)", True),
        ("RETURN CASE 3 WHEN 1 THEN 'a' WHEN 3 THEN 'c' END", "c"),
        ("RETURN 'abc' =~ 'a.c'", True),
        ("RETURN regexp_replace('aXbX', 'X', '-')", "a-bX"),
        ("RETURN struct_extract({a: 1, b: 'x'}, 'b')", "x"),
        ("RETURN date('2020-02-29') + interval('1 year')", datetime.date(2021, 2, 28)),
        ("RETURN date('2020-03-01') - date('2020-02-01')", 29),
        ("RETURN typeof([1])", "INT64[]"),
        ("RETURN CAST(2.5 AS INT64)", 2),
        ("RETURN 4!", 24),
        ("RETURN string_split('a.b.c', '.')", ["a", "b", "c"]),
        ("RETURN CAST([1, 2] AS STRING)", "[1,2]"),
    ],
)
def test_expressions(g, text, want):
    got = one(g, text + " AS x")
    assert got == want and isinstance(got, type(want))


@pytest.mark.parametrize("text", ["RETURN 1 != 2", "RETURN 1 < 2 < 3", "MATCH (a)-[e]->(b)-[e]->(c) RETURN a", "RETURN sum(count(*))", "RETURN nosuch(1)", "MATCH (a:User) RETURN a.none", "MATCH (a:Nobody) RETURN a", "RETURN 1 AS a, 2 AS a", "MATCH (a:User)-[e:Follows*2..1]->(b:User) RETURN e", "MATCH (a:User)-[e:Follows*1..99]->(b:User) RETURN e", "MATCH (a:User)-[e:Follows*SHORTEST 2..3]->(b:User) RETURN e"])
def test_refused_texts(demo, text):
    with pytest.raises(QueryError):
        demo.query(text)


@pytest.mark.parametrize("text", ["RETURN 1 / 0 AS x", "RETURN [1][0] AS x"])
def test_errors_at_run_time(g, text):
    with pytest.raises(Exception):  # noqa: B017, PT011
        g.query(text).collect()


def test_unwind_of_nothing_drops_rows(g):
    assert rows(g.query("UNWIND [] AS x RETURN x")) == []
    assert rows(g.query("UNWIND NULL AS x RETURN x")) == []


def test_matching_is_homomorphic(demo):
    assert one(demo, "MATCH (a:User)-[:Follows]-(b:User)-[:Follows]-(c:User) WHERE a.name = 'Adam' RETURN count(*) AS n") == 5
    assert one(demo, "MATCH (a:User)-[:Follows]-(b:User) RETURN count(*) AS n") == 8


def test_null_order_and_empty_collect(demo):
    got = rows(demo.query("MATCH (u:User) OPTIONAL MATCH (u)-[:LivesIn]->(c:City) RETURN u.name AS n, c.population AS p ORDER BY p DESC, n"))
    assert got == [("Karissa", None), ("Zhang", None), ("Adam", 150000), ("Noura", 75000)]
    assert one(demo, "MATCH (u:User {name: 'Zhang'}) OPTIONAL MATCH (u)-[:LivesIn]->(c:City) RETURN size(collect(c.name)) AS n") is None


def test_paths(demo):
    got = rows(demo.query("MATCH p = (a:User {name: 'Adam'})-[e:Follows*SHORTEST 1..5]->(b:User) RETURN b.name AS b, length(e) AS n, properties(nodes(p), 'name') AS via ORDER BY b"))
    assert [x[:2] for x in got] == [("Karissa", 1), ("Noura", 2), ("Zhang", 1)]
    assert next(x[2] for x in got if x[0] == "Noura") == ["Adam", "Zhang", "Noura"]
    assert one(demo, "MATCH (a:User {name: 'Adam'})-[e:Follows*0..0]->(b:User) RETURN b.name AS b") == "Adam"
    assert one(demo, "MATCH (a:User {name: 'Adam'})-[e:Follows*2..2]->(b:User) RETURN count(*) AS n") == 2


def test_parameters_and_prepared(demo):
    p = demo.prepare("MATCH (u:User) WHERE u.age > $low RETURN u.name AS n ORDER BY n LIMIT $k")
    assert rows(p.execute(low=29, k=2)) == [("Adam",), ("Karissa",)]
    assert rows(p.execute(low=45, k=2)) == [("Zhang",)]
    with pytest.raises(QueryError):
        demo.query("RETURN $gone AS x")


def test_percentile_is_an_element_of_its_type(g):
    assert one(g, "UNWIND [10, 20, 30, 40] AS x RETURN percentiledisc(x, 0.5) AS a, percentiledisc(x * 0.5, 0.75) AS b, percentilecont(x, 0.5) AS c") == (20, 15.0, 25.0)


def test_serial_keys_go_on_without_gaps(g, spark):
    g.query("CREATE NODE TABLE A(id SERIAL, v INT64, PRIMARY KEY(id))")
    g.add_object("many", spark.range(0, 1000, 1, 7).selectExpr("id as v"))
    g.query("COPY A FROM many")
    g.query("UNWIND [5, 6, 7] AS x CREATE (:A {v: x})")
    got = rows(g.query("MATCH (a:A) RETURN a.id AS id, a.v AS v ORDER BY id"))
    assert [i for i, _ in got] == list(range(1003))
    assert sorted(v for _, v in got[-3:]) == [5, 6, 7]


def test_keys_and_ends_are_checked(g, spark):
    g.query("CREATE NODE TABLE N(id INT64, PRIMARY KEY(id)); CREATE REL TABLE E(FROM N TO N, MANY_ONE); UNWIND [1, 2, 3] AS i CREATE (:N {id: i})")
    with pytest.raises(QueryError, match="duplicated primary key"):
        g.query("CREATE (:N {id: 2})")
    with pytest.raises(QueryError, match="NULL"):
        g.query("CREATE (:N {id: NULL})")
    g.query("MATCH (a:N {id: 1}), (b:N {id: 2}) CREATE (a)-[:E]->(b)")
    with pytest.raises(QueryError, match="multiplicity"):
        g.query("MATCH (a:N {id: 1}), (b:N {id: 3}) CREATE (a)-[:E]->(b)")
    with pytest.raises(QueryError, match="connected edges"):
        g.query("MATCH (a:N {id: 1}) DELETE a")
    g.add_object("bad", spark.createDataFrame([(1, 9)], "a long, b long"))
    with pytest.raises(QueryError, match="primary key value 9"):
        g.query("COPY E FROM bad")
    with pytest.raises(QueryError, match="referenced"):
        g.query("DROP TABLE N")
    g.query("MATCH (a:N {id: 1}) DETACH DELETE a")
    assert one(g, "MATCH (:N)-[e:E]->(:N) RETURN count(*) AS n") == 0


def test_merge_creates_once_per_key(g):
    g.query("CREATE NODE TABLE N(id INT64, seen INT64, PRIMARY KEY(id)); CREATE (:N {id: 1, seen: 0})")
    g.query("UNWIND [1, 2, 2, 3] AS x MERGE (n:N {id: x}) ON CREATE SET n.seen = 10 ON MATCH SET n.seen = 20")
    assert rows(g.query("MATCH (n:N) RETURN n.id AS id, n.seen AS s ORDER BY id")) == [(1, 20), (2, 20), (3, 10)]


def test_transactions(g):
    g.query("CREATE NODE TABLE N(id INT64, PRIMARY KEY(id)); CREATE (:N {id: 1})")
    g.query("BEGIN TRANSACTION; CREATE (:N {id: 2}); ROLLBACK")
    assert one(g, "MATCH (n:N) RETURN count(*) AS n") == 1
    g.query("BEGIN TRANSACTION; CREATE (:N {id: 2}); COMMIT")
    assert one(g, "MATCH (n:N) RETURN count(*) AS n") == 2
    with pytest.raises(QueryError):
        g.query("COMMIT")


def test_alter_and_listings(g):
    g.query("CREATE NODE TABLE N(id INT64, a STRING, PRIMARY KEY(id)); CREATE (:N {id: 1, a: 'x'}); ALTER TABLE N ADD b INT64 DEFAULT 7; ALTER TABLE N RENAME a TO c; COMMENT ON TABLE N IS 'note'")
    assert one(g, "MATCH (n:N) RETURN n.c AS c, n.b AS b") == ("x", 7)
    assert [r[1] for r in rows(g.query("CALL table_info('N') RETURN *"))] == ["id", "c", "b"]
    assert rows(g.query("CALL show_tables() WHERE type = 'NODE' RETURN name, comment")) == [("N", "note")]
    with pytest.raises(QueryError):
        g.query("ALTER TABLE N DROP id")
    g.query("ALTER TABLE N DROP c; ALTER TABLE N RENAME TO M; DROP TABLE M; DROP TABLE IF EXISTS M")
    with pytest.raises(QueryError):
        g.query("DROP TABLE M")


def test_sequences_types_macros(g):
    g.query("CREATE SEQUENCE s START 5 INCREMENT 2; CREATE TYPE big AS INT64; CREATE NODE TABLE N(id big, PRIMARY KEY(id)); CREATE MACRO plus(x, y:=1) AS x + y")
    assert [one(g, "RETURN nextval('s') AS x") for _ in range(2)] == [5, 7]
    assert one(g, "RETURN currval('s') AS x") == 7
    assert one(g, "RETURN plus(2) AS a, plus(2, y := 5) AS b") == (3, 7)


def test_files_round_trip(g, tmp_path):
    g.query("CREATE NODE TABLE N(id INT64, tags STRING[], x DOUBLE, PRIMARY KEY(id))")
    (tmp_path / "n.csv").write_text("id|tags|x\n1|[a,b]|0.5\n2|[]|\n3||2.5\n")
    g.query(f"COPY N FROM '{tmp_path}/n.csv' (HEADER=true, DELIM='|')")
    want = [(1, ["a", "b"], 0.5), (2, [], None), (3, None, 2.5)]
    text = "MATCH (n:N) RETURN n.id AS id, n.tags AS tags, n.x AS x ORDER BY id"
    assert rows(g.query(text)) == want
    g.query(f"COPY (MATCH (n:N) RETURN n.id AS id, n.tags AS tags, n.x AS x) TO '{tmp_path}/out.parquet' (COMPRESSION='zstd')")
    assert rows(g.query(f"LOAD FROM '{tmp_path}/out.parquet' RETURN id, tags, x ORDER BY id")) == want
    g.query(f"EXPORT DATABASE '{tmp_path}/db'")
    other = Graph(g.spark)
    other.query(f"IMPORT DATABASE '{tmp_path}/db'")
    assert rows(other.query(text)) == want


def test_csv_skips_rows_of_each_file(g, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i},{i}\n" for i in range(5)))
    got = rows(g.query(f"LOAD WITH HEADERS (k STRING, v INT64) FROM ['{tmp_path}/a.csv', '{tmp_path}/b.csv'] (SKIP=3, HEADER=false) RETURN k, v ORDER BY k"))
    assert got == [("a3", 3), ("a4", 4), ("b3", 3), ("b4", 4)]


def test_npy_by_column(g, tmp_path):
    import numpy as np

    np.save(tmp_path / "id.npy", np.arange(3))
    np.save(tmp_path / "v.npy", np.arange(6, dtype="f4").reshape(3, 2))
    g.query("CREATE NODE TABLE N(id INT64, v FLOAT[2], PRIMARY KEY(id))")
    g.query(f"COPY N FROM ('{tmp_path}/id.npy', '{tmp_path}/v.npy') BY COLUMN")
    assert rows(g.query("MATCH (n:N) RETURN n.id AS id, n.v AS v ORDER BY id")) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]


def test_functions_of_the_caller(g):
    g.add_function("twice", lambda x: x * 2, "INT64")
    assert one(g, "RETURN twice(4) AS x") == 8
    g.remove_function("twice")
    with pytest.raises(QueryError):
        g.query("RETURN twice(4) AS x")


def test_explain_and_profile(demo):
    assert "Scan" in one(demo, "EXPLAIN MATCH (u:User) RETURN u.name AS n")
    assert one(demo, "PROFILE MATCH (u:User) RETURN u.name AS n")[1] == 4


def test_projected_graphs(demo):
    demo.query("CALL project_graph('P', ['User'], ['Follows'])")
    assert rows(demo.query("CALL show_projected_graphs() RETURN name, type")) == [("P", "NATIVE")]
    demo.query("CALL drop_projected_graph('P')")
    with pytest.raises(QueryError):
        demo.query("CALL drop_projected_graph('P')")


def test_rejected_rows_are_warnings(g, tmp_path):
    g.query("CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P)")
    (tmp_path / "p.csv").write_text("10,Guodong\n24,Semih\n31,Xiyang\n10,Ziyi\n,Nobody\n")
    told = one(g, f"COPY P FROM '{tmp_path}/p.csv' (HEADER=false, IGNORE_ERRORS=true)")
    assert told.startswith("3 tuples have been copied to the P table. 2 warnings encountered during copy.")
    assert rows(g.query("MATCH (p:P) RETURN p.id AS id, p.name AS n ORDER BY id")) == [(10, "Guodong"), (24, "Semih"), (31, "Xiyang")]
    got = rows(g.query("CALL show_warnings() RETURN message, file_path, skipped_line_or_record"))
    assert ("Found duplicated primary key value 10, which violates the uniqueness constraint of the primary key column.", f"{tmp_path}/p.csv", "10,Ziyi") in got and len(got) == 2
    g.query("CALL clear_warnings()")
    (tmp_path / "k.csv").write_text("10,24\n10,99\n")
    assert one(g, f"COPY K FROM '{tmp_path}/k.csv' (HEADER=false, IGNORE_ERRORS=true)").startswith("1 tuples have been copied to the K table. 1 warnings")
    assert [r[1] for r in rows(g.query("CALL show_warnings() RETURN *"))] == ["Unable to find primary key value 99."]
    assert one(g, f"COPY P FROM '{tmp_path}/p.csv' (HEADER=false, IGNORE_ERRORS=true)").startswith("0 tuples")


def test_warnings_are_bounded(g, spark):
    g.query("CREATE NODE TABLE P(id INT64, PRIMARY KEY(id)); CALL warning_limit = 3")
    g.add_object("same", spark.range(0, 50, 1, 5).selectExpr("id % 2 as id"))
    assert one(g, "COPY P FROM same (IGNORE_ERRORS=true)").startswith("2 tuples have been copied to the P table. 48 warnings")
    assert len(rows(g.query("CALL show_warnings() RETURN *"))) == 3


def test_all_rejected_rows_are_warnings_where_no_limit_is_set(g, spark):
    """More than 8,192, which were kept before, of two copies."""
    g.query("CREATE NODE TABLE P(id INT64, PRIMARY KEY(id))")
    g.add_object("same", spark.range(0, 9000, 1, 4).selectExpr("case when id % 3 > 0 then id % 3 end as id"))
    for copied in (2, 0):
        told = one(g, "COPY P FROM same (IGNORE_ERRORS=true)")
        assert told.startswith(f"{copied} tuples have been copied to the P table. {9000 - copied} warnings")
    got = g.query("CALL show_warnings() RETURN query_id AS q, message CONTAINS 'value 1,' AS one, message CONTAINS 'NULL' AS none, count(*) AS n")
    assert sorted(rows(got)) == sorted([(1, False, True, 3000), (1, True, False, 2999), (1, False, False, 2999), (2, False, True, 3000), (2, True, False, 3000), (2, False, False, 3000)])
    g.query("CALL clear_warnings()")
    assert rows(g.query("CALL show_warnings() RETURN *")) == []
