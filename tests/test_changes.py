"""Sequences, replacements, ties of SET, attached databases and exports."""

import pytest

from tessera.plans.parser import QueryError
from tessera.session import Graph


@pytest.fixture
def g(spark):
    return Graph(spark)


def one(g, text):
    r = g.query(text).collect()
    assert len(r) == 1
    return r[0][0] if len(r[0]) == 1 else tuple(r[0])


def test_nextval_gives_every_row_its_own_value(g):
    g.query("CREATE SEQUENCE s")
    assert sorted(r[0] for r in g.query("UNWIND [1,2,3] AS x RETURN nextval('s') AS v").collect()) == [1, 2, 3]
    assert one(g, "RETURN currval('s') AS v") == 3
    assert one(g, "RETURN nextval('s') AS v") == 4
    g.query("CREATE SEQUENCE d START WITH 10 INCREMENT BY -3 MINVALUE 1 MAXVALUE 10 CYCLE")
    assert sorted(r[0] for r in g.query("UNWIND range(1, 6) AS x RETURN nextval('d') AS v").collect()) == sorted([10, 7, 4, 1, 10, 7])
    g.query("CREATE SEQUENCE low MAXVALUE 2")
    with pytest.raises(QueryError):
        g.query("UNWIND [1,2,3] AS x RETURN nextval('low') AS v")


def test_nextval_as_a_property(g):
    g.query("CREATE SEQUENCE s START WITH 5; CREATE NODE TABLE N(id INT64, v INT64, PRIMARY KEY(id)); UNWIND [7, 8] AS x CREATE (:N {id: nextval('s'), v: x})")
    assert sorted(map(tuple, g.query("MATCH (n:N) RETURN n.id AS id").collect())) == [(5,), (6,)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("regexp_replace('cat concat', 'cat$', 'X')", "cat conX"),
        ("regexp_replace('aXbX', 'X', '-')", "a-bX"),
        ("regexp_replace('aXbX', 'X', '-', 'g')", "a-b-"),
        ("regexp_replace('abc', 'x*', '-')", "-abc"),
        (r"regexp_replace('john smith', '(\\w+) (\\w+)', '\\2 \\1')", "smith john"),
        (r"regexp_replace('abab cc', '(.)\\1', '<\\1>')", "abab <c>"),
        ("regexp_replace('line\nend', 'end', 'E')", "line\nE"),
        ("regexp_replace('abc', 'q', 'E')", "abc"),
    ],
)
def test_regexp_replace(g, text, want):
    assert one(g, f"RETURN {text} AS x") == want


def test_split_on_any_separator(g):
    g.query("CREATE NODE TABLE T(id INT64, s STRING, sep STRING, PRIMARY KEY(id))")
    g.add_object("rows", g.spark.createDataFrame([(1, "a\\Eb\\Ec", "\\E"), (2, "a.b", "."), (3, "a\\Qb", "\\Q")], "id long, s string, sep string"))
    g.query("COPY T FROM rows")
    got = {r[0]: r[1] for r in g.query("MATCH (t:T) RETURN t.id AS id, string_split(t.s, t.sep) AS l").collect()}
    assert got == {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a", "b"]}


def test_the_last_row_sets_the_value(g):
    g.query("CREATE NODE TABLE N(id INT64, v INT64, PRIMARY KEY(id)); CREATE (:N {id: 1, v: 0})")
    g.query("UNWIND [3, 9, 4] AS x MATCH (n:N) WHERE n.id = 1 SET n.v = x")
    assert one(g, "MATCH (n:N) RETURN n.v AS v") == 4


def test_export_and_attach(g, spark, tmp_path):
    path = str(tmp_path / "db")
    g.query("CREATE NODE TABLE N(id INT64, note STRING DEFAULT 'none', PRIMARY KEY(id)); CREATE REL TABLE R(FROM N TO N, w INT64); CREATE (:N {id: 1})-[:R {w: 5}]->(:N {id: 2}); CREATE SEQUENCE s START WITH 4; CREATE MACRO twice(x) AS x * 2; COMMENT ON TABLE N IS 'nodes'")
    one(g, "RETURN nextval('s') AS v")
    g.query(f"EXPORT DATABASE '{path}'")
    other = Graph(spark)
    other.query(f"ATTACH '{path}' AS side (DBTYPE parquet)")
    with pytest.raises(QueryError):
        other.query("MATCH (n:N) RETURN n")
    other.query("USE side")
    assert one(other, "MATCH (a:N)-[r:R]->(b:N) RETURN a.id AS a, r.w AS w, b.id AS b") == (1, 5, 2)
    assert one(other, "RETURN nextval('s') AS v, twice(4) AS t") == (5, 8)
    other.query("CREATE (:N {id: 3})")
    assert one(other, "MATCH (n:N {id: 3}) RETURN n.note AS v") == "none"
    assert any(r["name"] == "N" and r["comment"] == "nodes" for r in other.query("CALL show_tables() RETURN *").collect())
    other.query("DETACH side")
    with pytest.raises(QueryError):
        other.query("MATCH (n:N) RETURN n")
    with pytest.raises(QueryError):
        other.query(f"ATTACH '{path}x' AS none (DBTYPE parquet)")


def test_hints_name_the_join_order(g):
    g.query("CREATE NODE TABLE A(id INT64, v STRING, PRIMARY KEY(id)); CREATE REL TABLE R(FROM A TO A); UNWIND [1, 2, 3] AS x CREATE (:A {id: x, v: 'v'}); MATCH (a:A), (b:A) WHERE a.id + 1 = b.id CREATE (a)-[:R]->(b)")
    text = "MATCH (a:A)-[e:R]->(b:A)-[f:R]->(c:A) WHERE c.v = 'v' HINT {} RETURN a.id AS a, c.id AS c"
    for order in ("((c JOIN f) JOIN b) JOIN (e JOIN a)", "((a JOIN e) JOIN b) JOIN (f JOIN c)"):
        assert one(g, text.format(order)) == (1, 3)
    with pytest.raises(QueryError):
        g.query(text.format("(x JOIN e) JOIN b"))


def test_counts_of_chains(g):
    g.query("CREATE NODE TABLE A(id INT64, PRIMARY KEY(id)); CREATE REL TABLE R(FROM A TO A); UNWIND range(1, 6) AS x CREATE (:A {id: x}); MATCH (a:A), (b:A) WHERE a.id < b.id CREATE (a)-[:R]->(b)")
    for pattern in ("(:A)-[:R]->(:A)-[:R]->(:A)", "(a)-[:R]->(b)-[:R]-(c)<-[:R]-(d)", "(:A)-[:R]-()-[:R]-()"):
        listed = len(g.query(f"MATCH {pattern} WHERE true RETURN 1 AS x").collect())
        assert one(g, f"MATCH {pattern} RETURN count(*) AS n") == listed
    assert one(g, "MATCH (a:A {id: 1})-[:R]->()-[:R]->() RETURN count(*) AS n") == 10


def test_a_star_is_counted_without_listing_its_matches(g, spark):
    """count(*) over a hub with 200,000 spokes: 4e10 matches, summed by node and not listed."""
    from tessera.operators.counts import chain_of
    from tessera.plans.statements import parse

    text = "MATCH (:P)-[:IN]->(:Q)<-[:IN]-(:P) RETURN count(*) AS n"
    assert chain_of(parse(text)[0]["parts"][0]) is not None
    g.add_nodes("P", spark.range(200_000).toDF("id"), "id").add_nodes("Q", spark.range(2).toDF("id"), "id")
    g.add_rels("IN", spark.range(200_000).selectExpr("id AS a", "0L AS b"), ("P", "Q"), "a", "b")
    assert one(g, text) == 200_000**2


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_counts_of_pairs_equal_the_listed_ones(g, spark, op):
    """Ties, nulls, NaN, signed zeros, a hot and a missing key; both orders of the sides."""
    a = spark.range(0, 120, 1, 3).selectExpr("id", "case when id % 10 = 0 then null when id < 90 then 1 else cast(id % 7 as int) end AS k", "case when id % 11 = 0 then null when id % 13 = 0 then double('NaN') when id % 9 = 0 then -0.0D else double(id * 7 % 17) end AS x")
    b = spark.range(0, 70, 1, 2).selectExpr("id", "cast(id % 5 as bigint) AS k", "case when id % 8 = 0 then null when id % 12 = 5 then double('NaN') else double(id * 5 % 17) end AS y", "'s' AS s")
    g.add_nodes("A", a, "id").add_nodes("B", b, "id")
    a.createOrReplaceTempView("pair_a")
    b.createOrReplaceTempView("pair_b")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    for cond in (f"a.x {op} b.y", f"b.y {op} a.x", f"a.x {op} b.y AND a.id > 5 AND b.s = 's'"):
        for text, sql in ((f"MATCH (a:A), (b:B) WHERE a.k = b.k AND {cond} RETURN b.k AS k, count(*) AS n", f"SELECT b.k AS k, count(*) AS n FROM pair_a a JOIN pair_b b ON a.k = b.k AND {cond} GROUP BY 1"), (f"MATCH (a:A), (b:B) WHERE {cond} RETURN count(*) AS n", f"SELECT count(*) AS n FROM pair_a a JOIN pair_b b ON {cond}")):
            assert told(g.query(text)) == told(spark.sql(sql))
            assert g.query(text).schema.simpleString() == spark.sql(sql).schema.simpleString()


def test_counts_of_linked_pairs_without_an_inequality(g, spark):
    g.query("CREATE NODE TABLE A(id INT64, k INT64, PRIMARY KEY(id)); CREATE REL TABLE R(FROM A TO A); UNWIND range(1, 12) AS x CREATE (:A {id: x, k: x % 3}); MATCH (a:A), (b:A) WHERE a.id + 1 = b.id CREATE (a)-[:R]->(b)")
    for pattern in ("(a:A), (b:A) WHERE a.k = b.k", "(a:A)-[:R]->(c:A), (b:A) WHERE c.k = b.k AND b.id > 4", "(a:A), (b:A) WHERE a.k = b.k AND a.id <> b.id", "(a:A), (b:A) WHERE a.k = b.k AND a.id < b.id AND a.id + 5 > b.id", "(a:A), (b:A {id: 3}) WHERE false"):
        listed = len(g.query(f"MATCH {pattern} RETURN 1 AS x").collect())
        assert one(g, f"MATCH {pattern} RETURN count(*) AS n") == listed


def test_pairs_of_a_hot_key_are_not_listed(g, spark):
    """200,000 rows of one key a side: 2e10 pairs."""
    n = 200_000
    g.add_nodes("A", spark.range(n).selectExpr("id", "1 AS k", "id * 7919 % 200000 AS x"), "id").add_nodes("B", spark.range(n).selectExpr("id", "1 AS k", "id AS y"), "id")
    assert one(g, "MATCH (a:A), (b:B) WHERE a.k = b.k AND b.y > a.x RETURN a.k AS k, count(*) AS n") == (1, n * (n - 1) // 2)


def test_least_costs_shuffle_no_earlier_row_again(g, spark):
    """Costs and lengths against a search in Python, with ties, zeros and parallel edges, over two labels."""
    import random
    import re

    rnd, nodes = random.Random(3), 14
    edges = [(rnd.randrange(nodes), rnd.randrange(nodes), rnd.choice([0.0, 1.0, 2.0, 5.5])) for _ in range(40)]
    g.add_nodes("A", spark.range(nodes).toDF("id"), "id").add_nodes("B", spark.range(3).toDF("id"), "id")
    g.add_rels("R", spark.createDataFrame(edges, "a long, b long, w double"), ("A", "A"), "a", "b", props=["w"])
    for more, ends in (([], ["A"]), ([(1, 0, 1.0), (2, 0, 1.0), (3, 2, 0.5)], ["A", "B"])):
        if more:
            g.add_rels("R", spark.createDataFrame(more, "a long, b long, w double"), ("A", "B"), "a", "b", props=["w"])
        links = [(("A", a), ("A", b), w) for a, b, w in edges] + [(("A", a), ("B", b), w) for a, b, w in more]
        want = {}
        for s in range(nodes):
            best = {("A", s): (0.0, 0)}
            for n in range(1, 6):
                level = dict(best)
                for a, b, w in links:
                    if a in best and best[a][1] == n - 1 and (b not in level or best[a][0] + w < level[b][0]):
                        level[b] = (best[a][0] + w, n)
                best = level
            want |= {(s, *v): x for v, x in best.items() if v != ("A", s)}
        out = g.query("MATCH (a:A)-[e:R*WSHORTEST(w) 1..5]->(b) RETURN a.id AS a, label(b) AS l, b.id AS b, cost(e) AS c, length(e) AS n")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {(r.a, r.l, r.b): (r.c, r.n) for r in out.collect()} == want
        assert not re.search(r"hashpartitioning\(s#\d+L?, (sl#\d+, )?v#", plan)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tessera_")]
