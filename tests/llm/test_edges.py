"""Every registered query on tables with nulls, ties, repeated rows, very long
texts and extra columns whose names clash with what the operators produce."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import QUERIES

CLASH = ("fp", "fingerprint", "component_id", "root", "score", "predicted", "shard", "slot", "size", "mix_source", "_h", "_b", "_key", "body", "_body", "rank", "id", "vec", "item_id", "key", "n")
LONG = "the same line of a very long text goes on and on\n" * 6000
DOCS = [
    (1, "plain words in a short text that nobody repeats", "en", "web", 47),
    (1, "plain words in a short text that nobody repeats", "en", "web", 47),
    (1, "another text under the same id as the one above", "de", "web", None),
    (None, "a text without any id at all", None, None, None),
    (None, None, None, None, None),
    (5, None, "en", "web", 0),
    (6, "", "en", None, 0),
    (7, " \t\n", "en", "book", 3),
    (8, LONG, "en", "book", len(LONG)),
    (9, "x" * 300_000, "en", "book", 300_000),
    (10, "password: hunter2hunter2 and mail a.b@c.de, ünïcödé \U0001f600", "fr", "web", 60),
    (-3, "1.2.3.4 call +1 (212) 555-0100 now", "", "", 34),
]


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def write(spark, path, docs, empty=False):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    tables = {
        "documents": d,
        "labels": spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (8, None, None), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "plain words in a short text that nobody repeats"), (1, "plain words in a short text that nobody repeats"), (2, None), (None, ""), (4, "...")], "item_id long, text string"),
        "pages": spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b\r\nX: y", None), (4, "", ""), (5, "http://c", LONG)], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(0, [1.0, 2.0], 1), (100, [1.0, 2.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [3.0, 2.0], 1), (200, [9.0, 9.0], 1)], "vec_id long, embedding array<float>, label int"),
    }
    for name, df in tables.items():
        with_clashes(df.limit(0) if empty else df).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("bare"), DOCS, empty=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    if name == "op2_warc":
        assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None)]
    elif name == "op5_decontaminate":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1)}
    elif name == "op6_ann":
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert by[0] == [(100, 0.0), (7, 2.0), (200, 113**0.5)]
        assert [v for v, _ in by[100]] == [0, 7, 200] and [v for v, _ in by[200]] == [7, 0, 100]
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in DOCS)
    if name == "op1_suffix_dedup":
        assert {r["n_bytes"] for r in got if r["doc_id"] == 8} == {len(LONG)}
        # Every byte but those that no repeated 200-byte string covers; here none is left.
        assert {(r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] in (8, 9)} == {(len(LONG), hashlib.sha256(b"").hexdigest()), (300_000, hashlib.sha256(b"").hexdigest())}
    if name == "op3_simhash":
        zero = [r for r in got if r["fingerprint"] == "0" * 16]
        assert sorted(str(r["doc_id"]) for r in zero) == ["5", "6", "7", "None"] and {r["component_id"] for r in zero} == {5}
    if name in ("op4_secrets", "op8_pii"):
        nothing = hashlib.sha256(b"").hexdigest()
        assert {(r["base_sha256"], r["spans"]) for r in got if r["doc_id"] in (5, 6, 7)} == {(nothing, "")}
    if name == "op7_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    if name == "op10_sharding":
        assert {r["size"] for r in got if r["doc_id"] in (5, 6)} == {16}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, bare, name):
    assert QUERIES[name](spark, bare).collect() == []


def test_pipeline_on_odd_rows(spark, odd, bare):
    import corpus_pipeline as cp

    got = cp.run(spark, odd).collect()
    assert {r["doc_id"] for r in got} <= {d[0] for d in DOCS} and len(got) <= len(DOCS)
    assert cp.run(spark, bare).collect() == []
