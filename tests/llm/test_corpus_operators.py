"""Decontamination, neighbours, toxicity, mixing, sharding and the pipeline."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neighbours, sharding, toxicity

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, doc_id long")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, n_equal int")


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(1)
    item, short = words(rng, 40), words(rng, 9)
    around = lambda part: " ".join(words(rng, 30) + part + words(rng, 30))
    swapped = [w if i % 8 else "zzz" for i, w in enumerate(item)]
    noisy = [w if i % 2 else "zzz" for i, w in enumerate(item)]
    rows = [(1, around(item)), (2, around([w.upper() + "," for w in swapped])), (3, around(noisy)), (4, around(item[:12])), (5, around(item[5:20])), (6, around(short)), (7, None), (8, ""), (9, around(words(rng, 40))), (1, around(item)), (None, around(item))]
    b = bench(spark, [(0, " ".join(item)), (1, " ".join(short)), (2, None), (3, ""), (0, " ".join(item))])
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(spark, rows), b).select("doc_id", "item_id", "n_tokens").collect())
    assert set(got) == {(1, 0), (2, 0), (5, 0), (6, 1), (None, 0)}
    left = decontaminate.decontaminate(docs(spark, rows), b)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 7, 8, 9]
    assert left.columns == ["doc_id", "text", "item_id", "n_equal"]


def test_decontamination_with_a_full_filter_and_empty(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 30))) for i in range(6)]
    rows = [(i, " ".join(words(rng, 20)) + " " + items[i % 6][1]) for i in range(12)]
    whole = sorted(decontaminate.overlaps(docs(spark, rows), bench(spark, items)).collect())
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 6)  # lets nearly everything pass
    assert sorted(decontaminate.overlaps(docs(spark, rows), bench(spark, items)).collect()) == whole and len(whole) == 12
    assert decontaminate.overlaps(docs(spark, []).limit(0), bench(spark, items)).count() == 0
    assert decontaminate.overlaps(docs(spark, rows), bench(spark, []).limit(0)).count() == 0


def test_verify_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(13, 40)
        a = [rng.choice("ab") for _ in range(n)]
        item, text = "".join(f"{x} " for x in a), "".join(f"{x if rng.random() < 0.8 else 'c'} " for x in a)
        equal = [x == y for x, y in zip(item.split(), text.split(), strict=True)]
        want = max((e - s for s in range(n) for e in range(s + 1, n + 1) if equal[s] and equal[e - 1] and sum(equal[s:e]) >= 0.8 * (e - s) - 1e-6), default=0)
        got = decontaminate.verify(decontaminate._tokens_of(text.encode()), decontaminate._tokens_of(item.encode()), 0, 0.8, 13)
        assert (got[1] if got else 0) == (want if want >= 13 else 0)


def brute_overlaps(rows, items):
    """Longest stretch of every text and item over all diagonals, without seeds."""
    out = {}
    for d, text in rows:
        a = decontaminate._tokens_of((text or "").encode())
        for i, item in items:
            b = decontaminate._tokens_of((item or "").encode())
            found = [decontaminate.verify(a, b, k, 0.8, 13) for k in range(-len(b) + 1, len(a))]
            best = max((f[1] for f in found if f), default=0)
            if best:
                out[d, i] = best
    return out


def test_decontamination_query_equals_brute_force(spark):
    rng = random.Random(30)
    few = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(3)]  # few words, so that chance matches abound
    items = [(i, " ".join(rng.choices(few, k=rng.choice((3, 8, 13, 20, 40))))) for i in range(12)] + [(20, "one line of words " * 12), (21, None)]
    rows = [(i, " ".join(rng.choices(few, k=rng.choice((2, 15, 60))))) for i in range(40)]
    rows += [(50, "one line of words " * 200), (51, None), (52, ""), (53, "words of line one " * 30)]
    for i in range(30):
        w = items[i % 12][1].split()
        for at in rng.sample(range(len(w)), len(w) // 6):
            w[at] = "zz"
        rows.append((100 + i, " ".join(rng.choices(few, k=5) + w + ["end"])))
    got = {(r["doc_id"], r["item_id"]): r["n_tokens"] for r in decontaminate.overlaps(docs(spark, rows), bench(spark, items)).collect()}
    want = brute_overlaps(rows, items)
    assert got.keys() == want.keys() and len(want) > 100
    # A longer stretch may lie on a diagonal without a seed only beyond 300 tokens.
    assert got == want


def test_decontamination_of_a_very_long_repetitive_text(spark):
    line = "the same ten words come again and again in it "
    rows = [(1, line * 6600), (2, "other words " * 10)]
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, [(7, line * 110)])).collect()
    assert [(r["doc_id"], r["item_id"], r["n_tokens"], r["n_equal"]) for r in got] == [(1, 7, 1100, 1100)]


def brute_nearest(ids, x, k, every=100):
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % every == 0:
            d = sorted((float(np.sqrt(((v - y) ** 2).sum())), i) for i, y in zip(ids, x, strict=True) if i != q)
            out[q] = d[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = neighbours.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), every=8).collect()
    want = brute_nearest(ids, x, 10, every=8)
    assert len(want) >= 200
    hit = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for _, i in d}) for q, d in want.items())
    assert hit >= 0.9 * 10 * len(want)
    place = {i: n for n, i in enumerate(ids)}
    for r in got:
        assert abs(r["score"] - np.sqrt(((x[place[r["query_id"]]] - x[place[r["vec_id"]]]) ** 2).sum())) < 1e-9
    assert Counter(r["query_id"] for r in got) == dict.fromkeys(want, 10)


def test_neighbours_edges(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(300)] + [(1000, None), (1001, [0.0, 0.0]), (1100, [float("nan"), 1.0]), (1002, [None, 1.0]), (None, [1.0, 1.0]), (1200, [1.0]), (5, [5.0, 1.0]), (1300, [])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = neighbours.nearest(df, bucket_limit=2).orderBy("query_id", "rank").collect()
    good = [(i, v) for i, v in rows[:300]]
    for q, d in brute_nearest([i for i, _ in good], np.array([v for _, v in good]), 10).items():
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] == [(i, s) for s, i in d]
    assert [r["query_id"] for r in got if r["query_id"] >= 1000] == []  # 1200 is the only usable vector of its length
    two = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (100, [1.0]), (3, [4.0])], "id long, vec array<float>")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in two) == [(0, 1), (100, 3)]
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [0.5])], "id long, vec array<float>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in few] == [(2, 1), (1, 2)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.score(d, toxicity.train(d, lab)).join(lab, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in out)
    tp = sum(r["predicted"] and r["toxic"] for r in out)
    assert tp >= 0.7 * sum(r["toxic"] for r in out) and tp >= 0.95 * sum(r["predicted"] for r in out)


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "x", 1.0), (3, "y" * 70_000, 0.0), (3, "y" * 70_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(d, toxicity.train(d, none)).collect()] == [0.0] * 5
    texts = [f"you {'awful' if i % 2 else 'lovely'} thing {i}" for i in range(200)]
    d2 = d.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    lab = spark.createDataFrame([(100 + i, i % 2) for i in range(200)] + [(1, 1), (None, 1), (2, None), (101, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(d2, toxicity.train(d2, lab)).collect()}
    assert all(out[100 + i]["predicted"] == i % 2 for i in range(200))
    assert 0 <= out[2]["score"] <= 1 and out[1]["score"] == out[2]["score"]


def test_pfair_deviation_below_one_block():
    rng = random.Random(9)
    for _ in range(40):
        q = mixing.quanta({str(i): rng.random() for i in range(rng.randint(1, 25))}, 200)
        plan = mixing.schedule(q)
        assert sorted(t for ts in plan.values() for t in ts) == list(range(200))
        for k, ts in plan.items():
            for j, t in enumerate(ts):
                assert j * 200 // q[k] <= t < -(-(j + 1) * 200 // q[k])
            for t in range(201):
                assert abs(sum(x < t for x in ts) - t * q[k] / 200) < 1


def test_mixing_order_and_horizon(spark):
    rows = [(i, "a" if i % 3 else None, 1) for i in range(600)] + [(7, "b", 1)] * 90 + [(None, "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int")
    got = mixing.mix(d, {"a": 0.5, None: 0.3, "b": 0.2}, block=4, group_rows=20).collect()
    assert len(got) == len(rows)
    places = Counter((r["mix_slot"], r["mix_offset"]) for r in got)
    assert max(places.values()) == 1
    inside = [r for r in got if r["in_mix"]]
    slots = 1 + max(r["mix_slot"] for r in inside)
    assert len(inside) == 4 * slots  # every slot before the horizon holds a whole block
    for t in range(1, slots + 1):
        share = Counter(r["mix_source"] for r in inside if r["mix_slot"] < t)
        for k, w in (("a", 0.5), (None, 0.3), ("b", 0.2)):
            assert abs(share[k] / 4 - t * w) < 1
    for r in got:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    assert mixing.mix(d.limit(0)).count() == 0


def brute_shards(n, shards):
    return [p * shards // n for p in range(n)]


@pytest.mark.parametrize("group_rows", [50_000, 7])
def test_sharding_matches_brute_force(spark, group_rows):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").withColumn("shard", F.lit("x"))
    extra = spark.createDataFrame([(None, None, None, None, None, "x"), (3, "", "en", "s", -5, "x"), (3, "", "en", "s", -5, "x"), (4, "é", "en", "s", 2**60, "x")], d.schema)
    d = d.unionByName(extra)
    got = sharding.shard(d, 40, group_rows=group_rows).collect()
    rows = d.collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in range(40):
        assert [r["slot"] for r in ordered if r["shard"] == s] == list(range(n[s]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)
    assert [r["shard"] for r in ordered] == brute_shards(len(got), 40)


def test_sharding_few_rows_and_none(spark):
    d = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard(d, 40).collect()
    assert len({r["shard"] for r in got}) == 3 and all(r["slot"] == 0 for r in got)
    assert sharding.shard(d.limit(0), 40).count() == 0


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 3), (3, 3), (4, 2)):
        table, side = sharding.curve_table(dims, bits), 1 << bits
        back = {h: c for c, h in enumerate(table)}
        assert sorted(table) == list(range(side**dims))
        cell = lambda c: [c // side**i % side for i in range(dims)]
        for h in range(side**dims - 1):
            assert sum(abs(a - b) for a, b in zip(cell(back[h]), cell(back[h + 1]), strict=True)) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, step in cp.STAGES:
        before = docs
        docs = cp.stage(step(spark, docs, SF))
        kept[name] = (before.collect(), docs.collect())
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["simhash_near_dedup"]
    # The stage's rule: five-word shingles, similarity 0.8 or more.
    before = sorted(before, key=lambda r: r["doc_id"])
    groups, _ = similar_groups([r["text"] for r in before])
    assert sorted(r["doc_id"] for r in after) == [before[i]["doc_id"] for i in sorted(set(groups))]
    before, after = kept["sharding"]
    assert len(before) == len(after) and {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert 0 < len(kept["toxicity"][1]) <= len(kept["toxicity"][0])
    assert {r["doc_id"] for r in cp.run(spark, SF).collect()} == {r["doc_id"] for r in after}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    rng = random.Random(8)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(5, a), (5, b), (3, b), (3, b), (None, c), (None, c), (None, d), (9, None), (10, ""), (None, "")]
    got = cp.drop_near_copies(spark, spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "").select("doc_id", "text").collect()
    want = [(5, a), (3, b), (None, c), (None, d), (9, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pipeline_mixing_keeps_every_row_in_order(spark):
    import corpus_pipeline as cp

    rows = [(i, "t", None, "rare" if i < 5 else None if i < 205 else "b" if i < 1205 else "c", 1) for i in range(5205)] + [(None, "t", None, "c", 1)] * 2
    got = [tuple(r) for r in cp.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    # A source that has run out leaves the order; the others go on by their weights.
    order = [r[3] for r in got]
    last = {k: max(i for i, x in enumerate(order) if x == k) for k in set(order)}
    weight = {None: 200**0.7, "b": 1000**0.7, "c": 4002**0.7}
    live = [k for k in weight if last[k] > last["rare"]]
    assert live == list(weight)
    start, stop = last["rare"] + 1, min(last[k] for k in live)
    assert stop - start > 500
    for at in range(start, stop):
        seen = Counter(order[start:at])
        for k in live:
            assert abs(seen[k] - (at - start) * weight[k] / sum(weight.values())) <= 4 * 8
    few = cp.mix_sources(spark, spark.createDataFrame(rows[:7], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r["doc_id"] for r in few.collect()) == list(range(7))


@pytest.mark.parametrize("files", ["read", "parts", "frame"])
def test_pipeline_shards_keep_the_mixture(spark, files):
    import corpus_pipeline as cp

    kinds = [("rare", 5), (None, 200), ("b", 1000), ("c", 4000)]
    rows = [(None if i % 500 == 1 else i // 2, f"{k} {i}", "en", k, 10 + i % 90) for k, n in kinds for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxRecordsPerFile": "150"} if files == "parts" else {}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        mixed = cp.mix_sources(spark, frame, "")
        order = [r["text"] for r in mixed.collect()]
        if files != "frame":  # an ordered frame that no stage has written keeps its order as well
            mixed = cp.stage(mixed)
            assert files == "read" or len(mixed.inputFiles()) > 30
        got = cp.shard(spark, mixed, "").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got))) == sorted(map(repr, rows))
    # Each shard gives its part of the schedule's order, and all together give that order.
    for s in range(40):
        held = Counter(r["text"] for r in got if r["shard"] == s)
        assert [r["text"] for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == s] == [t for t in order if t in held]
    got.sort(key=lambda r: r["mix_place"])
    assert [r["mix_place"] for r in got] == list(range(len(rows)))
    assert [r["text"] for r in got] == order
    for s in range(40):
        assert [r["slot"] for r in got if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))
    # The shards are those of the curve.
    along = sorted(got, key=lambda r: (r["shard"], r["curve"]))
    assert [r["curve"] for r in along] == sorted(r["curve"] for r in got)
    assert [r["shard"] for r in along] == brute_shards(len(got), 40)


def planted_copies(rng, n):
    """Texts of 100 to 400 words, each with a copy some of whose words are replaced."""
    out = []
    for _ in range(n):
        text = words(rng, rng.choice((100, 250, 400)))
        copy = list(text)
        for at in rng.sample(range(len(text)), rng.randint(1, max(1, len(text) // 45))):
            copy[at] = "replaced"
        out += [" ".join(text), " ".join(copy)]
    return out


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_groups(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i)]
    for i, j, s in pairs:
        if s >= 0.8:
            up = [up[j] if x == up[i] else x for x in up] if up[i] > up[j] else [up[i] if x == up[j] else x for x in up]
    return up, [s for _, _, s in pairs if s >= 0.8]


def test_near_dedup_finds_planted_copies(spark):
    import corpus_pipeline as cp

    texts = [*planted_copies(random.Random(12), 150), None, "", " \n", "two words", "Two  WORDS"]
    groups, near = similar_groups(texts)
    assert sum(0.8 <= s < 0.85 for s in near) >= 10 and sum(0.85 <= s < 0.95 for s in near) >= 10
    frame = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in cp.drop_near_copies(spark, frame, "").collect())
    assert got == sorted(set(groups))


@pytest.mark.parametrize("limit", [2000, 20])
def test_near_copies_in_a_large_group(spark, limit):
    from tessera.llm import shingles

    rng = random.Random(13)
    base = words(rng, 200)
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = words(rng, 1)[0] + "x"
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 200)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {}
    for r in shingles.near_copies(frame, bucket_limit=limit).collect():
        classes.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(min(x) for x in classes.values()) == sorted(set(similar_groups(texts)[0]))


@pytest.mark.parametrize("limit", [4, 1000])
def test_links_of_a_crowded_bucket_connect_what_similar_pairs_connect(spark, limit):
    from tessera.llm import components, shingles

    rng = random.Random(15)
    sets = []
    for size in (30, 14, 9, 3, 1, 1, 1):  # classes of near copies and single texts, all in one bucket
        base = rng.sample(range(1, 1 << 30), 60)
        for _ in range(size):
            copy = list(base)
            copy[rng.randrange(60)] = rng.randrange(1 << 30)
            sets.append(np.unique(np.array(copy, dtype="<u4")))
    order = list(range(len(sets)))
    rng.shuffle(order)
    rows = spark.createDataFrame([(i, sets[j].tobytes()) for i, j in enumerate(order)], "node long, shingles binary")
    links = shingles.similar_links(rows, rows.select("node", F.lit(7).cast("long").alias("key")), 0.8, limit)
    for r in links.collect():
        a, b = set(sets[order[r["a"]]].tolist()), set(sets[order[r["b"]]].tolist())
        assert len(a & b) / len(a | b) >= 0.8
    found = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = {}
    for i, j in enumerate(order):
        mates = [k for k, x in enumerate(order) if len(np.intersect1d(sets[j], sets[x])) / len(np.union1d(sets[j], sets[x])) >= 0.8]
        want[i] = mates
    for i, mates in want.items():
        for k in mates:
            assert found.get(i, i) == found.get(k, k)
    assert len({found.get(i, i) for i in want}) == 7


def substitutions(n):
    """Every pattern of equal tokens with four fifths equal, both ends among them."""
    for k in range(int(0.2 * n + 1e-9) + 1):
        for gone in itertools.combinations(range(1, n - 1), k):
            yield [i not in gone for i in range(n)]


def test_masks_miss_no_substitutions():
    for n in range(1, 21):
        masks = decontaminate.MASKS if n >= 13 else decontaminate.whole_masks(n, 0.8)
        for equal in substitutions(n):
            assert any(all(equal[at + i] for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)), (n, equal)


def test_decontamination_of_short_items(spark):
    rng = random.Random(14)
    items = {n: [f"item{n}x{i}" for i in range(n)] for n in range(1, 15)}
    rows, want = [], set()
    for n, item in items.items():
        for equal in substitutions(n):
            rows.append((len(rows), " ".join(words(rng, 9) + [w if e else "zzz" for w, e in zip(item, equal, strict=True)] + words(rng, 9))))
            want.add((len(rows) - 1, n))
        rows.append((len(rows), " ".join(words(rng, 9) + item[: n - 1] + words(rng, 9))))
        want |= {(len(rows) - 1, n)} if n == 14 else set()  # 13 tokens of it
        rows.append((len(rows), " ".join(words(rng, 9) + item[:1] * (n > 1) + ["zzz"] * (n - 1))))
    rows.append((len(rows), " ".join(items[1] * 50)))
    want.add((len(rows) - 1, 1))
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, [(n, " ".join(x)) for n, x in items.items()])).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)
    assert all(r["n_tokens"] == r["item_id"] for r in got if r["item_id"] < 13)
