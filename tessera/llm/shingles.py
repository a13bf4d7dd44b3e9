"""Near copies by SimHash fingerprints and exact Jaccard similarity of word shingles.

Candidates are the texts whose fingerprints the vantage-point trees link, and,
since at similarity 0.8 a 64-bit fingerprint differs in about ten bits, often in
15 and more (a radius that rules out too few unrelated texts), those that share
a MinHash band. A link is made where the shingle sets themselves reach the
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import hot_keys, join_many, stage, tidy, utf8
from .components import connected_components
from .simhash import SEED, majority, near_links, shingle_hashes

# A pair of similarity 0.8 shares a band with probability
# 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.998.
ROWS, BANDS = 4, 12
NOTHING = np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype=np.uint64)  # stands for no words
_DRAW = np.random.default_rng(SEED).integers(0, 1 << 64, (3, ROWS * BANDS), dtype=np.uint64)
_FLIP, _TIMES, _PLACE = _DRAW[0], _DRAW[1] | np.uint64(1), _DRAW[2] | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, ((hashes[at : at + 4096, None] ^ _FLIP) * _TIMES).min(0))
    return bs.mix((low * _PLACE).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, the ``keep`` columns, fp (fingerprint), node (a hash of the shingle set), shingles and bands.

    ``shingles`` holds the upper 32 bits of each shingle's hash, sorted.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            prints, nodes, sets, bands = [], [], [], []
            for text in batch.column(last):
                hashes = shingle_hashes(text.as_py(), shingle)
                prints.append(majority(hashes))
                hashes = np.unique(hashes) if len(hashes) else NOTHING
                small = np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()
                nodes.append(xxhash.xxh64_intdigest(small, SEED))
                sets.append(small)
                bands.append(band_keys(hashes))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (prints, nodes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), *longs, pa.array(sets, pa.binary()), lists], names=[*batch.schema.names[:last], "fp", "node", "shingles", "bands"])

    slim = docs.select(docs["doc_id"].alias("doc_id"), *(docs[c].alias(c) for c in keep), utf8(docs["text"]).alias("_body"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(tidy(scan), f"{kind}, fp long, node long, shingles binary, bands array<long>")


def verified(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links (i, j) of similar sets that connect whatever all similar pairs connect.

    Every set once looks at those that nothing has reached yet, so a group of
    many near copies costs little more than one look at each.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    left = np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front and left.any():
            i = front.pop()
            if len(flat) > 2 * size[left].sum():  # forget the sets already reached
                stay = left[owner]
                flat, owner = flat[stay], owner[stay]
            mine = sets[i]
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            common = np.bincount(owner[mine[at] == flat], minlength=len(sets))
            near = np.flatnonzero(left & (common >= similarity * (size + len(mine) - common) - 1e-9))
            left[near] = False
            front += near.tolist()
            for j in near.tolist():
                yield i, j


def _link_buckets(similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        bucket = None

        def solve() -> pa.RecordBatch:
            a, b = [], []
            if len(held) > 1:
                for i, j in verified([np.frombuffer(s, dtype="<u4") for _, s in held], similarity):
                    a.append(held[i][0])
                    b.append(held[j][0])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, part, node, shingles in zip(*(batch.column(i) for i in range(4)), strict=True):
                now = key.as_py(), part.as_py()
                if now != bucket:
                    yield solve()
                    held, bucket = [], now
                held.append((node.as_py(), shingles.as_py()))
        yield solve()

    return tidy(scan)


def similar_links(rows: DataFrame, keys: DataFrame, similarity: float, bucket_limit: int) -> DataFrame:
    """Links (a, b) between nodes of ``rows`` that share a key and are similar.

    ``keys`` has (node, key) rows. A bucket of more than ``bucket_limit`` nodes is
    dealt into parts; four of its nodes go to every part and connect them. What
    this leaves apart from the bucket's largest class then meets the whole bucket,
    part by part, so every pair of a bucket is either compared or connected.
    """
    cells = stage(keys.select("node", "key").distinct())
    turned = F.xxhash64("node")
    counts = cells.groupBy("key").agg(F.count("*").alias("n"), F.array(F.min("node"), F.max("node"), F.min_by("node", turned), F.max_by("node", turned)).alias("hubs")).where("n > 1")
    counts = stage(counts.withColumn("parts", F.expr(f"int((n + {bucket_limit} - 1) div {bucket_limit})")))
    everywhere = F.array_contains("hubs", F.col("node"))
    mine = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    part = F.when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    shared = cells.join(counts, "key")
    members = shared.select("node").distinct()
    sets = rows.join(members, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"])

    def compared(met: DataFrame) -> DataFrame:
        met = met.join(sets, "node").select("key", "part", "node", "shingles").repartition("key", "part").sortWithinPartitions("key", "part", "node")
        return met.mapInArrow(_link_buckets(similarity), "a long, b long")

    links = stage(compared(shared.select("node", "key", F.explode(part).alias("part"))))
    crowded = shared.where("parts > 1").select("node", "key", "parts", mine.alias("mine"))
    if crowded.isEmpty():
        return links
    classes = connected_components(links).withColumnRenamed("root", "class")
    held = stage(crowded.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
    largest = held.groupBy("key", "class").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("class", F.struct("c", "class")).alias("main"), (F.sum("c") - F.max("c")).alias("rest"))
    largest = largest.where("rest > 0").withColumn("blocks", F.expr(f"int((rest + {bucket_limit} - 1) div {bucket_limit})"))
    held = held.join(largest, "key")
    every = held.select("node", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "mine", "parts")
    apart = held.where(F.col("class") != F.col("main"))
    apart = apart.select("node", "key", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("mine"), "parts")
    met = every.unionByName(apart).select("node", "key", (F.col("block") * F.col("parts") + F.col("mine")).alias("part")).distinct()
    return links.unionByName(compared(met))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, bucket_limit: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns and class_id of every row.

    Documents are linked when the Jaccard similarity of their sets of word
    shingles is at least ``similarity``; a class is what links reach. Pairs are
    looked for among fingerprints that ``radius`` bits connect and among texts
    that share a MinHash band. Null texts, empty ones and those without words are
    alike. An empty table gives an empty result; other columns are ignored.
    """
    rows = stage(sketches(docs, shingle, keep))
    near = connected_components(near_links(rows.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")
    prints = rows.select("node", "fp").distinct().join(near, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"))
    keys = prints.unionByName(rows.select("node", F.explode("bands").alias("key")))
    roots = connected_components(similar_links(rows, keys, similarity, bucket_limit))
    # Copies share a node; a node of very many copies is dealt over many tasks.
    hot = hot_keys(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    out = join_many(rows.drop("shingles", "bands"), roots, hot, "node")
    return out.select("doc_id", *keep, F.coalesce("root", "node").alias("class_id"))
