"""SimHash fingerprints and their exact neighbour search with vantage-point trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_many, stage, tidy, utf8
from .components import connected_components

SEED = 42
LEAF = 96
SHARD_MEAN = 2000


# ------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; none without words."""
    words = text.lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[i:j], SEED) for i, j in zip(begin, end[shingle - 1 :].tolist(), strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; zero without hashes."""
    n = len(hashes)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the columns in ``keep``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            fp = np.array([fingerprint(x, shingle) for x in batch.column(last).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), pa.array(fp)], names=[*batch.schema.names[:last], "fp"])

    columns = [docs["doc_id"].alias("doc_id"), *(docs[c].alias(c) for c in keep)]
    slim = docs.select(*columns, utf8(docs["text"]).alias("_body"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(tidy(scan), f"{kind}, fp long")


# ------------------------------------------------------- vantage-point tree


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantagePointTree:
    """Fingerprints split by their Hamming distance from vantage points.

    ``links(radius)`` walks the tree against itself: at a node with border mu,
    points nearer than mu + radius are queried inside and points farther than
    mu - radius outside, so only points within the overlap of a border meet the
    other side; the triangle inequality rules out every other pair.
    """

    def __init__(self, points: np.ndarray):
        self.points = points

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of row numbers at distance <= radius, each found at least once."""
        every = np.arange(len(self.points))
        stack = [(every, every, True)]
        while stack:
            left, right, own = stack.pop()
            if not len(left) or not len(right):
                continue
            small, large = (left, right) if len(left) <= len(right) else (right, left)
            if len(small) <= LEAF:
                for at in range(0, len(large), 8192):
                    part = large[at : at + 8192]
                    i, j = np.nonzero(_distance(self.points[small][:, None], self.points[part][None, :]) <= radius)
                    keep = small[i] != part[j]
                    yield small[i][keep], part[j][keep]
                continue
            vantage = self.points[large[len(large) // 2]]
            dl = _distance(self.points[left], vantage).astype(np.int64)
            dr = dl if own else _distance(self.points[right], vantage).astype(np.int64)
            order = np.sort(dr)
            mu = int(order[len(order) // 2])
            if mu == order[0]:
                mu += 1
            if mu > order[-1]:  # all on one side: cut by shells of equal distance instead
                near = np.abs(dl - int(order[0])) <= radius
                half = len(right) // 2
                for part in (right[:half], right[half:]):
                    stack.append((left[near], part, False))
                continue
            if own:
                inside, outside = dl < mu, dl >= mu
                stack.append((left[inside], left[inside], True))
                stack.append((left[outside], left[outside], True))
                stack.append((left[inside & (dl >= mu - radius)], left[outside & (dl < mu + radius)], False))
            else:
                stack.append((left[dl < mu + radius], right[dr < mu], False))
                stack.append((left[dl >= mu - radius], right[dr >= mu], False))


def forest(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the smallest row number it is linked to, directly or over others."""
    up = np.arange(len(points))

    def flatten():
        nonlocal up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                return
            up = nxt

    for i, j in VantagePointTree(points).links(radius):
        while len(i):
            a, b = up[i], up[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            flatten()
    flatten()
    return up


# ------------------------------------------------------------ distributed


def _masks(radius: int, agree: int) -> list[int]:
    """Masks of ``agree`` of radius + agree bit blocks, as signed longs: two
    fingerprints within the radius are equal under one of them at least."""
    cut = [round(64 * i / (radius + agree)) for i in range(radius + agree + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cut, cut[1:], strict=False)]
    masks = [sum(c) for c in itertools.combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _agreeing(n: int, radius: int) -> int:
    """Blocks that must agree for shards of ``n`` random fingerprints to hold few."""
    return next((m for m in range(1, 4) if n >> (64 * m // (radius + m)) <= SHARD_MEAN), 4)


def _link_shards(radius: int):
    """(b, v, s, fp) rows sorted by shard -> a spanning forest of each shard's near pairs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        a, b = [], []

        def solve() -> None:
            part = np.concatenate(held)
            if len(part) > 1:
                up = forest(part.view(np.uint64), radius)
                linked = np.flatnonzero(up != np.arange(len(up)))
                a.append(part[up[linked]])
                b.append(part[linked])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            fp = batch.column(3).to_numpy()
            border = np.flatnonzero((shard[1:] != shard[:-1]).any(1)) + 1
            for lo, hi in zip([0, *border.tolist()], [*border.tolist(), len(fp)], strict=True):
                if here is not None and (shard[lo] != here).any():
                    solve()
                    held = []
                here = shard[lo]
                held.append(fp[lo:hi].copy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])
            a, b = [], []
        if held:
            solve()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])

    return tidy(scan)


def near_links(prints: DataFrame, radius: int = 4, shard_limit: int = 200_000, agree: int | None = None) -> DataFrame:
    """Distinct ``fp`` -> links (a, b), a spanning forest of each shard's exact pairs.

    Shards come from vantage-point partitions on projections: of radius + agree
    blocks of bits, two fingerprints within ``radius`` share ``agree`` wholly, and
    the triangle bound prunes every other shard of that choice of blocks. More
    blocks agree where there are more fingerprints, so that a shard holds few
    random ones: one up to about ten million fingerprints, two up to billions. A
    shard over ``shard_limit`` is split again into shells of distance from two
    vantage points of its own; shells overlap by the radius at their borders, so
    each pair still meets. Inside a shard a vantage-point tree finds the pairs.
    """
    width = radius + 1
    agree = _agreeing(prints.count(), radius) if agree is None else agree
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(_masks(radius, agree))]))
    dealt = prints.select("fp", cells.alias("c")).select("fp", "c.b", "c.v")
    large = dealt.groupBy("b", "v").agg(F.count("*").alias("n"), F.min("fp").alias("v1"), F.max("fp").alias("v2")).where(F.col("n") > shard_limit)
    dealt = dealt.join(large, ["b", "v"], "left")

    def shells(vantage: str):
        at = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.col(vantage))) / width)
        return F.array(at, at + 1)

    both = F.flatten(F.transform(shells("v1"), lambda x: F.transform(shells("v2"), lambda y: x * 100 + y)))
    dealt = dealt.select("fp", "b", "v", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(both)).alias("s"))
    dealt = dealt.repartition("b", "v", "s").sortWithinPartitions("b", "v", "s", "fp")
    return dealt.select(F.col("b").cast("long"), "v", "s", "fp").mapInArrow(_link_shards(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, shard_limit: int = 200_000, keep: tuple[str, ...] = (), class_id: bool = False) -> DataFrame:
    """doc_id, the ``keep`` columns, fingerprint (16 hex digits) and component_id of every row.

    Documents are linked when their fingerprints differ in at most ``radius``
    bits; component_id is the smallest doc_id reachable. Rows with equal
    fingerprints are one node, so copies are never paired. Null and empty texts
    and texts without words have fingerprint zero and are linked like any
    other. A null doc_id keeps its row and never is a component_id unless no
    other id is in its component. With ``class_id`` a column of that name, a
    fingerprint of the component as a long, follows; it tells components apart
    where ids are null or repeated. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, shingle, keep))
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(prints.select("fp"), radius, shard_limit))
    classes = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("fp", "component_id", F.col("root").alias("class_id"))
    # A fingerprint may be that of very many copies, or of all texts without words.
    out = join_many(rows, named, hot_keys(prints.select("fp", "n"), "fp"), "fp", "inner")
    return out.select("doc_id", *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["class_id"] if class_id else []))
