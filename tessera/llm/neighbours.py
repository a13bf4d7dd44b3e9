"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tidy

BUCKET_LIMIT = 20_000
BLOCK_QUERIES = 256
MAX_LENGTHS = 16


class PStableHash:
    """``tables`` x ``hashes`` functions floor((a.x + b) / width) with Gaussian a."""

    def __init__(self, dim: int, width: float, tables: int, hashes: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, hashes, dim))
        self.b = rng.uniform(0, 1, (tables, hashes))
        self.width = width
        self.mix = rng.integers(1, 2**62, (hashes,)).astype(np.int64) | 1

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(integer cells, place inside the cell from 0 to 1), each (n, tables, hashes)."""
        at = np.einsum("nd,thd->nth", x, self.a) / self.width + self.b
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def keys(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(-1)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """Bucket keys (n, tables, count) in order of estimated success.

        A perturbation set moves some hashes to the neighbouring cell; its score
        is the sum of squared distances to the borders crossed, and small scores
        are the likeliest to hold a near point.
        """
        cells, place = self.cells(x)
        m = cells.shape[-1]
        moves = [()] + [c for r in (1, 2, 3, 4) for c in itertools.combinations(range(2 * m), r) if len({i % m for i in c}) == r]
        shift = np.zeros((len(moves), m), dtype=np.int64)
        cost = np.zeros((len(moves), 2 * m))
        for k, c in enumerate(moves):
            for i in c:
                shift[k, i % m] = -1 if i < m else 1
                cost[k, i] = 1
        border = np.concatenate([place**2, (1 - place) ** 2], -1)
        score = border @ cost.T
        best = np.argsort(score, -1, kind="stable")[..., : min(count, len(moves))]
        return self.keys(cells[:, :, None, :] + shift[best])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit(sample: np.ndarray, tables: int = 10, hashes: int = 5, spread: float = 1.0) -> PStableHash:
    """Cell width from the spread of projected distances to near neighbours in the sample."""
    part = sample[:512]
    d = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (sample**2).sum(1)[None, :] - 2 * part @ sample.T))
    d[d < 1e-9] = np.inf
    near = np.sort(d, 1)[:, : min(10, d.shape[1])]
    near = near[np.isfinite(near)]
    scale = float(np.median(near)) if len(near) else 1.0
    return PStableHash(sample.shape[1], max(scale * spread, 1e-12), tables, hashes)


def _top(dist: np.ndarray, low: np.ndarray, keep: int) -> np.ndarray:
    """Row numbers of the ``keep`` smallest (distance, lowest id)."""
    if len(dist) > 4 * keep:
        edge = np.partition(dist, keep - 1)[keep - 1]
        part = np.flatnonzero(dist <= edge)
    else:
        part = np.arange(len(dist))
    return part[np.lexsort((low[part], dist[part]))[:keep]]


def exact_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(-1))


_OUT = "query_id long, ids array<long>, dist double"


def _emit(rows: list[tuple[int, list[int], float]]) -> pa.RecordBatch:
    q, ids, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(d, pa.float64())], names=["query_id", "ids", "dist"])


def _search_buckets(k: int):
    """Rows sorted by (t, key, salt, role): each bucket's points, then the queries that probe it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, points, ids, matrix, low = None, [], [], None, None
        for batch in batches:
            rows: list[tuple] = []
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            role, name, members, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist(), _matrix(batch.column(6))
            for i in range(len(key)):
                if here is None or (key[i] != here).any():
                    here, points, ids, matrix = key[i].copy(), [], [], None
                if role[i] == 0:
                    points.append(x[i])
                    ids.append(members[i])
                    continue
                if not points:
                    continue
                if matrix is None:
                    matrix, low = np.array(points), np.array([m[0] for m in ids])
                d = exact_distances(x[i], matrix)
                rows += [(int(name[i]), ids[j], float(d[j])) for j in _top(d, low, k + 1)]
            yield _emit(rows)

    return scan


def usable(df: DataFrame) -> DataFrame:
    """id, vec rows whose vector is not null, not empty, not zero and wholly finite."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where((F.size("vec") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda v: v != 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, tables: int = 10, hashes: int = 5, probes: int = 60, spread: float = 1.0, sample: int = 2000, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found of each query.

    ``vectors`` has columns id and vec; queries are the rows whose id is
    divisible by ``every``. The index holds every usable vector; only the cell
    width is fitted, on the ``sample`` rows of smallest id hash. Equal vectors are
    one index entry with its k + 1 smallest ids, which is all that ties can need,
    so a vector that very many rows share costs one distance. Buckets over
    ``bucket_limit`` are dealt over several tasks. Queries that find fewer than
    ``k`` rows are searched again exactly, against all rows, in blocks. A distance
    is between vectors of one length: those of each length are searched among
    themselves (more than MAX_LENGTHS lengths raise an error). Rows without an id
    take no part. Rows that repeat an id and vector count once; other columns are
    ignored, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = usable(vectors.select(F.col("id").cast("long").alias("id"), F.col("vec")))
    lengths = [r["dim"] for r in good.select(F.size("vec").alias("dim")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vec = F.col("vec").cast("array<double>").alias("vec")
    each = [_nearest(good.where(F.size("vec") == dim).select("id", vec).distinct(), every, k, tables, hashes, probes, spread, sample, bucket_limit) for dim in sorted(lengths)]
    return reduce(lambda a, b: a.unionByName(b), each)


def _nearest(good: DataFrame, every: int, k: int, tables: int, hashes: int, probes: int, spread: float, sample: int, bucket_limit: int) -> DataFrame:
    """``nearest`` for distinct (id, vec) rows of one length."""
    spark = good.sparkSession
    picked = good.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    hasher = spark.sparkContext.broadcast(fit(np.array([r["vec"] for r in picked]), tables, hashes, spread))

    first = good.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    index = stage(first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    queries = stage(good.where(F.col("id") % every == 0))

    def deal(of_queries: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = hasher.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    x = _matrix(part.column(1))
                    key = h.probes(x, probes) if of_queries else h.keys(h.cells(x)[0])[:, :, None]
                    n, t, p = key.shape
                    rows = pa.array(np.repeat(np.arange(n), t * p))
                    table = np.tile(np.repeat(np.arange(t), p), n)
                    yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(key.reshape(-1)), part.column(0).take(rows)], names=["t", "key", "ref"])

        return scan

    # Keys travel with references only; vectors join in once buckets are known to be of use.
    entries = index.select(F.col("ids")[0].alias("ref"), "vec", "ids")
    points = stage(entries.select("ref", "vec").mapInArrow(deal(False), "t long, key long, ref long"))
    asked = stage(queries.select("id", "vec").mapInArrow(deal(True), "t long, key long, ref long").distinct())
    probed = asked.select("t", "key").distinct()
    points = points.join(probed, ["t", "key"], "left_semi")
    large = points.groupBy("t", "key").count().where(F.col("count") > bucket_limit).select("t", "key", F.ceil(F.col("count") / bucket_limit).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = points.join(large, ["t", "key"], "left").join(entries, "ref").select("t", "key", F.pmod(F.xxhash64("ref"), parts).alias("salt"), F.lit(0).cast("long").alias("role"), "ref", "ids", "vec")
    right = asked.join(large, ["t", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).join(queries.select(F.col("id").alias("ref"), "vec"), "ref").select("t", "key", "salt", F.lit(1).cast("long").alias("role"), "ref", F.array().cast("array<long>").alias("ids"), "vec")
    both = left.unionByName(right).repartition("t", "key", "salt").sortWithinPartitions("t", "key", "salt", "role")
    found = stage(both.mapInArrow(tidy(_search_buckets(k)), _OUT))

    def ranked(hits: DataFrame) -> DataFrame:
        flat = hits.select("query_id", F.explode("ids").alias("vec_id"), "dist").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("dist").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    enough = ranked(found).groupBy("query_id").count().where(F.col("count") >= k)
    lacking = queries.join(enough, queries["id"] == enough["query_id"], "left_anti").select("id", "vec")
    held: list = []
    for r in itertools.chain(lacking.toLocalIterator(), [None]):
        if r is not None:
            held.append((r["id"], r["vec"]))
        if held and (r is None or len(held) >= BLOCK_QUERIES):
            found = found.unionByName(_exact_block(spark, index, held, k))
            held = []
    return ranked(found)


def _exact_block(spark, index: DataFrame, block: list, k: int) -> DataFrame:
    """Top entries of each task for a bounded block of queries."""
    sent = spark.sparkContext.broadcast(([i for i, _ in block], np.array([v for _, v in block])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(0)), batch.column(1).to_pylist()
            low = np.array([m[0] for m in ids])
            rows: list[tuple] = []
            for name, v in zip(names, q, strict=True):
                d = exact_distances(v, x)
                rows += [(name, ids[j], float(d[j])) for j in _top(d, low, k + 1)]
            yield _emit(rows)

    return index.select("vec", "ids").mapInArrow(scan, _OUT)
