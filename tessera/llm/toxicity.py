"""Toxicity classifier: character n-grams scaled by naive Bayes log-count ratios.

A logistic regression over binary character n-gram features, each multiplied by
the log ratio of its smoothed document frequencies in the two classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import stage, tidy, utf8

SIZES = (4, 6, 8)
BITS = 20
PIECE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


class Scanner:
    """Distinct hashed n-grams of each text, in pieces of bounded size."""

    def __init__(self):
        self.hasher = bs.RangeHash(7, PIECE + SIZES[-1])

    def _piece(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        buf = LOWER[buf]
        owner = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
        pre = self.hasher.prefix(buf)
        out = []
        for k in SIZES:
            if len(buf) < k:
                continue
            ids = (self.hasher.grams(pre, k) >> np.uint64(64 - BITS)).astype(np.int32)
            inside = owner[: len(ids)] == owner[k - 1 :]  # not over a border between texts
            if table is not None:
                ids = table[ids]
                inside &= ids >= 0
            at = np.flatnonzero(inside)
            out.append(owner[at].astype(np.int64) << BITS | ids[at])
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pairs >> BITS, pairs & ((1 << BITS) - 1)

    def hits(self, raw: np.ndarray, off: np.ndarray, table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, features), each pair once; with ``table`` only the features that
        it maps to a number >= 0, under that number.

        A text longer than a piece is read in overlapping pieces; what its earlier
        pieces held is kept as one bit a feature, so no text is held as n-grams.
        """
        current, seen = -1, np.zeros(1 << BITS, dtype=bool)
        for lo, hi, rows, starts, ends in bs.slices(off, SIZES[-1] - 1, PIECE):
            row, feature = self._piece(raw[lo:hi], starts, ends, table)
            if len(rows) == 1 and off[rows[0] + 1] - off[rows[0]] > PIECE:
                if rows[0] != current:
                    current = rows[0]
                    seen[:] = False
                fresh = ~seen[feature]
                row, feature = row[fresh], feature[fresh]
                seen[feature] = True
            yield rows[row], feature


class ToxicityModel:
    """Chosen features (table: hashed n-gram -> number or -1), weights and bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def table(self) -> np.ndarray:
        return numbered(self.chosen)

    def scores(self, raw: np.ndarray, off: np.ndarray, scanner: Scanner, table: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        for row, feature in scanner.hits(raw, off, table):
            if len(row):
                first = int(row[0])
                part = np.bincount(row - first, weights=self.weights[feature])
                z[first : first + len(part)] += part
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def numbered(chosen: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, dtype=np.int32)
    table[chosen] = np.arange(len(chosen), dtype=np.int32)
    return table


def regression(owner: np.ndarray, column: np.ndarray, labels: np.ndarray, scale: np.ndarray, prior: float, penalty: float = 0.5, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights of the features and bias: logistic regression on binary features
    times ``scale``; ``prior`` is the share of label 1 among all labelled rows."""
    n, w, bias = len(labels), np.zeros(len(scale)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(owner, weights=(w * scale)[column], minlength=n)
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(column, weights=gap[owner], minlength=len(w)) * scale / n + penalty * w / n
        gb = gap.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 * (1 - t / (rounds + 1))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    sampled = labels.mean()
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return w * scale, float(bias + np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)))


def fold(doc_id) -> F.Column:
    """crc32 of the doc_id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def frequencies(rows: DataFrame) -> DataFrame:
    """(toxic, body) rows -> feature, f0, f1: in how many texts of each class it occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, df = Scanner(), np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            raw, off = bs.buffers(batch.column(1))
            label = batch.column(0).to_numpy()
            for row, feature in scanner.hits(raw, off):
                for c in (0, 1):
                    np.add.at(df[c], feature[label[row] == c], 1)
        at = np.flatnonzero(df.any(0))
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(df[0][part].astype(np.int64)), pa.array(df[1][part].astype(np.int64))], names=["feature", "f0", "f1"])

    found = rows.select("toxic", "body").mapInArrow(tidy(scan), "feature int, f0 long, f1 long")
    return found.groupBy("feature").agg(F.sum("f0").alias("f0"), F.sum("f1").alias("f1"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, features: int = 3000, least: int = 5) -> ToxicityModel | None:
    """Fit on at most ``per_class`` labelled rows of each class from folds 1 to 4.

    The bound is the only sampling: rows are taken by smallest hash of their
    doc_id, the class prior is counted over all labelled rows. Rows with a null
    doc_id, label or text don't train; of several labels of a doc_id the larger
    counts, of several texts the smallest. None without rows of both classes.

    Document frequencies of n-grams are summed by Spark; the driver gets the
    ``features`` with the strongest ratios, and one task the numbers of those
    that each sampled text holds.
    """
    marked = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()).select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marked = marked.where(fold(marked["doc_id"]) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return None
    order = F.xxhash64("doc_id")
    some = marked.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    text = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where("text is not null")
    # Sizes are bounded by per_class; 2 x per_class ids are a few tens of kilobytes.
    rows = stage(text.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min(utf8(F.col("text"))).alias("body")))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    ratio = F.log((F.col("f1") + 1) / F.lit(size[1] + 2.0)) - F.log((F.col("f0") + 1) / F.lit(size[0] + 2.0))
    both = F.col("f0") + F.col("f1")
    top = frequencies(rows).where(both >= least).select("feature", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(both)).alias("strength"))
    top = top.where("strength > 0").orderBy(F.desc("strength"), "feature").limit(features).collect()
    top = sorted((r["feature"], r["ratio"]) for r in top)
    chosen, scale = np.array([f for f, _ in top], dtype=np.int64), np.array([r for _, r in top])
    prior = count[1] / (count[0] + count[1])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = Scanner(), numbered(chosen)
        for batch in batches:
            raw, off = bs.buffers(batch.column(2))
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, feature in scanner.hits(raw, off, table):
                rows.append(row)
                found.append(feature)
            row, feature = np.concatenate(rows), np.concatenate(found)
            cut = np.searchsorted(row, np.arange(len(off))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "toxic", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One task holds the bounded sample, as feature numbers; only the weights leave it.
        held = sorted((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda x: x[0])
        if not held:
            return
        sizes = np.array([len(f) for _, _, f in held])
        column = np.fromiter((x for _, _, f in held for x in f), dtype=np.int64, count=sizes.sum())
        weights, bias = regression(np.repeat(np.arange(len(held)), sizes), column, np.array([t for _, t, _ in held], dtype=float), scale, prior)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["weights", "bias"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    spread = rows.select("doc_id", "toxic", "body").mapInArrow(number, f"doc_id {kind}, toxic int, found array<int>")
    found = spread.coalesce(1).mapInArrow(learn, "weights array<double>, bias double").collect()
    return ToxicityModel(chosen, np.array(found[0]["weights"]), found[0]["bias"])


def score(docs: DataFrame, model: ToxicityModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, held_out, score and predicted for every row.

    Null and empty texts get the score of a text without features. Without a
    model (no labelled rows) every score is 0. Repeated rows are scored alike. A
    very long text is read whole, in pieces.
    """
    own = "text" in keep

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = Scanner(), None if model is None else model.table()
        for batch in batches:
            body = batch.column(keep.index("text") if own else batch.num_columns - 1)
            raw, off = bs.buffers(body.fill_null("") if body.null_count else body)
            s = np.zeros(len(off) - 1) if model is None else model.scores(raw, off, scanner, table)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(s)], names=[*batch.schema.names[: len(keep) + 1], "_score"])

    slim = docs.select(*[docs[c].alias(c) for c in keep], (fold(docs["doc_id"]) == 0).alias("_held"), *([] if own else [utf8(docs["text"]).alias("_body")]))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep) + 1])
    out = slim.mapInArrow(tidy(scan), f"{kind}, _score double")
    return out.select(*keep, F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
