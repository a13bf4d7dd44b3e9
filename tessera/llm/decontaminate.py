"""Benchmark decontamination with spaced seeds.

A seed hashes some positions of a token window and ignores the others, so one or
more substituted tokens do not hide a match. One scan of the corpus keeps the
texts with a window that a bit filter of the test items' hashes lets pass; their
windows are joined with the items' windows by hash, and each diagonal hit is
verified token by token, tolerating substitutions. The filter's size is bounded,
whatever the test set's; a fuller filter only lets more windows reach the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import stage, tidy, utf8

# Seed masks over a window of tokens (1 compares, 0 ignores).
# Any 13 to 300 tokens of which four fifths are equal, the first and the last among
# them, hold all compared positions of one of them.
MASKS = ("1111011", "1101111", "11101011", "11011011", "111111", "110101011")
FILTER_BITS = 27  # of the filter's size, at most: 16 MB
PROBES = 4
TEXT_EDGE, ITEM_EDGE = 1, 2  # stand for the window before the first one
BROADCAST_ROWS = 500_000  # doc keys of 16 bytes: below this a set of them is sent to every task
# Letters and digits of ASCII (lower-cased) and every byte of a longer character.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def whole_masks(size: int, share: float) -> list[str]:
    """Masks over a whole item of ``size`` tokens that together miss no substitutions within ``share``.

    Of one group of inner tokens more than there may be substitutions, one group has
    none; each mask compares one group and both ends.
    """
    groups = int((1 - share) * size + 1e-9) + 1
    return sorted({"".join("1" if i in (0, size - 1) or i * groups // size == g else "0" for i in range(size)) for g in range(groups)})


class Tokens:
    """Token hashes of many texts in one array, with the row each belongs to."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        ids, rows = [], []
        hasher = bs.RangeHash(11, max(bs.SLICE, int(np.diff(off).max(initial=0))))
        i, n = 0, len(off) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + bs.SLICE, side="right")) - 1))
            buf = _LOWER[raw[off[i] : off[j]]]
            word = _WORD[buf]
            edge = np.zeros(len(buf) + 1, dtype=bool)
            edge[off[i : j + 1] - off[i]] = True
            begin = word.copy()
            begin[1:] &= ~word[:-1] | edge[1:-1]
            end = word.copy()
            end[:-1] &= ~word[1:] | edge[1:-1]
            start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
            ids.append(hasher.ranges(hasher.prefix(buf), start, stop))
            rows.append(np.searchsorted(off[i : j + 1] - off[i], start, side="right") - 1 + i)
            i = j
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.rows, np.arange(n + 1))

    def seeds(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of each window of the mask that lies in one text."""
        span, n = len(mask), len(self.ids)
        if n < span:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n - span + 1, dtype=np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + self.ids[k : n - span + 1 + k]
        at = np.flatnonzero(self.rows[: n - span + 1] == self.rows[span - 1 :])
        return at, bs.mix(h[at])


def plan_masks(sizes: list[int], share: float, least: int) -> list[tuple[str, int]]:
    """(mask, item size) pairs; size 0 stands for all items of ``least`` tokens or more."""
    masks = [(m, 0) for m in MASKS] if any(n >= least for n in sizes) else []
    return masks + [(m, n) for n in sorted({n for n in sizes if 0 < n < least}) for m in whole_masks(n, share)]


def windows(t: Tokens, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a mask's windows; masks have hashes of their own."""
    at, h = t.seeds(mask)
    return at, h ^ np.uint64((number + 1) * 0xD1342543DE82EF95 % 2**64)


def before(t: Tokens, at: np.ndarray, h: np.ndarray, chosen: np.ndarray, edge: int) -> np.ndarray:
    """For chosen windows the hash of the one a token earlier in the same text, or ``edge``."""
    last = np.maximum(chosen - 1, 0)
    goes_on = (chosen > 0) & (at[last] == at[chosen] - 1) & (t.rows[at[last]] == t.rows[at[chosen]])
    return np.where(goes_on, h[last], np.uint64(edge))


class BitFilter:
    """Which hashes may be among the test items'."""

    def __init__(self, bits: int, words: dict[int, int]):
        self.bits = bits
        full = np.zeros(1 << max(0, bits - 6), dtype=np.uint64)
        if words:
            full[np.fromiter(words, np.int64, len(words))] = np.fromiter(words.values(), np.int64, len(words)).view(np.uint64)
        self.packed = full.view(np.uint8)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes whose bits are all set; few are left after the first bit."""
        left, all_of = np.arange(len(h)), np.uint64((1 << self.bits) - 1)
        for j in range(PROBES):
            some = h[left]
            i = (some + np.uint64(j) * ((some >> np.uint64(32)) | np.uint64(1))) & all_of if j else some & all_of
            left = left[(self.packed[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return left


def verify(a: np.ndarray, b: np.ndarray, diagonal: int, share: float, least: int) -> tuple[int, int, int] | None:
    """Best aligned stretch of at least ``share`` equal tokens: (start in text, tokens, equal).

    a and b are the tokens of text and item. The stretch must have ``least``
    tokens, or be the item where that is shorter.
    """
    lo, hi = max(0, diagonal), min(len(a), diagonal + len(b))
    equal = a[lo:hi] == b[lo - diagonal : hi - diagonal]
    need = min(least, len(b))
    if len(equal) < need or not equal.any():
        return None
    # Longest stretch that begins and ends with an equal token and whose equal
    # share is at least ``share``: prefix sums of (equal - share) that do not
    # fall from its start to its end.
    level = np.concatenate([[0.0], np.cumsum(equal - share)])
    lowest = np.minimum.accumulate(np.where(equal, level[:-1], np.inf))
    end = np.flatnonzero(equal) + 1
    start = np.searchsorted(-lowest, -(level[end] + 1e-9), side="left")
    length = end - start
    best = int(np.argmax(length))
    if length[best] < need:
        return None
    s, e = int(start[best]), int(end[best])
    return lo + s, e - s, int(equal[s:e].sum())


def _tokens_of(text: bytes) -> np.ndarray:
    return Tokens(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])).ids


def _batch_tokens(column: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(first row, tokens) of slices of a batch."""
    raw, off = bs.buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + 2 * bs.SLICE, side="right")) - 1))
        yield i, Tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


SEED = "array<struct<h: bigint, before: bigint, at: bigint>>"
SEED_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("before", pa.int64()), ("at", pa.int64())]))


def _seed_lists(rows: np.ndarray, n: int, columns: list[np.ndarray]) -> pa.Array:
    """Each row's seeds as a list of (h, before, at)."""
    order = np.argsort(rows, kind="stable")
    cut = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(c[order].view(np.int64)) for c in columns], names=["h", "before", "at"])
    return pa.ListArray.from_arrays(pa.array(cut), parts)


def _text_seeds(masks: list[tuple[str, int]], held):
    """(doc_id, tk, body) -> the texts that may share a seed with an item, and these seeds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in _batch_tokens(batch.column(2)):
                n = len(t.first) - 1
                rows, cols = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(3)]
                for number, (mask, _) in enumerate(masks):
                    at, h = windows(t, mask, number)
                    ok = held.value.may_hold(h)
                    if "0" not in mask and len(mask) < 6 and len(ok):  # a short item, whole: its first place in a text is enough
                        pairs = np.stack([t.rows[at[ok]].astype(np.uint64), h[ok]], 1)
                        ok = ok[np.sort(np.unique(pairs, axis=0, return_index=True)[1])]
                    last, at = before(t, at, h, ok, TEXT_EDGE), at[ok]
                    rows.append(t.rows[at])
                    for c, v in zip(cols, (h[ok], last, (at - t.first[t.rows[at]]).astype(np.uint64)), strict=True):
                        c.append(v)
                lists = _seed_lists(np.concatenate(rows), n, [np.concatenate(c) for c in cols])
                some = pa.array(np.flatnonzero(np.diff(lists.offsets.to_numpy())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n).take(some) for c in range(3)), lists.take(some)], names=["doc_id", "tk", "body", "seeds"])

    return scan


def _item_seeds(masks: list[tuple[str, int]], least: int):
    """(item_id, ik, body) -> the seeds of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in _batch_tokens(batch.column(2)):
                n, size = len(t.first) - 1, np.diff(t.first)
                rows, cols = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(3)]
                for number, (mask, of) in enumerate(masks):
                    at, h = windows(t, mask, number)
                    ok = np.flatnonzero(size[t.rows[at]] == of if of else size[t.rows[at]] >= least)
                    rows.append(t.rows[at[ok]])
                    for c, v in zip(cols, (h[ok], before(t, at, h, ok, ITEM_EDGE), (at[ok] - t.first[t.rows[at[ok]]]).astype(np.uint64)), strict=True):
                        c.append(v)
                lists = _seed_lists(np.concatenate(rows), n, [np.concatenate(c) for c in cols])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), lists], names=["item_id", "ik", "seeds"])

    return scan


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, t in _batch_tokens(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(t.first))], names=["n"])


def _verify_rows(share: float, least: int, kinds: tuple[pa.DataType, pa.DataType]):
    """Rows of a text, its body first, then its items with their diagonals."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, text = None, None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, tk, role, body, item_id, diagonals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    here, text = (doc_id, tk), _tokens_of(body)
                    continue
                assert here == (doc_id, tk)
                item, best = _tokens_of(body), None
                for d in sorted(diagonals):
                    got = verify(text, item, d, share, least)
                    if got and (best is None or got[1] > best[1]):
                        best = got
                if best:
                    out.append((doc_id, tk, item_id, *best))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (kinds[0], pa.int64(), kinds[1], pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "doc_key", "item_id", "doc_start", "n_tokens", "n_equal"])

    return scan


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, least: int = 13) -> DataFrame:
    """doc_id, doc_key, item_id, doc_start, n_tokens, n_equal: one row per text and test item.

    A text overlaps an item when some stretch of ``least`` tokens (or the whole
    item, where that is shorter), from an equal token to an equal token, agrees
    in at least ``share`` of its tokens at equal offsets and has a spaced seed in
    common. With the defaults every such stretch of up to 300 tokens has one, and
    whole items always do. Items without tokens match nothing. Null texts and
    items count as empty, empty tables give an empty result, other columns are
    ignored. Items that repeat an id and text count once, and so do rows that
    repeat a doc_id and text; doc_key tells rows with equal doc_id but different
    text apart. Of the longest stretches of a text and item the one on the lowest
    diagonal is given. On a diagonal only the first of adjoining hits is kept, so
    a very long repetitive text gives no more diagonals than it has tokens.
    """
    spark = docs.sparkSession
    kinds = tuple(x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kinds[0]}, doc_key long, item_id {kinds[1]}, doc_start long, n_tokens long, n_equal long"
    items = benchmark.select(benchmark["item_id"].alias("item_id"), F.coalesce(F.xxhash64(benchmark["text"]), F.lit(0)).alias("ik"), utf8(benchmark["text"]).alias("body")).dropDuplicates(["item_id", "ik"])
    sizes = items.select("body").mapInArrow(_sizes, "n long").select(F.least("n", F.lit(least)).alias("n")).distinct()
    masks = plan_masks([r["n"] for r in sizes.collect()], share, least)  # at most ``least`` + 1 numbers
    if not masks:
        return spark.createDataFrame([], schema)
    seeds = stage(items.select("item_id", "ik", "body").mapInArrow(_item_seeds(masks, least), f"item_id {kinds[1]}, ik long, seeds {SEED}").select("item_id", "ik", F.explode("seeds").alias("x")).select("item_id", "ik", "x.*"))

    bits = min(FILTER_BITS, max(16, int(seeds.count()).bit_length() + 6))
    step = F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("long"))
    place = F.explode(F.array(*[(F.col("h") + step * F.lit(j)).bitwiseAND(F.lit((1 << bits) - 1)) for j in range(PROBES)]))
    words = seeds.select(place.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("v"))
    held = spark.sparkContext.broadcast(BitFilter(bits, {r["w"]: r["v"] for r in words.collect()}))  # 2 ** (FILTER_BITS - 6) words at most

    body = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("tk"), utf8(docs["text"]).alias("body"))
    found = stage(body.mapInArrow(tidy(_text_seeds(masks, held)), f"doc_id {kinds[0]}, tk long, body binary, seeds {SEED}"))
    mine = found.select("doc_id", "tk", F.explode("seeds").alias("x")).select("doc_id", "tk", "x.h", F.col("x.before").alias("b1"), F.col("x.at").alias("a1"))
    other = seeds.select("item_id", "ik", "h", F.col("before").alias("b2"), F.col("at").alias("a2"))
    hits = mine.join(other, (mine["h"] == other["h"]) & (mine["b1"] != other["b2"])).select("doc_id", "tk", "item_id", "ik", (F.col("a1") - F.col("a2")).alias("diagonal"))
    hits = hits.groupBy("doc_id", "tk", "item_id", "ik").agg(F.collect_set("diagonal").alias("diagonals"))
    other = items.select(F.col("item_id").alias("_i"), F.col("ik").alias("_k"), "body")
    hits = stage(hits.join(other, hits["item_id"].eqNullSafe(other["_i"]) & (hits["ik"] == other["_k"])).select("doc_id", "tk", F.lit(1).alias("role"), "body", "item_id", "ik", "diagonals"))
    keys = hits.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t")).distinct()
    texts = found.join(keys, found["doc_id"].eqNullSafe(keys["_d"]) & (found["tk"] == keys["_t"]), "left_semi")
    texts = texts.select("doc_id", "tk", F.lit(0).alias("role"), "body", F.lit(None).cast(kinds[1]).alias("item_id"), F.lit(None).cast("long").alias("ik"), F.array().cast("array<bigint>").alias("diagonals"))
    both = texts.unionByName(hits).repartition("doc_id", "tk").sortWithinPartitions("doc_id", "tk", "role", "item_id", "ik")
    return both.select("doc_id", "tk", "role", "body", "item_id", "diagonals").mapInArrow(tidy(_verify_rows(share, least, (arrow_type(kinds[0]), arrow_type(kinds[1])))), schema)


def arrow_type(simple: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[simple]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The rows of ``docs`` that overlap no test item, all their columns unchanged."""
    bad = stage(overlaps(docs, benchmark, **more).select(F.col("doc_id").alias("_bad_id"), F.col("doc_key").alias("_bad_key")).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    key = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad_id")) & (key == F.col("_bad_key")), "left_anti")
