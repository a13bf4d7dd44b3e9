"""Removal of repeated passages with run-length compressed suffix indexes.

A window of ``width`` bytes is repeated when it also starts anywhere else. Equal
windows share their anchor (the smallest k-gram hash inside the window), so the
work is dealt out by anchor: only stretches around anchors that occur more than
once are looked at, each distinct stretch once, with its multiplicity. A block
of stretches is indexed by its Burrows-Wheeler transform, kept as runs with the
suffix positions at both ends of each run; the lengths of the longest matches
with the neighbours in suffix order follow from these samples alone, because
within a run the match length falls by one with each step through the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import hot_keys, join_many, stage, tidy, utf8

GRAM = 48
SEPARATOR, SENTINEL = 0xFF, 0xFE  # bytes that UTF-8 never uses
BLOCK_BYTES = 1 << 20
NULL_ID = -(2**63)


# ---------------------------------------------------------------- the index


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """Suffix order of ``buf`` by prefix doubling from 8-byte keys."""
    n = len(buf)
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 8
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa
        s = sa[at]
        nxt = s + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        code = rank[s] * (n + 1) + second
        order = np.argsort(code, kind="stable")
        code = code[order]
        sa[at] = s[order]
        sub = np.ones(len(at), dtype=bool)
        sub[1:] = code[1:] != code[:-1]
        new[at] = sub
        rank[sa[at]] = np.maximum.accumulate(np.where(sub, at, 0))
        step *= 2


class RunLengthIndex:
    """Run-compressed BWT of a block with suffix samples at run ends."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        sa = suffix_array(buf)
        bwt = buf[sa - 1].copy()
        bwt[sa == 0] = SENTINEL
        head = np.ones(len(sa), dtype=bool)
        head[1:] = bwt[1:] != bwt[:-1]
        tail = np.append(head[1:], True)
        heads = np.flatnonzero(head)
        # What the samples at run ends give: a position and its neighbour in suffix order.
        up, down = heads[heads > 0], np.flatnonzero(tail[:-1])
        self.before = (sa[up], sa[up - 1])
        self.after = (sa[down], sa[down + 1])
        self.ends = (int(sa[0]), int(sa[-1]))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes a and b, compared eight bytes at a time."""
        n = len(self.buf)
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        words = np.zeros(n + 1, dtype=np.uint64)
        for i in range(8):
            words[:n] |= padded[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            diff = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
            same = (diff == 0) & (x < n) & (y < n)
            part = live[~same]
            low = diff[~same]
            low = low & (~low + np.uint64(1))
            step = np.where(low == 0, 0, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            out[part] += step
            live = live[same]
            out[live] += 8
            live = live[out[live] < n]
        return np.minimum(out, n - np.maximum(a, b))

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match that also starts elsewhere in the block."""
        n = len(self.buf)
        best = np.zeros(n, dtype=np.int64)
        for (pos, other), edge in ((self.before, self.ends[0]), (self.after, self.ends[1])):
            value = np.zeros(n, dtype=np.int64)
            known = np.zeros(n, dtype=bool)
            value[pos] = self._common(pos, other)
            known[pos] = True
            known[edge] = True  # no neighbour on that side
            last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
            np.maximum(best, value[last] - (np.arange(n) - last), out=best)
        return best


def repeated_windows(stretches: list[bytes], width: int) -> list[np.ndarray]:
    """For each stretch the window starts that also start elsewhere among the stretches."""
    sizes = np.array([len(s) for s in stretches])
    buf = np.frombuffer(b"\xff".join(stretches) + b"\xff", dtype=np.uint8)
    ms = RunLengthIndex(buf).matching_statistics()
    out, at = [], 0
    for size in sizes:
        out.append(np.flatnonzero(ms[at : at + max(0, size - width + 1)] >= width))
        at += size + 1
    return out


def runs_of(starts: np.ndarray, width: int) -> list[int]:
    """Covered byte runs [s, e, s, e, ...] of ascending window starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.concatenate([[0], cut + 1])]
    last = starts[np.concatenate([cut, [len(starts) - 1]])] + width
    return np.stack([first, last], 1).ravel().tolist()


# ------------------------------------------------------------- the scanners

ANCHORS = "k0 long, tk long, akey long, skey long, lo long, n int"


def anchors_of(width: int):
    """Arrow scanner: (k0, tk, body) -> one row per anchor and its window range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2 = bs.RangeHash(1, bs.SLICE + width), bs.RangeHash(2, bs.SLICE + width)
        span, low = width - GRAM + 1, np.uint64((1 << 24) - 1)
        for batch in batches:
            raw, off = bs.buffers(batch.column(2))
            k0, tk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, rows, starts, ends in bs.slices(off, width - 1):
                ok = ends - starts >= width
                rows, starts, ends = rows[ok], starts[ok], ends[ok]
                if not len(rows):
                    continue
                buf = raw[lo:hi]
                pre = h1.prefix(buf)
                gram = h1.grams(pre, GRAM)
                order = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
                where = (bs.sliding_min(order, span) & low).astype(np.int64)
                size = ends - starts - width + 1
                owner = np.repeat(np.arange(len(rows)), size)
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                win = np.arange(len(owner)) - first[owner] + starts[owner]
                anchor = where[win]
                new = np.ones(len(win), dtype=bool)
                new[1:] = anchor[1:] != anchor[:-1]
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(win)))
                begin, row = win[at], rows[owner[at]]
                skey = h2.ranges(h2.prefix(buf), begin, begin + n + width - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k0[row]), pa.array(tk[row]), pa.array(gram[anchor[at]].view(np.int64)), pa.array(skey.view(np.int64)), pa.array(begin + lo - off[row]), pa.array(n.astype(np.int32))],
                    names=["k0", "tk", "akey", "skey", "lo", "n"],
                )

    return scan


def _cut_stretches(width: int):
    """(body, wanted) rows -> the text of each wanted stretch."""

    def scan(batches):
        for batch in batches:
            akey, skey, m, text = [], [], [], []
            for body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    akey.append(w["akey"])
                    skey.append(w["skey"])
                    m.append(w["m"])
                    text.append(body[w["lo"] : w["lo"] + w["n"] + width - 1])
                if len(text) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(akey, pa.int64()), pa.array(skey, pa.int64()), pa.array(m, pa.int64()), pa.array(text, pa.binary())], names=["akey", "skey", "m", "text"])
                    akey, skey, m, text = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(akey, pa.int64()), pa.array(skey, pa.int64()), pa.array(m, pa.int64()), pa.array(text, pa.binary())], names=["akey", "skey", "m", "text"])

    return scan


def _match_blocks(width: int, block_bytes: int):
    """Sorted (akey, skey, m, text) rows -> covered runs of each stretch, block by block."""

    def flush(akey, skey, m, text):
        found = repeated_windows(text, width)
        runs = [[0, len(t)] if c > 1 else runs_of(f, width) for t, c, f in zip(text, m, found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(akey, pa.int64()), pa.array(skey, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["akey", "skey", "runs"])

    def scan(batches):
        akey, skey, m, text, size = [], [], [], [], 0
        for batch in batches:
            for a, s, c, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= block_bytes and a != akey[-1]:
                    yield flush(akey, skey, m, text)
                    akey, skey, m, text, size = [], [], [], [], 0
                akey.append(a)
                skey.append(s)
                m.append(c)
                text.append(t)
                size += len(t) + 1
        if akey:
            yield flush(akey, skey, m, text)

    return scan


def _window_keys(width: int):
    """Stretches of crowded anchors -> two 64-bit hashes of every window."""

    def scan(batches):
        for batch in batches:
            raw, off = bs.buffers(batch.column(3))
            a, s, m = (batch.column(i).to_numpy() for i in range(3))
            h1, h2 = bs.RangeHash(3, int(off[-1] - off[0])), bs.RangeHash(4, int(off[-1] - off[0]))
            buf = raw[off[0] : off[-1]]
            size = np.maximum(np.diff(off) - width + 1, 0)
            owner = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            begin = at + off[owner] - off[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[owner]), pa.array(s[owner]), pa.array(m[owner]), pa.array(at.astype(np.int32))] + [pa.array(h.ranges(h.prefix(buf), begin, begin + width).view(np.int64)) for h in (h1, h2)],
                names=["akey", "skey", "m", "at", "w1", "w2"],
            )

    return scan


def _finish(batches):
    """(doc_id, body, spans) -> what is left of each text."""
    for batch in batches:
        bodies, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = [[], [], [], [], [], []]
        for body, flat in zip(bodies, spans, strict=True):
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in flat or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(body[at:lo])
                at = hi
            kept.append(body[at:])
            left = b"".join(kept)
            for column, value in zip(out, (len(body), len(body) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left, [x for y in merged for x in y]), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])


def remove_repeats(docs: DataFrame, width: int = 200, block_bytes: int = BLOCK_BYTES, crowded: int = 3000) -> DataFrame:
    """Remove every byte that a repeated ``width``-byte window covers.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) and
    removed (flat list of run borders), one row per input row.

    Null text counts as empty; texts shorter than ``width`` are kept whole. Rows
    repeated with one doc_id count as separate texts, so all of them lose what
    they share. Null doc_ids are kept as rows. An empty table gives an empty
    result. Columns other than doc_id and text are ignored. An anchor with more
    than ``crowded`` distinct stretches is not gathered in one block: its windows
    are hashed and counted by a plain aggregation instead, which is as exact.
    """
    body = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("k0"),
        F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("tk"),
        utf8(docs["text"]).alias("body"),
    )
    every = body.select("k0", "tk", "body").mapInArrow(tidy(anchors_of(width)), ANCHORS)
    often = every.groupBy("akey").agg(F.count("*").alias("n"), F.min("skey").alias("s0"), F.max("skey").alias("s1")).where("n > 1")
    often = stage(often.select("akey", "n", (F.col("s0") != F.col("s1")).alias("mixed")))
    # A passage that most texts share has one anchor: its rows go to many tasks.
    seen = stage(join_many(every, often.select("akey", "mixed"), hot_keys(often.select("akey", "n"), "akey"), "akey", "inner"))

    # One place where each distinct stretch of a mixed anchor can be read, and how often it occurs.
    distinct = seen.where("mixed").groupBy("akey", "skey").agg(F.count("*").alias("m"), F.min(F.struct("k0", "tk", "lo", "n")).alias("p"))
    distinct = stage(distinct.select("akey", "skey", "m", "p.*"))
    wanted = distinct.groupBy("k0", "tk").agg(F.collect_list(F.struct("akey", "skey", "m", "lo", "n")).alias("wanted"))
    text = body.select("k0", "tk", "body").join(wanted, ["k0", "tk"]).select("body", "wanted").mapInArrow(tidy(_cut_stretches(width)), "akey long, skey long, m long, text binary")
    busy = distinct.groupBy("akey").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowded)
    text = stage(text.join(busy.withColumn("busy", F.lit(True)), "akey", "left").select("akey", "skey", "m", "text", F.coalesce("busy", F.lit(False)).alias("busy")))
    text = text.dropDuplicates(["akey", "skey"])  # rows repeated in the input give a stretch twice

    few = text.where("not busy").select("akey", "skey", "m", "text")
    runs = few.repartition("akey").sortWithinPartitions("akey").mapInArrow(tidy(_match_blocks(width, block_bytes)), "akey long, skey long, runs array<int>")
    windows = text.where("busy").select("akey", "skey", "m", "text").mapInArrow(tidy(_window_keys(width)), "akey long, skey long, m long, at int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.sum("m").alias("c")).where("c > 1").select("w1", "w2")
    crowd = windows.join(twice, ["w1", "w2"]).select("akey", "skey", F.array("at", F.col("at") + width).alias("runs"))

    same = seen.where("not mixed").select("k0", "tk", "lo", (F.col("lo") + F.col("n") + (width - 1)).alias("hi"))
    mixed = seen.where("mixed").join(runs.unionByName(crowd), ["akey", "skey"]).where(F.size("runs") > 0)
    pairs = F.expr("transform(sequence(0L, size(runs) div 2 - 1), i -> struct(lo + get(runs, cast(2 * i as int)) as lo, lo + get(runs, cast(2 * i + 1 as int)) as hi))")
    mixed = mixed.select("k0", "tk", F.explode(pairs).alias("r")).select("k0", "tk", "r.lo", "r.hi")
    spans = same.unionByName(mixed).distinct().groupBy("k0", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    done = body.join(spans, ["k0", "tk"], "left").select("doc_id", "body", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return done.mapInArrow(tidy(_finish), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<long>")
