"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. Block j of a source of weight w is released at
floor(j / w) and due at ceil((j + 1) / w), and every slot goes to the released
block that is due first. No prefix of the schedule then deviates from the target
by a whole block. Weights are multiples of 1/period, so the schedule repeats
with that period and is computed once, for a number of slots that is a parameter.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = "\x00none"  # stands for a null source


def quanta(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each positive weight: largest remainders, one at least."""
    live = {k: w for k, w in weights.items() if w > 0}
    if len(live) > period:
        raise ValueError(f"{len(live)} sources need a period of as many slots at least, not {period}")
    total = sum(live.values())
    share = {k: w * period / total for k, w in live.items()}
    out = {k: max(1, int(x)) for k, x in share.items()}
    order = sorted(live, key=lambda k: (int(share[k]) - share[k], k))
    i = 0
    while sum(out.values()) < period:
        out[order[i % len(order)]] += 1
        i += 1
    while sum(out.values()) > period:
        most = max(out, key=lambda k: (out[k] - share[k] if out[k] > 1 else -math.inf, k))
        out[most] -= 1
    return out


def schedule(slots: dict[str, int]) -> dict[str, list[int]]:
    """Slot of each block within one period, earliest deadline first."""
    period = sum(slots.values())
    out: dict[str, list[int]] = {k: [] for k in slots}
    coming = [(0, -(-period // n), k, 0) for k, n in sorted(slots.items())]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, due, k, j = heapq.heappop(coming)
            heapq.heappush(ready, (due, k, j))
        due, k, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError(f"block {j} of {k} misses its deadline {due} at {t}")
        out[k].append(t)
        if j + 1 < slots[k]:
            heapq.heappush(coming, ((j + 1) * period // slots[k], -(-(j + 2) * period // slots[k]), k, j + 1))
    return out


MAX_SOURCES = 100_000


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, block: int = 8, period: int | None = None, columns: tuple[str, ...] = ("doc_id",), group_rows: int = 50_000) -> DataFrame:
    """Every row with its place in the mixture.

    Returns ``columns``, mix_source, mix_block,
    mix_release, mix_deadline, mix_slot, mix_offset (within the block) and
    in_mix: whether the slot comes before the first one that finds its source
    out of whole blocks. Up to there the target holds; rows after it are kept
    with in_mix false.

    Without ``weights`` a source of n rows weighs n ** temperature. A null source
    is a source of its own. Rows of a source are taken in the order of a hash of
    doc_id, then of a 64-bit hash of ``columns``; rows equal in all of these are
    alike in the result too. A null or repeated doc_id is no exception, an empty table gives an empty result, other columns are
    ignored. Sources with no positive weight get no slot and in_mix false.

    ``period`` is the number of slots after which the schedule repeats: without it
    1,000, or ten times the number of sources, rounded up to a power of ten, if
    that is more. Ranks are counted in groups of at most about ``group_rows`` rows
    of one source, a thousandth of all rows where that is less, so a source with
    most of the rows is spread over many tasks. The driver holds one count a
    source and one period of slots; more than MAX_SOURCES sources raise an error.
    """
    spark = docs.sparkSession
    src = F.coalesce(docs["source"].cast("string"), F.lit(NONE))
    found = docs.groupBy(src.alias("s")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give them coarser names first")
    sizes = {r["s"]: r["n"] for r in found}
    weights = {k: n**temperature for k, n in sizes.items()} if weights is None else {NONE if k is None else k: w for k, w in weights.items()}
    live = {k: w for k, w in weights.items() if k in sizes and w > 0}
    if period is None:
        period = max(1000, 10 ** math.ceil(math.log10(10 * max(1, len(live)))))
    slots = quanta(live, period) if live else {}
    plan = schedule(slots) if live else {}
    # The slot at which a source first lacks a whole block.
    ends = [(sizes[k] // block // n) * period + plan[k][sizes[k] // block % n] for k, n in slots.items()]
    horizon = min(ends, default=0)

    most = max(1, min(group_rows, -(-sum(sizes.values()) // 1000)))
    # One row a source, MAX_SOURCES at most, and one a slot of the period.
    each = spark.createDataFrame([(k, slots.get(k), -(-n // most)) for k, n in sizes.items()] or [(NONE, 0, 1)], "mix_source string, _k int, _groups long")
    table = spark.createDataFrame([(k, j, t) for k, ts in plan.items() for j, t in enumerate(ts)] or [(NONE, -1, 0)], "mix_source string, _j int, _t int")

    # Texts and the like stay out of the groups' hash: counting reads no long column.
    short = [c for c in columns if isinstance(docs.schema[c].dataType, (T.NumericType, T.BooleanType))]

    def grouped(*names: str) -> DataFrame:
        """Rows with their source's figures, their hash and group."""
        slim = docs.select(*[docs[c].alias(c) for c in names], src.alias("mix_source"), F.xxhash64(docs["doc_id"]).alias("_h"), F.xxhash64(docs["doc_id"], *[docs[c] for c in short]).alias("_g"))
        slim = slim.join(F.broadcast(each), "mix_source", "left")
        return slim.withColumn("_b", F.pmod(F.xxhash64("_g"), F.col("_groups"))).drop("_g", "_groups")

    counts = grouped().groupBy("mix_source", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("mix_source", "_b", (F.sum("_n").over(Window.partitionBy("mix_source").orderBy("_b")) - F.col("_n")).alias("_base"))
    order = Window.partitionBy("mix_source", "_b").orderBy("_h", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    rows = grouped(*columns).withColumn("_i", F.row_number().over(order))
    rows = rows.join(before, ["mix_source", "_b"]).withColumn("_rank", F.col("_base") + F.col("_i") - 1)
    rows = rows.withColumn("mix_block", F.expr(f"_rank div {block}"))
    rows = rows.withColumn("_j", F.when(F.col("_k") > 0, (F.col("mix_block") % F.col("_k")).cast("int")))
    rows = rows.join(F.broadcast(table), ["mix_source", "_j"], "left")
    return rows.select(
        *columns,
        F.when(F.col("mix_source") != NONE, F.col("mix_source")).alias("mix_source"),
        "mix_block",
        F.expr(f"mix_block * {period} div _k").alias("mix_release"),
        F.expr(f"((mix_block + 1) * {period} + _k - 1) div _k").alias("mix_deadline"),
        F.expr(f"(mix_block div _k) * {period} + _t").alias("mix_slot"),
        F.expr(f"_rank % {block}").alias("mix_offset"),
        F.coalesce(F.expr(f"(mix_block div _k) * {period} + _t < {horizon}"), F.lit(False)).alias("in_mix"),
    )
