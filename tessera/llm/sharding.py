"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised, rows are ordered by the curve index
of their cell, and equal runs of that order become shards: each shard covers a
compact box of every dimension, so a reader that filters on any of them can skip
most shards by their minima and maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, utf8


def curve_index(cell: tuple[int, ...], bits: int) -> int:
    """Position of a cell on the Hilbert curve of len(cell) dimensions.

    Walks from the coarsest bit to the finest; each sub-cube's Gray code rank is
    appended to the index, and its entry corner and direction give the
    orientation of the next level.
    """
    n = len(cell)
    full = (1 << n) - 1
    entry, direction, index = 0, 0, 0

    def rotate(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & full

    for level in range(bits - 1, -1, -1):
        corner = sum((c >> level & 1) << i for i, c in enumerate(cell))
        gray = rotate(corner ^ entry, direction + 1)
        rank = 0
        while gray:  # inverse Gray code
            rank ^= gray
            gray >>= 1
        index = index << n | rank
        start = 0 if rank == 0 else (2 * ((rank - 1) // 2)) ^ ((2 * ((rank - 1) // 2)) >> 1)
        entry ^= rotate(start, n - (direction + 1) % n)
        if rank == 0:
            turn = 0
        else:
            odd = rank if rank % 2 else rank - 1
            turn = ((odd ^ (odd + 1)).bit_length() - 1) % n
        direction = (direction + turn + 1) % n
    return index


def curve_table(dims: int, bits: int) -> list[int]:
    """Curve index of every cell, the first dimension varying slowest."""
    side = 1 << bits
    out = []
    for code in range(side**dims):
        cell = tuple(code // side ** (dims - 1 - i) % side for i in range(dims))
        out.append(curve_index(cell, bits))
    return out


def hilbert(cells: list[Column], bits: int) -> Column:
    """Curve index of quantised columns (each 0 .. 2^bits - 1) by a table lookup."""
    code = F.lit(0)
    for c in cells:
        code = code * (1 << bits) + c
    table = F.expr("array(" + ",".join(map(str, curve_table(len(cells), bits))) + ")")
    return F.element_at(table, (code + 1).cast("int"))


def of_text(c: Column, bits: int) -> Column:
    """Categories spread over the cells by hash; null is its own category."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\x00none"))), F.lit(1 << bits)).cast("int")


def of_size(c: Column, bits: int) -> Column:
    """Magnitudes: one cell per power of two, the last for all beyond; null counts as 0."""
    n = F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(n + 1)), F.lit((1 << bits) - 1)).cast("int")


def shard(docs: DataFrame, shards: int = 40, bits: int = 4, keep: tuple[str, ...] = ("doc_id",), group_rows: int = 50_000, place: str | None = None) -> DataFrame:
    """``keep`` columns, size, text_crc32, curve, shard and slot of every row.

    The law is `rows`: shards are equal runs of the curve order over lang, source
    and length, so their row counts differ by one at most, however rows are
    distributed; a cell with most of the rows is cut like any other. Rows of one
    cell are ordered by a hash group of doc_id and n_chars, then by doc_id, size
    and crc32; rows equal in these are alike in the result too. Null text
    counts as no bytes; null or repeated doc_ids are rows like others; an empty
    table gives an empty result and other columns are ignored. Each row is
    shuffled once, in groups of one cell and at most about ``group_rows`` rows, a
    thousandth of all rows where that is less; counting reads no texts.

    ``place`` names a column of whole numbers from 0 on, another in each row and
    without gaps: an order of the rows that their shards should keep. The shards
    hold the same rows, but slots follow it, and it is returned behind ``keep``.
    Merging the shards by it gives that order again. Texts are shuffled once in
    this case too, figures of a few bytes a row three times.
    """
    body = utf8(docs["text"])
    curve = hilbert([of_text(docs["lang"], bits), of_size(docs["n_chars"], bits), of_text(docs["source"], bits)], bits)
    total = docs.count()
    most = max(1, min(group_rows, -(-total // 1000)))
    # One row a cell: 2^(3 bits) at most.
    cells = docs.groupBy(curve.alias("_c")).agg(F.count("*").alias("_n"))
    cells = cells.select("_c", F.ceil(F.col("_n") / most).alias("_groups"), (F.sum("_n").over(Window.orderBy("_c")) - F.col("_n")).alias("_cell"))

    def grouped(*columns: Column) -> DataFrame:
        held = docs.select(*columns, docs["doc_id"].alias("_id"), docs["n_chars"].alias("_chars"), curve.alias("_c"))
        held = held.join(F.broadcast(cells), "_c")
        return held.withColumn("_b", F.pmod(F.xxhash64("_id", "_chars"), F.col("_groups")))

    counts = grouped().groupBy("_c", "_b", "_cell").agg(F.count("*").alias("_n"))
    base = counts.select("_c", "_b", (F.col("_cell") + F.sum("_n").over(Window.partitionBy("_c").orderBy("_b")) - F.col("_n")).alias("_base"))
    order = Window.partitionBy("_c", "_b").orderBy("_id", "size", "text_crc32", *([place] if place else []))
    size, crc = (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32")
    held = [place] if place else keep  # with places, figures are worked out first and texts are joined to them
    rows = grouped(*[docs[c].alias(c) for c in held], size, crc).withColumn("_i", F.row_number().over(order)).join(base, ["_c", "_b"])
    along = F.col("_base") + F.col("_i") - 1
    # Shard s holds places from ceil(s * total / shards) on.
    number = F.expr(f"((_base + _i - 1) * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    rows = rows.withColumn("_shard", number).select(*held, "size", "text_crc32", F.col("_c").alias("curve"), F.col("_shard").cast("int").alias("shard"), (along - first).alias("slot"))
    if not place:
        return rows
    # Rows of a shard are counted in stretches of the order.
    rows = stage(rows.drop("slot").withColumn("_b", F.expr(f"`{place}` div {most}L")))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    base = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_base"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("shard", "_b").orderBy(place))).join(base, ["shard", "_b"])
    rows = rows.select(F.col(place).alias("_place"), "size", "text_crc32", "curve", "shard", (F.col("_base") + F.col("_i") - 1).alias("slot"))
    texts = docs.select(*[docs[c].alias(c) for c in keep], docs[place].alias(place))
    return texts.join(rows, texts[place] == rows["_place"]).drop("_place")
