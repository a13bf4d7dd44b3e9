"""Session helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize, shared_dir


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage
    ends here, so a lost executor costs no recomputation of what came before."""
    return materialize(df)


def tidy(scan):
    """``scan`` for mapInArrow, giving its memory back to the system when a task
    ends: Python workers outlive their tasks, and idle ones add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else (clashing or not) the table has."""
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


def in_order(df: DataFrame, place: str, *names: str) -> DataFrame:
    """The named columns and ``place``, the row's number in the order of ``df``, from 0 without gaps.

    Spark's writers number their files in the order of the rows, so the place is
    the row's index in its file behind all earlier files; no row is shuffled. Only
    a plain scan of Parquet files has such indexes for just its rows: a ``df`` of
    other origin is written and read again first. One task orders the files, a row each.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None or not plan.queryExecution().analyzed().children().isEmpty() or not df.inputFiles():
        df = stage(df)
    meta = df.metadataColumn("_metadata")
    held = df.select(*[df[f"`{n}`"].alias(n) for n in names], meta["file_path"].alias("_file"), meta["row_index"].alias("_at"))
    number = lambda rule: F.coalesce(F.regexp_extract("_file", rule, 1).try_cast("long"), F.lit(0))
    before = Window.orderBy(number(r"/part-(\d+)[^/]*$"), number(r"-c(\d+)[^/]*$"), "_file")
    files = held.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    return held.join(F.broadcast(files), "_file").select(*names, (F.col("_start") + F.col("_at")).alias(place))


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a string column, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(counts: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Of (key, n) rows those with over a ``share``-th of the sum of n, and ``parts``
    to deal their rows to. They are ``share`` keys at most, however many rows there are."""
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.join(F.broadcast(total), F.col("n") > F.col("total") / share)
    return hot.select(key, F.ceil(F.col("n") * share / F.col("total")).alias("parts"))


def dealt(df: DataFrame, hot: DataFrame, key: str, spread: bool) -> DataFrame:
    """``df`` with a salt: rows of hot keys in one part each, or in every part."""
    held = df.join(F.broadcast(hot), key, "left")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts) if spread else F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    return held.withColumn("_salt", salt).drop("parts")


def join_many(left: DataFrame, right: DataFrame, hot: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join many rows a key with one row a key; rows of hot keys go to many tasks."""
    return dealt(left, hot, key, True).join(dealt(right, hot, key, False), [key, "_salt"], how).drop("_salt")


__all__ = ["dealt", "hot_keys", "in_order", "join_many", "pick", "shared_dir", "stage", "table", "tidy", "utf8"]
