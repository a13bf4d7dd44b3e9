"""A corpus pipeline of five stages over ``documents``.

Every stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, sharding, shingles, toxicity
from tessera.llm.common import in_order, pick, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic."""
    docs = pick(docs, *COLUMNS)
    model = toxicity.train(docs, pick(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles.

    A null doc_id comes after every other; rows with equal doc_id are told apart
    by a hash of their texts, the smallest first. Of rows that share both, one
    stays.
    """
    docs = pick(docs, *COLUMNS).withColumn("_key", F.coalesce(F.xxhash64("text"), F.lit(0)))
    classes = stage(shingles.near_copies(docs, keep=("_key",)))
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("_id"), F.col("k._key").alias("_first"))
    same = lambda x, i, k: x["doc_id"].eqNullSafe(F.col(i)) & (x["_key"] == F.col(k))
    gone = stage(classes.join(first, same(classes, "_id", "_first"), "left_anti").select(F.col("doc_id").alias("_gone"), F.col("_key").alias("_gone_key")).distinct())
    if gone.count() <= decontaminate.BROADCAST_ROWS:  # then no text is shuffled
        gone = F.broadcast(gone)
    kept = docs.join(gone, same(docs, "_gone", "_gone_key"), "left_anti")
    if not classes.groupBy("doc_id", "_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(pick(docs, *COLUMNS), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixing schedule.

    Until a source runs out every prefix holds the target weights to within a
    block. From then on its slots are empty and are passed over, so the sources
    left share the order by their weights; none of their rows is held back. The
    files keep the order; sharding takes each row's place from them.
    """
    mixed = mixing.mix(pick(docs, *COLUMNS), columns=COLUMNS)
    return mixed.orderBy(F.col("mix_slot").asc_nulls_last(), "mix_offset").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard along the Hilbert curve, and its place in the mixture.

    mix_place is the document's number in the order in which mixing wrote them, from
    0 without gaps; the slots of a shard follow it. So a reader that takes, of all
    shards, the document that comes next reads the mixture, and one of some
    shards reads what they hold of it in its order.
    """
    return sharding.shard(in_order(docs, "mix_place", *COLUMNS), 40, keep=COLUMNS, place="mix_place")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
