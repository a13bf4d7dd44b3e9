"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that every executor reaches.

    In local mode a temporary folder stands in where the setting is absent; on a
    cluster there is no such folder, so the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under spark.checkpoint.dir and read it back.

    Used where a plan would otherwise grow without end (path searches) or where
    a side effect must happen once (changes of tables). The files are removed
    when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Waves:
    """Rows written level by level. All levels so far are one scan, so the plans of
    later levels look alike and Spark compiles them once."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.paths = spark, schema, []
        self.root = f"{shared_dir(spark)}/waves-{uuid.uuid4().hex}"
        remove_at_exit(spark, self.root)

    def add(self, df: DataFrame) -> int:
        """Write the next level; gives its number of rows, counted while they are written."""
        seen = Observation()
        path = f"{self.root}/{len(self.paths)}"
        df.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.paths.append(path)
        return seen.get["n"]

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def every(self, first: int = 0) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths[first:])


class Buckets:
    """Rows added time after time and kept dealt out by a hash of ``key``, so that
    grouping all of them by it shuffles none. Only what is added is shuffled."""

    def __init__(self, spark: SparkSession, key: list[str], parts: int):
        self.spark, self.key, self.parts = spark, key, parts
        self.name = f"tessera_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/buckets-{self.name}"
        remove_at_exit(spark, self.path)

    def add(self, df: DataFrame) -> int:
        """Write ``df``, dealt out already; gives its number of rows, counted while they are written."""
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        df.write.format("parquet").mode("append").bucketBy(self.parts, *self.key).option("path", self.path).saveAsTable(self.name)
        return seen.get["n"]

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.parts, *self.key)

    def every(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the name out of the catalog; the files stay until the session ends."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the session's JVM remove ``path`` when it ends."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
