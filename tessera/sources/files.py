"""Reading and writing CSV, Parquet and NumPy files."""

from __future__ import annotations

import io
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import QueryError

SAMPLE_ROWS = 256
DELIMITERS = ",;\t|"


def kind_of(files: list[str], options: dict) -> str:
    if "FILE_FORMAT" in options:
        return str(options["FILE_FORMAT"]).lower()
    kinds = {re.sub(r"\.(gz|zst)$", "", f).rsplit(".", 1)[-1].lower() for f in files}
    if len(kinds) > 1:
        raise QueryError("Loading files with different types is not currently supported.")
    return kinds.pop()


def sniff(spark: SparkSession, files: list[str], options: dict) -> dict:
    """Delimiter and header of a CSV from its first rows."""
    first = [r[0] for r in spark.read.text(files[0]).limit(SAMPLE_ROWS).collect() if r[0]]
    sep = options.get("DELIM", options.get("DELIMITER"))
    if sep is None:
        score = {d: (min(row.count(d) for row in first[:20]) if first else 0) for d in DELIMITERS}
        sep = max(DELIMITERS, key=lambda d: (score[d], -DELIMITERS.index(d))) if any(score.values()) else ","
    header = options.get("HEADER")
    if header is None and first:
        cells = first[0].split(sep)
        number = re.compile(r"\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$")
        rest = [r.split(sep) for r in first[1:50]]
        header = not any(number.match(c) for c in cells) and any(number.match(c) for r in rest for c in r) if options.get("AUTO_DETECT", True) else False
    return {"sep": sep, "header": bool(header)}


def skip_rows(df: DataFrame, n: int) -> DataFrame:
    """``df``, read from files, without the first ``n`` rows of each file.

    Only rows of the first block of a file are ranked; the rest stays where it is.
    """
    names = df.columns
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    head = df.where("_start = 0").withColumn("_rank", F.row_number().over(Window.partitionBy("_file").orderBy("_at")))
    return head.where(F.col("_rank") > n).select(*names).unionByName(df.where("_start > 0").select(*names))


def read_csv(spark: SparkSession, files: list[str], options: dict, schema: T.StructType | None) -> DataFrame:
    s = sniff(spark, files, options)
    r = spark.read.option("sep", s["sep"]).option("header", s["header"]).option("quote", options.get("QUOTE", '"')).option("escape", options.get("ESCAPE", '"'))
    nulls = options.get("NULL_STRINGS")
    if isinstance(nulls, str):
        r = r.option("nullValue", nulls)
    if options.get("PARALLEL") is False:
        r = r.option("multiLine", True)
    if options.get("IGNORE_ERRORS"):
        r = r.option("mode", "DROPMALFORMED")
    elif schema is not None:
        r = r.option("mode", "FAILFAST")
    skip = lambda df: skip_rows(df, int(options["SKIP"])) if options.get("SKIP") else df
    nested = schema is not None and any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)) for f in schema.fields)
    if schema is None:
        df = r.option("inferSchema", True).option("samplingRatio", float(options.get("SAMPLING_RATIO", 1.0))).csv(files)
        df = skip(df).select(*[(F.col(f"`{f.name}`").cast("long") if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`").cast("timestamp_ntz") if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")).alias(f.name if s["header"] else f"column{i}") for i, f in enumerate(df.schema.fields)])
    elif nested:
        plain = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        df = skip(r.schema(plain).csv(files))
        df = df.select(*[nested_literal(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])
    else:
        df = skip(r.schema(schema).csv(files))
    return df


def nested_literal(c, kind: T.DataType):
    """[1,2], {a: 1} and {k=v} texts as values of their type."""
    if isinstance(kind, T.BinaryType):
        return F.encode(c, "UTF-8")
    if not isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return c.cast(kind)

    @F.udf(T.StringType())
    def to_json(text):
        import json

        return None if text is None else json.dumps(parse_literal(text)[0])

    return F.from_json(to_json(c), kind)


def parse_literal(text: str, at: int = 0):
    """Value of a nested literal and the place after it."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at < len(text) and text[at] in "[{":
        close, out, keyed = {"[": "]", "{": "}"}[text[at]], [], {}
        is_list = close == "]"
        at += 1
        while at < len(text) and text[at] != close:
            key = None
            if not is_list:
                m = re.compile(r"\s*([^:=]+?)\s*[:=]").match(text, at)
                key, at = m[1], m.end()
            value, at = parse_literal(text, at)
            if is_list:
                out.append(value)
            else:
                keyed[key] = value
            while at < len(text) and (text[at].isspace() or text[at] == ","):
                at += 1
        return (out if is_list else keyed), at + 1
    if at < len(text) and text[at] in "\"'":
        end = text.index(text[at], at + 1)
        return text[at + 1 : end], end + 1
    m = re.compile(r"[^,\]}]*").match(text, at)
    raw = m[0].strip()
    if raw == "" or raw.lower() == "null":
        return None, m.end()
    try:
        return int(raw), m.end()
    except ValueError:
        try:
            return float(raw), m.end()
        except ValueError:
            return {"true": True, "false": False}.get(raw.lower(), raw), m.end()


def read_npy(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of NumPy files in order; arrays of more dimensions are lists of lists."""
    import numpy as np
    import pandas as pd

    head = spark.read.format("binaryFile").load(files[0]).select("content").first()[0]
    sample = np.load(io.BytesIO(head), mmap_mode=None)
    names = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short"}
    if sample.dtype.str[1:] not in names:
        raise QueryError(f"npy files of type {sample.dtype} are not supported")
    kind = names[sample.dtype.str[1:]]
    for _ in sample.shape[1:]:
        kind = f"array<{kind}>"

    def load(frames):
        for frame in frames:
            for content in frame["content"]:
                a = np.load(io.BytesIO(content))
                for lo in range(0, len(a), 10_000):
                    part = a[lo : lo + 10_000]
                    yield pd.DataFrame({"i": np.arange(lo, lo + len(part)), "column0": list(part.tolist())})

    return spark.read.format("binaryFile").load(files).select("content").mapInPandas(load, f"i long, column0 {kind}")


def read(spark: SparkSession, files: list[str], options: dict, schema: T.StructType | None = None) -> DataFrame:
    kind = kind_of(files, options)
    if kind == "parquet":
        df = spark.read.parquet(*files)
        return df.select(*[F.col(f"`{a}`").cast(f.dataType).alias(f.name) for a, f in zip(df.columns, schema.fields, strict=True)]) if schema is not None else df
    if kind == "npy":
        return read_npy(spark, files).drop("i")
    if kind in ("csv", "txt", "tbl"):
        return read_csv(spark, files, options, schema)
    raise QueryError(f"Cannot load from file type {kind}.")


def read_by_column(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """One NumPy file per column, zipped by row number."""
    out = None
    for f, n in zip(files, names, strict=True):
        one = read_npy(spark, [f]).withColumnRenamed("column0", n)
        out = one if out is None else out.join(one, "i")
    return out.drop("i")


def write(df: DataFrame, path: str, options: dict) -> None:
    kind = path.rsplit(".", 1)[-1].lower()
    w = df.write.mode("overwrite")
    if kind == "parquet":
        codec = str(options.get("COMPRESSION", "snappy")).lower()
        w.option("compression", {"uncompressed": "none"}.get(codec, codec)).parquet(path)
    elif kind == "csv":
        flat = df.select(*[(F.col(f"`{f.name}`") if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(F.col(f"`{f.name}`"))).alias(f.name) for f in df.schema.fields])
        w = flat.write.mode("overwrite").option("header", options.get("HEADER", True)).option("sep", options.get("DELIM", ",")).option("quote", options.get("QUOTE", '"')).option("escape", options.get("ESCAPE", '"'))
        w.option("quoteAll", bool(options.get("FORCE_QUOTE", False))).option("nullValue", options.get("NULL_STR", "")).option("emptyValue", "").csv(path)
    else:
        raise QueryError(f"Cannot export to file type {kind}.")
