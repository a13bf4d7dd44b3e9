"""Types of the query language and their Spark counterparts."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Type names and aliases.
SCALARS = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT": T.IntegerType(), "INT64": T.LongType(), "SERIAL": T.LongType(),
    "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "INT128": T.DecimalType(38, 0), "UINT128": T.DecimalType(38, 0),
    "DOUBLE": T.DoubleType(), "FLOAT8": T.DoubleType(), "FLOAT": T.FloatType(), "FLOAT4": T.FloatType(), "REAL": T.FloatType(),
    "STRING": T.StringType(), "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(), "UUID": T.StringType(), "JSON": T.StringType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_SEC": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_NS": T.LongType(), "TIMESTAMP_TZ": T.TimestampType(),
}
INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])
UNSIGNED = {"UINT8": 2**8, "UINT16": 2**16, "UINT32": 2**32, "UINT64": 2**64, "UINT128": 2**128}


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def spark_type(text: str, aliases: dict[str, str] | None = None) -> T.DataType:
    """Spark type of a type name such as INT64, STRING[], STRUCT(a INT64, b DATE)."""
    text = text.strip()
    if m := re.fullmatch(r"(.*)\[(\d*)\]", text, re.S):
        return T.ArrayType(spark_type(m[1], aliases))
    head, _, rest = text.partition("(")
    name, inner = head.strip().upper(), rest.rstrip()[:-1]
    if name in ("INTERVAL", "DURATION"):
        return INTERVAL
    if name in ("STRUCT", "UNION"):
        fields = [x.split(None, 1) for x in _parts(inner)]
        members = [T.StructField(n, spark_type(t, aliases)) for n, t in fields]
        return T.StructType(([T.StructField("tag", T.StringType())] if name == "UNION" else []) + members)
    if name == "MAP":
        k, v = _parts(inner)
        return T.MapType(spark_type(k, aliases), spark_type(v, aliases))
    if name in ("DECIMAL", "NUMERIC"):
        p = [int(x) for x in _parts(inner)] or [18, 3]
        return T.DecimalType(p[0], p[1] if len(p) > 1 else 0)
    if name in SCALARS:
        return SCALARS[name]
    for alias, of in (aliases or {}).items():
        if alias.upper() == name:
            return spark_type(of, aliases)
    raise ValueError(f"unknown type {text}")


def type_name(t: T.DataType) -> str:
    """The language's name of a Spark type."""
    if is_interval(t):
        return "INTERVAL"
    if isinstance(t, T.ArrayType):
        return type_name(t.elementType) + "[]"
    if isinstance(t, T.MapType):
        return f"MAP({type_name(t.keyType)}, {type_name(t.valueType)})"
    if isinstance(t, T.StructType):
        if t.names[:1] == ["_ID"]:
            return "NODE"
        if t.names[:1] == ["_SRC"]:
            return "REL"
        return "STRUCT(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in t.fields) + ")"
    if isinstance(t, T.DecimalType):
        return "INT128" if (t.precision, t.scale) == (38, 0) else "UINT64" if (t.precision, t.scale) == (20, 0) else f"DECIMAL({t.precision}, {t.scale})"
    names = {T.BooleanType: "BOOL", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "STRING", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP_TZ", T.NullType: "ANY"}
    return names.get(type(t), t.simpleString().upper())


def is_interval(t: T.DataType) -> bool:
    """Whether a type is the interval struct, whatever its nullability."""
    return isinstance(t, T.StructType) and t.names == INTERVAL.names


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0


def is_num(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)
