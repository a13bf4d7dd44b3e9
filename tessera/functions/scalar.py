"""Scalar functions: one entry per name, from bound arguments to a Column.

An argument has ``c`` (the Column) and ``t`` (its Spark type, found lazily).
Everything stays in JVM expressions except GAMMA and LGAMMA, which have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import INTERVAL, UNSIGNED, is_int, is_interval, is_num, spark_type, type_name

REGISTRY: dict[str, Callable] = {}


def entry(*names: str):
    def put(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return put


def simple(build, *names: str) -> None:
    """An entry whose function takes plain Columns."""
    REGISTRY.update(dict.fromkeys(names, lambda s, *a: build(*(x.c for x in a))))


def L(x):  # noqa: N802
    return F.lit(x)


# ------------------------------------------------------------ arithmetic


def interval(c: Column) -> Column:
    """The fixed-length part of an interval struct as a Spark interval."""
    return F.make_dt_interval(c["days"], L(0), L(0), (c["micros"].cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def _shift(when: Column, kind: T.DataType, iv: Column, sign: int) -> Column:
    ts = when.cast("timestamp_ntz")
    moved = ts + F.make_ym_interval(L(0), iv["months"] * sign)
    moved = moved + interval(iv) * sign
    return moved.cast(kind) if isinstance(kind, T.DateType) else moved


def _is_time(t):
    return isinstance(t, (T.DateType, T.TimestampNTZType, T.TimestampType))


@entry("+")
def plus(s, a, b):
    if isinstance(a.t, T.ArrayType) or isinstance(b.t, T.ArrayType):
        return F.concat(a.c, b.c)
    if isinstance(a.t, T.StringType) or isinstance(b.t, T.StringType):
        return F.concat(a.c.cast("string"), b.c.cast("string"))
    if is_interval(a.t) and is_interval(b.t):
        return F.struct(*[(a.c[f] + b.c[f]).alias(f) for f in INTERVAL.names])
    if _is_time(a.t) and is_interval(b.t):
        return _shift(a.c, a.t, b.c, 1)
    if _is_time(b.t) and is_interval(a.t):
        return _shift(b.c, b.t, a.c, 1)
    if isinstance(a.t, T.DateType) and is_int(b.t):
        return F.date_add(a.c, b.c.cast("int"))
    if isinstance(b.t, T.DateType) and is_int(a.t):
        return F.date_add(b.c, a.c.cast("int"))
    return a.c + b.c


@entry("-")
def minus(s, a, b):
    if isinstance(a.t, T.DateType) and isinstance(b.t, T.DateType):
        return F.datediff(a.c, b.c).cast("long")
    if isinstance(a.t, T.DateType) and is_int(b.t):
        return F.date_sub(a.c, b.c.cast("int"))
    if _is_time(a.t) and is_interval(b.t):
        return _shift(a.c, a.t, b.c, -1)
    if is_interval(a.t) and is_interval(b.t):
        return F.struct(*[(a.c[f] - b.c[f]).alias(f) for f in INTERVAL.names])
    if _is_time(a.t) and _is_time(b.t):
        gap = F.unix_micros(a.c.cast("timestamp")) - F.unix_micros(b.c.cast("timestamp"))
        day = L(86_400_000_000)
        days = F.when(gap >= 0, F.floor(gap / day)).otherwise(F.ceil(gap / day))
        return F.when(gap.isNotNull(), make_interval(L(0), days, gap - days * day))
    return a.c - b.c


@entry("/")
def divide(s, a, b):
    if is_interval(a.t):
        return F.struct(*[F.floor(a.c[f] / b.c).cast(INTERVAL[f].dataType).alias(f) for f in INTERVAL.names])
    if is_int(a.t) and is_int(b.t):
        return F.call_function("div", a.c.cast("long"), b.c.cast("long")) if not isinstance(a.t, T.DecimalType) and not isinstance(b.t, T.DecimalType) else F.call_function("div", a.c, b.c)
    return a.c.cast("double") / b.c.cast("double") if isinstance(a.t, T.DecimalType) or isinstance(b.t, T.DecimalType) else a.c / b.c


simple(lambda a, b: a * b, "*", "MULTIPLY")
simple(lambda a, b: a % b, "%", "MOD")
simple(lambda a, b: F.pow(a.cast("double"), b.cast("double")), "^", "POW", "POWER")
for name, f in {"ACOS": F.acos, "ASIN": F.asin, "ATAN": F.atan, "CBRT": F.cbrt, "COS": F.cos, "COT": F.cot, "DEGREES": F.degrees, "LN": F.ln, "LOG": F.log10, "LOG10": F.log10, "LOG2": F.log2, "RADIANS": F.radians, "SIN": F.sin, "SQRT": F.sqrt, "TAN": F.tan}.items():
    simple(lambda a, f=f: f(a.cast("double")), name)
simple(lambda a, b: F.atan2(a.cast("double"), b.cast("double")), "ATAN2")
simple(lambda: F.pi(), "PI")
simple(F.abs, "ABS")
simple(F.negative, "NEGATE")
simple(lambda a, b: a.bitwiseXOR(b), "BITWISE_XOR")
simple(lambda a, b: a.bitwiseAND(b), "BITWISE_AND", "&")
simple(lambda a, b: a.bitwiseOR(b), "BITWISE_OR", "|")
REGISTRY["BITSHIFT_LEFT"] = REGISTRY["<<"] = lambda s, a, b: F.call_function("shiftleft", a.c, b.c.cast("int"))
REGISTRY["BITSHIFT_RIGHT"] = REGISTRY[">>"] = lambda s, a, b: F.call_function("shiftright", a.c, b.c.cast("int"))
simple(lambda a: F.sign(a.cast("double")).cast("long"), "SIGN")
simple(lambda a, n=None: s_round(a, n), "ROUND")


def s_round(a: Column, n: Column | None) -> Column:
    scale = F.pow(L(10.0), (n if n is not None else L(0)).cast("double"))
    x = a.cast("double") * scale
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double") / scale


@entry("CEIL", "CEILING")
def ceil(s, a):
    return F.ceil(a.c).cast(a.t)


@entry("FLOOR")
def floor(s, a):
    return F.floor(a.c).cast(a.t)


@entry("EVEN")
def even(s, a):
    x = a.c.cast("double")
    n = F.when(x >= 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(n % 2 == 0, n).when(x >= 0, n + 1).otherwise(n - 1).cast("double")


@entry("FACTORIAL")
def factorial(s, a):
    return F.when(a.c <= 1, L(1).cast("long")).otherwise(F.factorial(a.c.cast("int")))


def _special(which: str):
    import math

    import pandas as pd

    def f(x):
        return x.map(lambda v: None if pd.isna(v) else getattr(math, which)(v))

    f.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(f, "double")


REGISTRY["GAMMA"] = lambda s, a: _special("gamma")(a.c.cast("double"))
REGISTRY["LGAMMA"] = lambda s, a: _special("lgamma")(a.c.cast("double"))
REGISTRY["RANDOM"] = lambda s: F.rand(s.graph.seed) if s.graph.seed is not None else F.rand()


@entry("SETSEED")
def setseed(s, a):
    s.graph.seed = int(float(a.ast[1]) * 2**31)
    return L(None).cast("int")


# ---------------------------------------------------------------- strings

simple(F.contains, "CONTAINS")
simple(F.lower, "LOWER", "TOLOWER", "LCASE")
simple(F.upper, "UPPER", "TOUPPER", "UCASE")
simple(lambda s, n, p: F.lpad(s, n.cast("int"), p), "LPAD")
simple(lambda s, n, p: F.rpad(s, n.cast("int"), p), "RPAD")
simple(F.ltrim, "LTRIM")
simple(F.rtrim, "RTRIM")
simple(F.trim, "TRIM")
simple(F.startswith, "STARTS_WITH", "PREFIX")
simple(F.endswith, "ENDS_WITH", "SUFFIX")
simple(lambda s, n: F.repeat(s, n.cast("int")), "REPEAT")
simple(F.replace, "REPLACE")
simple(F.reverse, "REVERSE")
simple(lambda a, b: F.levenshtein(a, b).cast("long"), "LEVENSHTEIN")
simple(lambda s: F.concat(F.upper(F.left(s, L(1))), F.lower(s.substr(L(2), F.length(s)))), "INITCAP")
simple(lambda s, n: F.left(s, F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, L(0))).cast("int")), "LEFT")
simple(lambda s, n: F.right(s, F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, L(0))).cast("int")), "RIGHT")
simple(lambda s, a, n: F.when(a >= 1, s.substr(a.cast("int"), n.cast("int"))).otherwise(F.when(s.isNotNull(), L(""))), "SUBSTR", "SUBSTRING")
simple(lambda s, sep: F.split(s, F.concat(L("\\Q"), F.replace(sep, L("\\E"), L("\\E\\\\E\\Q")), L("\\E"))), "STRING_SPLIT", "STR_SPLIT", "STRING_TO_ARRAY")
simple(lambda s, d, i: F.when(i >= 1, F.split_part(s, d, F.greatest(i, L(1)).cast("int"))).otherwise(F.when(s.isNotNull(), L(""))), "SPLIT_PART")
simple(lambda sep, *a: _ws(sep, a), "CONCAT_WS")


def _ws(sep: Column, parts) -> Column:
    given = F.array_compact(F.array(*[p.cast("string") for p in parts]))
    rest = F.aggregate(F.slice(given, 2, len(parts)), L(""), lambda acc, x: F.concat(acc, sep, x))
    return F.concat(F.coalesce(F.get(given, L(0)), L("")), rest)


@entry("CONCAT")
def concat(s, *a):
    if a and isinstance(a[0].t, T.ArrayType):
        return F.concat(*[x.c for x in a])
    return F.concat(*[F.coalesce(s.text(x), L("")) for x in a])


def char_at(s: Column, i: Column) -> Column:
    n = F.length(s)
    at = F.when(i > 0, F.least(i, n)).when(i < 0, F.greatest(n + i + 1, L(1))).otherwise(L(0))
    return F.when(at < 1, F.when(s.isNotNull(), L(""))).otherwise(s.substr(at.cast("int"), L(1)))


simple(char_at, "ARRAY_EXTRACT")


def _pattern(a) -> Column:
    """Patterns double their backslashes in query texts."""
    return L(a.ast[1].replace("\\\\", "\\")) if a.ast[0] == "lit" and isinstance(a.ast[1], str) else a.c


REGISTRY["REGEXP_FULL_MATCH"] = lambda s, a, p: F.regexp_like(a.c, F.concat(L("^(?:"), _pattern(p), L(")$")))
REGISTRY["REGEXP_MATCHES"] = lambda s, a, p: F.regexp_like(a.c, _pattern(p))
REGISTRY["REGEXP_EXTRACT"] = lambda s, a, p, g=None: F.call_function("regexp_extract", a.c, _pattern(p), g.c.cast("int") if g else L(0))
REGISTRY["REGEXP_EXTRACT_ALL"] = lambda s, a, p, g=None: F.regexp_extract_all(a.c, _pattern(p), g.c.cast("int") if g else L(0))
REGISTRY["REGEXP_SPLIT_TO_ARRAY"] = lambda s, a, p: F.split(a.c, _pattern(p))


@entry("REGEXP_REPLACE")
def regexp_replace(s, a, p, r, option=None):
    import re

    if option is not None:
        if option.ast != ("lit", "g"):
            raise ValueError("regexp_replace knows the option g only")
        return F.regexp_replace(a.c, _pattern(p), L(re.sub(r"\\(\d)", r"$\1", r.ast[1])) if r.ast[0] == "lit" else r.c)
    # The first match alone: what comes before it is a group of its own, the first.
    up = lambda m: str(int(m.group(1)) + 1)
    new = L(re.sub(r"\\(\d)", lambda m: "$" + up(m), r.ast[1])) if r.ast[0] == "lit" else r.c
    pattern = L(re.sub(r"(?<!\\)((?:\\\\)*)\\([1-9])", lambda m: f"{m[1]}\\{int(m[2]) + 1}", p.ast[1].replace("\\\\", "\\"))) if p.ast[0] == "lit" and isinstance(p.ast[1], str) else p.c
    return F.regexp_replace(a.c, F.concat(L("\\A((?s:.*?))(?:"), pattern, L(")")), F.concat(L("$1"), new))


# -------------------------------------------------------- lists and vectors

simple(lambda *a: F.array(*a), "LIST_CREATION", "ARRAY_VALUE")


@entry("RANGE")
def range_(s, a, b, step=None):
    by = step.c if step else L(1)
    lo, hi = a.c.cast("long"), b.c.cast("long")
    ok = ((hi >= lo) & (by > 0)) | ((hi <= lo) & (by < 0))
    return F.when(by == 0, F.raise_error(L("Step of range cannot be 0."))).when(ok, F.sequence(lo, hi, by.cast("long"))).otherwise(F.when(ok.isNotNull(), F.array().cast("array<bigint>")))


@entry("LIST_EXTRACT", "LIST_ELEMENT")
def list_extract(s, a, i):
    if isinstance(a.t, T.StringType):
        return char_at(a.c, i.c)
    if isinstance(a.t, T.MapType):
        return a.c[i.c]
    return F.element_at(a.c, i.c.cast("int"))


simple(F.concat, "LIST_CONCAT", "LIST_CAT", "ARRAY_CONCAT", "ARRAY_CAT")
simple(F.array_append, "LIST_APPEND", "ARRAY_APPEND", "ARRAY_PUSH_BACK")
simple(F.array_prepend, "LIST_PREPEND", "ARRAY_PREPEND", "ARRAY_PUSH_FRONT")
simple(lambda a, x: F.array_position(a, x), "LIST_POSITION", "LIST_INDEXOF", "ARRAY_POSITION", "ARRAY_INDEXOF")
simple(lambda a, x: F.when(a.isNotNull() & x.isNotNull(), F.coalesce(F.array_contains(a, x), L(False))), "LIST_CONTAINS", "LIST_HAS", "ARRAY_CONTAINS", "ARRAY_HAS")


def slice_of(c: Column, n: Column, low: Column | None, high: Column | None) -> tuple[Column, Column]:
    """Normalised first place and length of an inclusive 1-based slice."""
    lo = L(1) if low is None else F.when(low <= 0, 1).otherwise(low)
    hi = n if high is None else F.when(high < 0, n + high + 1).otherwise(F.least(high, n))
    return lo.cast("int"), F.greatest(hi - lo + 1, L(0)).cast("int")


@entry("LIST_SLICE", "ARRAY_SLICE")
def list_slice(s, a, low=None, high=None):
    if isinstance(a.t, T.StringType):
        lo, n = slice_of(a.c, F.length(a.c), low and low.c, high and high.c)
        return a.c.substr(lo, n)
    lo, n = slice_of(a.c, F.size(a.c), low and low.c, high and high.c)
    return F.when(a.c.isNotNull(), F.slice(a.c, lo, n))


def _sorted(a, down: bool, last: bool) -> Column:
    nulls = F.filter(a.c, lambda x: x.isNull())
    rest = F.sort_array(F.array_compact(a.c), not down)
    return F.concat(rest, nulls) if last else F.concat(nulls, rest)


@entry("LIST_SORT", "ARRAY_SORT")
def list_sort(s, a, order=None, nulls=None):
    return _sorted(a, order is not None and order.ast[1].upper() == "DESC", nulls is not None and nulls.ast[1].upper() == "NULLS LAST")


REGISTRY["LIST_REVERSE_SORT"] = lambda s, a, nulls=None: _sorted(a, True, nulls is not None and nulls.ast[1].upper() == "NULLS LAST")


def _fold(a, start, f) -> Column:
    kind = "double" if not is_int(a.t.elementType) else "long"
    return F.when(a.c.isNotNull(), F.aggregate(F.array_compact(a.c), L(start).cast(kind), lambda x, y: f(x, y.cast(kind))))


REGISTRY["LIST_SUM"] = lambda s, a: _fold(a, 0, lambda x, y: x + y)
REGISTRY["LIST_PRODUCT"] = lambda s, a: _fold(a, 1, lambda x, y: x * y)
simple(lambda a: F.array_distinct(F.array_compact(a)), "LIST_DISTINCT")
simple(lambda a: F.size(F.array_distinct(F.array_compact(a))).cast("long"), "LIST_UNIQUE")
simple(lambda a: F.get(F.array_compact(a), L(0)), "LIST_ANY_VALUE")
simple(F.reverse, "LIST_REVERSE")
simple(lambda a, b: F.size(F.array_except(F.array_compact(b), a)) == 0, "LIST_HAS_ALL", "ARRAY_HAS_ALL")


@entry("SIZE", "CARDINALITY", "LEN")
def size(s, a):
    return (F.length(a.c) if isinstance(a.t, T.StringType) else F.when(a.c.isNotNull(), F.size(a.c))).cast("long")


REGISTRY["LIST_TO_STRING"] = lambda s, sep, a: s.join_text(a, sep.c)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), L(0.0), lambda x, y: x + y)


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), L(0.0), lambda x, y: x + y)


simple(lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]), "ARRAY_CROSS_PRODUCT")
simple(lambda a, b: _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), "ARRAY_COSINE_SIMILARITY")
simple(lambda a, b: F.sqrt(_square(a, b)), "ARRAY_DISTANCE")
simple(_square, "ARRAY_SQUARED_DISTANCE")
simple(_dot, "ARRAY_INNER_PRODUCT", "ARRAY_DOT_PRODUCT")

# ------------------------------------------------------------------- casts


def parse_interval(c: Column) -> Column:
    """'1 year 2 months 3 days 4 hours 05:06:07.5 us' and the like."""
    n = lambda unit: F.coalesce(F.nullif(F.regexp_extract(c, rf"(?i)(-?\d+)\s*(?:{unit})\b", 1), L("")).cast("long"), L(0).cast("long"))
    clock = [F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+):(\d+):(\d+(?:\.\d+)?)", i), L("")).cast("double"), L(0.0)) for i in (1, 2, 3)]
    months = n("years?|y|year") * 12 + n("months?|mons?|mon")
    days = n("weeks?|w") * 7 + n("days?|d")
    micros = n("hours?|h|hrs?") * 3_600_000_000 + n("minutes?|mins?|m") * 60_000_000 + n("seconds?|secs?|s") * 1_000_000 + n("milliseconds?|ms") * 1000 + n("microseconds?|us")
    exact = (clock[0] * 3600e6 + clock[1] * 60e6 + F.round(clock[2] * 1e6)).cast("long")
    return F.when(c.isNotNull(), make_interval(months, days, micros + exact))


def make_interval(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def unescape_blob(c: Column) -> Column:
    """\\xNN escapes of a string literal to bytes."""
    pieces = F.regexp_extract_all(c, L(r"(\\x[0-9A-Fa-f]{2}|[\s\S])"), L(1))
    return F.aggregate(pieces, L(b"").cast("binary"), lambda acc, p: F.concat(acc, F.when((F.length(p) == 4), F.unhex(p.substr(3, 2))).otherwise(p.cast("binary"))))


def cast_to(s, a, name: str) -> Column:
    """CAST of a bound argument to a named type."""
    upper = name.upper().strip()
    kind = spark_type(name, s.graph.catalog.types)
    if upper in UNSIGNED:
        top = UNSIGNED[upper]
        wide = a.c.cast("decimal(38,0)") if upper != "UINT128" else a.c.cast(kind)
        return F.when((wide < 0) | (wide >= L(str(top if upper != "UINT128" else 10**37)).cast("decimal(38,0)")), F.raise_error(L(f"value is not within the range of {upper}"))).otherwise(wide).cast(kind)
    if is_interval(kind) and isinstance(a.t, T.StringType):
        return parse_interval(a.c)
    if isinstance(kind, T.StringType):
        if upper == "UUID":
            ok = F.regexp_like(a.c, L("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))
            return F.when(ok, F.lower(a.c)).when(a.c.isNotNull(), F.raise_error(L("Invalid UUID")))
        return s.text(a)
    if isinstance(kind, T.BinaryType) and isinstance(a.t, T.StringType):
        return unescape_blob(a.c)
    if isinstance(kind, T.DateType) and isinstance(a.t, T.StringType):
        return F.to_date(a.c)
    if is_int(kind) and isinstance(a.t, (T.DoubleType, T.FloatType)):
        return F.when(a.c.isNotNull(), F.rint(a.c)).cast(kind)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) and isinstance(a.t, T.StringType):
        return F.from_json(a.c, kind)
    return a.c.cast(kind)


for name, target in {"TO_DATE": "DATE", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TO_INTERVAL": "INTERVAL", "INTERVAL": "INTERVAL", "DURATION": "INTERVAL", "TO_STRING": "STRING", "STRING": "STRING", "TO_BLOB": "BLOB", "BLOB": "BLOB", "TO_UUID": "UUID", "UUID": "UUID", "TO_DOUBLE": "DOUBLE", "TO_FLOAT": "FLOAT", "TO_SERIAL": "SERIAL", "TO_BOOL": "BOOL"}.items():
    REGISTRY[name] = lambda s, a, target=target: cast_to(s, a, target)
for name in ("INT64", "INT32", "INT16", "INT8", "UINT64", "UINT32", "UINT16", "UINT8", "INT128", "UINT128"):
    REGISTRY[f"TO_{name}"] = lambda s, a, name=name: cast_to(s, a, name)
REGISTRY["CAST"] = lambda s, a, t: cast_to(s, a, t.ast[1])

# -------------------------------------------------------- dates and intervals


def _part(s, part, a) -> Column:
    p = part.ast[1].lower()
    if is_interval(a.t):
        c = a.c
        of = {"year": F.floor(c["months"] / 12), "month": c["months"] % 12, "day": c["days"], "hour": F.floor(c["micros"] / 3_600_000_000), "minute": F.floor(c["micros"] / 60_000_000) % 60, "second": F.floor(c["micros"] / 1_000_000) % 60, "millisecond": F.floor(c["micros"] / 1000) % 60_000, "microsecond": c["micros"] % 60_000_000}
        return of[p.rstrip("s")].cast("long")
    year = F.year(a.c)
    if p in ("century", "centuries"):
        return F.ceil(year / 100).cast("long")
    if p in ("millennium", "millenniums"):
        return F.ceil(year / 1000).cast("long")
    if p in ("decade", "decades"):
        return F.floor(year / 10).cast("long")
    if p in ("dow", "dayofweek"):
        return (F.dayofweek(a.c) - 1).cast("long")
    if p.startswith("millisecond"):
        return F.floor(F.date_part(L("second"), a.c) * 1000).cast("long")
    if p.startswith("microsecond"):
        return F.floor(F.date_part(L("second"), a.c) * 1_000_000).cast("long")
    return F.floor(F.date_part(L(p), a.c)).cast("long")


REGISTRY["DATE_PART"] = REGISTRY["DATEPART"] = _part


@entry("DATE_TRUNC", "DATETRUNC")
def date_trunc(s, part, a):
    p = part.ast[1].lower()
    step = {"decade": 10, "century": 100, "millennium": 1000}.get(p)
    if step:
        out = F.make_date((F.floor(F.year(a.c) / step) * step).cast("int"), L(1), L(1))
    else:
        out = F.date_trunc(p, a.c.cast("timestamp"))
    return out.cast("date") if isinstance(a.t, T.DateType) else out.cast("timestamp_ntz")


simple(lambda d: F.date_format(d, "EEEE"), "DAYNAME")
simple(lambda d: F.date_format(d, "MMMM"), "MONTHNAME")
simple(F.last_day, "LAST_DAY")
simple(lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")), "MAKE_DATE")
simple(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), "GREATEST")
simple(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "LEAST")
simple(lambda: F.current_date(), "CURRENT_DATE")
simple(lambda: F.current_timestamp(), "CURRENT_TIMESTAMP")
simple(lambda t: F.ceil(F.year(t) / 100).cast("long"), "CENTURY")
simple(lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz"), "EPOCH_MS")
simple(lambda sec: F.timestamp_micros(F.round(sec.cast("double") * 1e6).cast("long")).cast("timestamp_ntz"), "TO_TIMESTAMP")
simple(lambda t: F.unix_millis(t.cast("timestamp")), "TO_EPOCH_MS")


@entry("TIME_BUCKET")
def time_bucket(s, width, a):
    w, micros = width.c, F.unix_micros(a.c.cast("timestamp"))
    size = w["days"].cast("long") * 86_400_000_000 + w["micros"]
    fixed = F.timestamp_micros(micros - F.pmod(micros, size)).cast("timestamp_ntz")
    month = F.year(a.c) * 12 + F.month(a.c) - 1 - 1970 * 12
    start = month - F.pmod(month, w["months"]) + 1970 * 12
    monthly = F.make_date(F.floor(start / 12).cast("int"), (start % 12 + 1).cast("int"), L(1)).cast("timestamp_ntz")
    out = F.when(w["months"] > 0, monthly).otherwise(fixed)
    return out.cast("date") if isinstance(a.t, T.DateType) else out


for name, (field, by) in {"TO_YEARS": ("months", 12), "TO_MONTHS": ("months", 1), "TO_DAYS": ("days", 1), "TO_HOURS": ("micros", 3_600_000_000), "TO_MINUTES": ("micros", 60_000_000), "TO_SECONDS": ("micros", 1_000_000), "TO_MILLISECONDS": ("micros", 1000), "TO_MICROSECONDS": ("micros", 1)}.items():
    simple(lambda n, field=field, by=by: F.when(n.isNotNull(), make_interval(*[(n * by if f == field else L(0)) for f in INTERVAL.names])), name)

# ------------------------------------- blobs, structs, maps, unions, the rest

simple(lambda b: F.octet_length(b).cast("long"), "OCTET_LENGTH")
simple(lambda x: F.encode(x, "UTF-8"), "ENCODE")
simple(lambda b: F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).when(b.isNotNull(), F.raise_error(L("Failure in decode: could not convert blob to UTF8 string"))), "DECODE")
simple(lambda: F.uuid(), "GEN_RANDOM_UUID")
REGISTRY["STRUCT_PACK"] = lambda s, *a: F.struct(*[x.c.alias(x.ast[1]) for x in a])
simple(F.map_from_arrays, "MAP")
simple(lambda m, k: F.coalesce(F.transform(F.filter(F.map_entries(m), lambda e: e["key"] == k), lambda e: e["value"]), F.transform(F.slice(F.map_values(m), 1, 0), lambda x: x)), "MAP_EXTRACT", "ELEMENT_AT")
simple(F.map_keys, "MAP_KEYS")
simple(F.map_values, "MAP_VALUES")
REGISTRY["UNION_VALUE"] = lambda s, a: F.struct(L(a.ast[1]).alias("tag"), a.c.alias(a.ast[1]))
simple(lambda u: u["tag"], "UNION_TAG")
REGISTRY["UNION_EXTRACT"] = lambda s, u, k: u.c[k.ast[1]] if k.ast[1] in u.t.names else L(None)
simple(F.md5, "MD5")
simple(lambda x: F.sha2(x, 256), "SHA256")
simple(F.xxhash64, "HASH")
simple(F.coalesce, "COALESCE")
simple(F.ifnull, "IFNULL")
simple(lambda a, b: F.when(b.isNotNull(), a), "CONSTANT_OR_NULL")
simple(lambda x: F.when(x.cast("double") != 0, 1).otherwise(0).cast("short"), "COUNT_IF")
simple(F.raise_error, "ERROR")
simple(F.nullif, "NULLIF")
REGISTRY["TYPEOF"] = lambda s, a: L(type_name(a.t))
simple(lambda a, b: F.struct(a.cast("int").alias("table"), b.cast("long").alias("offset")), "INTERNAL_ID")
REGISTRY["CURRVAL"] = lambda s, a: L(s.graph.catalog.sequence(a.ast[1]).current()).cast("long")
REGISTRY["NEXTVAL"] = lambda s, a: L(s.graph.catalog.sequence(a.ast[1]).advance()).cast("long")  # of one row; project.number_rows serves many
simple(lambda a, b: a == b, "EQUALS")
simple(lambda a, b: a != b, "NOT_EQUALS")
simple(lambda a, b: a > b, "GREATER_THAN")
simple(lambda a, b: a >= b, "GREATER_THAN_EQUALS")
simple(lambda a, b: a < b, "LESS_THAN")
simple(lambda a, b: a <= b, "LESS_THAN_EQUALS")
simple(lambda x: F.to_json(x), "TO_JSON")
simple(lambda x, p: F.get_json_object(x, F.concat(L("$."), p)), "JSON_EXTRACT")


def numeric(t: T.DataType) -> bool:
    return is_num(t)
