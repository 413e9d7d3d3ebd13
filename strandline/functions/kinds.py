"""Tests of column types, and casts to the types that the engine works with."""

from __future__ import annotations

import datetime
import enum
import json
import re
import zoneinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.FractionalType)


def is_num(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_str(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_tree(t: T.DataType, depth: int = 1) -> bool:
    """Maps (or structs) of at least a depth."""
    if depth == 0:
        return True
    if isinstance(t, T.MapType):
        return is_tree(t.valueType, depth - 1)
    return isinstance(t, T.StructType) and any(is_tree(f.dataType, depth - 1) for f in t)


def is_primitive(t: T.DataType) -> bool:
    return is_num(t) or is_bool(t) or is_str(t) or is_date(t) or isinstance(t, T.NullType)


def is_regex(value) -> bool:
    return isinstance(value, re.Pattern)


def is_jsonable(value) -> bool:
    """Whether a Python value can be written as JSON."""
    try:
        json.dumps(value)
    except (TypeError, ValueError):
        return False
    return True


def is_zone(value) -> bool:
    """Whether a value names or is a time zone."""
    if isinstance(value, datetime.tzinfo):
        return True
    return isinstance(value, str) and value in zoneinfo.available_timezones()


def primitive(value):
    """A plain Python value: members of enums by value, stamps as ISO text, numpy scalars and
    arrays unpacked, containers element by element."""
    if isinstance(value, enum.Enum):
        return primitive(value.value)
    if isinstance(value, dict):
        return {k: primitive(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [primitive(v) for v in value]
    if isinstance(value, datetime.date | datetime.time):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return primitive(value.tolist())
    return value


def as_list(value, none: bool = False) -> list:
    """A list of a value; None is the empty list, or [None] where ``none`` is set."""
    if value is None:
        return [None] if none else []
    if isinstance(value, str | bytes | dict):
        return [value]
    return list(value) if hasattr(value, "__iter__") else [value]


def as_tuple(value, none: bool = False) -> tuple:
    return tuple(as_list(value, none))


def series_columns(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema if test(f.dataType)]


def is_series(df: DataFrame) -> bool:
    """Whether the first column is a time index."""
    return bool(df.columns) and is_date(df.schema[0].dataType)


def floats(df: DataFrame, *names: str, keep: tuple[str, ...] = (), to: str = "double") -> DataFrame:
    """Integer columns as floating ones (booleans stay), as kernels that use NaN need."""
    names = names or tuple(series_columns(df, is_int))
    return df.withColumns({n: F.col(n).cast(to) for n in names if n not in keep and is_int(kind(df, n))})
