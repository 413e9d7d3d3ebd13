"""One definition of a missing value: null, NaN or an infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def spare(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, for working columns."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def is_nan(c: Column) -> Column:
    """NaN or an infinity, never null itself; for floating columns."""
    return F.coalesce(F.isnan(c) | (F.abs(c) == INF), F.lit(False))


def missing(df: DataFrame, name: str) -> Column:
    """Whether a column's value is missing, by the column's type."""
    c = F.col(name)
    return c.isNull() | is_nan(c) if is_float(df.schema[name].dataType) else c.isNull()


def valid(df: DataFrame, name: str) -> Column:
    """The column with missing values as null."""
    return F.when(~missing(df, name), F.col(name))


def clean(df: DataFrame, *names: str) -> DataFrame:
    """The frame with NaN and infinities as null in the named (else all floating) columns."""
    names = names or tuple(f.name for f in df.schema if is_float(f.dataType))
    return df.withColumns({n: valid(df, n) for n in names})


def text_to_null(c: Column) -> Column:
    """Sheet cells that mean nothing (blank, "#...", "n/a") as null."""
    t = F.trim(c)
    return F.when((t != "") & ~t.startswith("#") & (F.lower(t) != "n/a"), c)


def all_of(array: Column, test) -> Column:
    """True if an array is not empty and every element passes."""
    return (F.size(array) > 0) & F.forall(array, test)
