"""Equality with missing values, nearness, membership, and a total order over mixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import INF


def equal(a: Column, b: Column) -> Column:
    """Null equals null and NaN equals NaN; never null."""
    return a.eqNullSafe(b)


def near(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Numbers within ``eps``; missing values are near their like."""
    close = F.abs(a - b) < eps
    return F.coalesce(close, F.lit(False)) | equal(a, b)


def member(c: Column, values: list) -> Column:
    """Membership that knows null and NaN; never null."""
    hit = F.lit(False)
    for v in values:
        hit = hit | (c.isNull() if v is None else equal(c, F.lit(v)))
    return hit


#: Ranks of kinds in the order of a mixed column: the names of the kinds as text.
KINDS = ("NoneType", "bool", "datetime", "number", "str")


def mixed(c: Column) -> Column:
    """The order key of a VARIANT cell: like ``tagged``, the kind read from the cell itself.

    Whole numbers and fractions are one kind; text that is not of another kind is text.
    """
    name = F.schema_of_variant(c)
    kind = (
        F.when(c.isNull() | (name == "VOID"), "NoneType")
        .when(name == "BOOLEAN", "bool")
        .when(name.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), "datetime")
        .when(name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "number")
        .otherwise("str")
    )
    number = F.when(kind == "bool", F.try_variant_get(c, "$", "boolean").cast("double")).when(kind == "number", F.try_variant_get(c, "$", "double"))
    number = F.when(F.isnan(number) | (F.abs(number) == INF), F.lit(INF)).otherwise(number)
    stamp = F.when(kind == "datetime", F.try_variant_get(c, "$", "timestamp_ntz"))
    text = F.when(kind == "str", F.try_variant_get(c, "$", "string"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int") - 1
    return F.struct(rank.alias("rank"), number.alias("number"), stamp.alias("stamp"), text.alias("text"))


def tagged(kind: str, value: Column) -> Column:
    """A cell of a mixed column: its kind's rank, then number, stamp and text.

    Structs order field by field, so such a column sorts by kind and then by value;
    NaN and infinities count as the greatest number.
    """
    number = value.cast("double") if kind in ("bool", "number") else F.lit(None).cast("double")
    if kind == "number":
        number = F.when(F.isnan(number) | (F.abs(number) == INF), F.lit(INF)).otherwise(number)
    stamp = value.cast("timestamp_ntz") if kind == "datetime" else F.lit(None).cast("timestamp_ntz")
    text = value if kind == "str" else F.lit(None).cast("string")
    rank = F.when(value.isNull(), 0).otherwise(KINDS.index(kind))
    return F.struct(rank.alias("rank"), number.alias("number"), stamp.alias("stamp"), text.alias("text"))
