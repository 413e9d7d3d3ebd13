"""Fills over an ordered index, per series (``by``) and per column.

Missing is null, NaN or an infinity.  All fills are windows over (by, idx); a
series is a partition, so many series run side by side, and one long series is a
single sorted, spillable partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_nan, missing, spare, valid

_A = (Window.unboundedPreceding, Window.currentRow)
_B = (Window.currentRow, Window.unboundedFollowing)
_Z = (Window.unboundedPreceding, Window.unboundedFollowing)


def frames(idx: str, by=()):
    """Windows up to, from and over all of the rows of a series."""
    w = Window.partitionBy(*by).orderBy(idx)
    return w.rowsBetween(*_A), w.rowsBetween(*_B), w.rowsBetween(*_Z), w


def values_of(df: DataFrame, idx: str, by=()) -> list[str]:
    return [c for c in df.columns if c != idx and c not in by]


def fill(df: DataFrame, idx: str, method, by=(), columns=None, limit: int | None = None) -> DataFrame:
    """Fill by a method or a chain of methods, in order.

    A number fills with itself.  "ffill"/"pad" and "bfill"/"backfill" carry values on,
    at most ``limit`` rows.  "ffill_na" and "ffill_0" fill up to the last valid row, then
    null or 0.  "linear" interpolates by place between valid rows and carries the last
    one on; a negative limit works from the far end.  "fnna" cuts rows before the first
    valid one, "nona" drops rows without any valid value.  ("to", t) carries values up
    to the index t and leaves nothing after it.
    """
    by = [by] if isinstance(by, str) else list(by)
    columns = list(columns or values_of(df, idx, by))
    for m in method if isinstance(method, list) else [method]:
        df = _fill(df, idx, m, by, columns, limit)
    return df


def _fill(df: DataFrame, idx: str, method, by: list, columns: list[str], limit) -> DataFrame:
    if method is None:
        return df
    a, b, z, w = frames(idx, by)
    if isinstance(method, int | float) and not isinstance(method, bool):
        return df.withColumns({c: F.when(missing(df, c), F.lit(method)).otherwise(F.col(c)) for c in columns})
    if method == "nona":
        return nona(df, idx, by, columns)
    if method == "fnna":
        return nona(df, idx, by, columns, edge=-1)
    place = spare(df, "_place")
    df = df.withColumn(place, F.row_number().over(w))
    names = {c: (spare(df, f"_v{c}"), spare(df, f"_i{c}")) for c in columns}
    step = {}
    for c, (v, i) in names.items():
        step[v] = valid(df, c)
        step[i] = F.when(~missing(df, c), F.col(place))
    df = df.withColumns(step)
    out = {}
    for c in columns:
        v, i, at = F.col(names[c][0]), F.col(names[c][1]), F.col(place)
        before, after = F.last(v, ignorenulls=True).over(a), F.first(v, ignorenulls=True).over(b)
        at_before, at_after = F.last(i, ignorenulls=True).over(a), F.first(i, ignorenulls=True).over(b)
        if method in ("ffill", "pad"):
            out[c] = before if limit is None else F.when(at - at_before <= limit, before)
        elif method in ("bfill", "backfill"):
            out[c] = after if limit is None else F.when(at_after - at <= limit, after)
        elif method in ("ffill_na", "ffill_0"):
            end = F.max(i).over(z)
            out[c] = F.when(at <= end, before).when(at > end, F.lit(0) if method == "ffill_0" else F.lit(None))
        elif method == "linear":
            inner = before + (after - before) * (at - at_before) / (at_after - at_before)
            new = F.when(v.isNotNull(), v).when(at_after.isNull(), before).when(at_before.isNotNull(), inner)
            if limit is not None and limit >= 0:
                new = F.when(at - at_before <= limit, new)
            elif limit is not None:
                new = F.when((at_after - at <= -limit) | v.isNotNull(), new)
            out[c] = new
        elif isinstance(method, tuple) and method[0] == "to":
            out[c] = F.when(F.col(idx) <= F.lit(method[1]), before)
        else:
            raise ValueError(f"no such fill: {method}")
    kinds = {c: df.schema[c].dataType for c in columns}
    if method == "linear":
        kinds = {}
    made = df.withColumns({c: x.cast(kinds[c]) if c in kinds else x for c, x in out.items()})
    return made.drop(place, *step)


def nona(df: DataFrame, idx: str, by=(), columns=None, edge: int | None = None, value=None) -> DataFrame:
    """Drop rows whose every column is missing (or equals ``value``).

    edge 1 drops them at the end of a series only, -1 at its beginning only.
    """
    by = [by] if isinstance(by, str) else list(by)
    columns = list(columns or values_of(df, idx, by))
    gone = F.lit(True)
    for c in columns:
        gone = gone & (missing(df, c) if value is None or value != value else F.col(c).eqNullSafe(F.lit(value)))
    if edge is None:
        return df.where(~gone)
    z = frames(idx, by)[2]
    ends = F.max if edge > 0 else F.min
    last = spare(df, "_edge")
    df = df.withColumn(last, ends(F.when(~gone, F.col(idx))).over(z))
    keep = F.col(idx) <= F.col(last) if edge > 0 else F.col(idx) >= F.col(last)
    return df.where(keep).drop(last)


def mask_to_value(df: DataFrame, columns, mask=None, value=0.0) -> DataFrame:
    """Replace missing cells, or those equal to ``mask`` (a value or a list)."""
    out = {}
    for c in columns:
        if mask is None or mask != mask:
            hit = missing(df, c)
        else:
            hit = F.coalesce(F.col(c).isin(*(mask if isinstance(mask, list) else [mask])), F.lit(False))
        out[c] = F.when(hit, F.lit(value)).otherwise(F.col(c))
    return df.withColumns(out)


def significant(x: Column, n: int = 1) -> Column:
    """Round to n decimals of the leading magnitude, half to even (2.3455, 1 gives 2.3)."""
    scale = F.pow(F.lit(10.0), F.bround(F.log10(F.abs(x)), 0))
    bad = x.isNull() | is_nan(x) | (x == 0)
    return F.when(bad, x).otherwise(F.signum(x) * scale * F.bround(F.abs(x) / scale, n))
