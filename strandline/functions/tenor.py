"""Years between dates, tenors in years, and interpolation of curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import overflow

# Parts of a year by unit of a tenor.
YEARS = {"y": 1.0, "q": 1 / 4, "m": 1 / 12, "w": 1 / 52, "d": 1 / 365, "b": 1 / 252}
# Named tenors in years.
NAMED_YEARS = {"spot": 0.0, "sn": 1 / 365, "tn": 2 / 365, "s/n": 1 / 365, "t/n": 2 / 365}


def years_between(t0: Column, t1: Column) -> Column:
    """Whole years; an anniversary that overflows its month counts on its later day."""
    n = F.year(t1) - F.year(t0)
    return F.when(overflow(t0, n * 12) > t1, n - 1).otherwise(n)


def years_to_date(t: Column, maturity: Column) -> Column:
    """Whole years, and the days from the stamp to the maturity that many years earlier by 365."""
    n = years_between(t, maturity)
    return n + F.datediff(overflow(maturity, -n * 12), t) / F.lit(365.0)


def tenor_years(text: Column) -> Column:
    """Years of a tenor text such as "3m", "2y" or "spot"; null otherwise."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^([+-]?\d+(?:\.\d+)?)[yqmwdb]$", 1).try_cast("double")
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in YEARS.items() for x in kv]), F.substring(t, -1, 1))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMED_YEARS.items() for x in kv]), t)
    return F.coalesce(named, n * unit, t.try_cast("double"))


def on_grid(xs: list, ys: list, x: Column, outside: str | float | None = None) -> Column:
    """Interpolation in fixed points: one CASE of straight lines, without arrays."""
    points = [(float(a), float(b)) for a, b in zip(xs, ys, strict=True) if b is not None and b == b]
    if len(points) < 2:
        return F.lit(None).cast("double")
    line = lambda p, q: F.lit(p[1]) + (x - p[0]) * F.lit(q[1] - p[1]) / F.lit(q[0] - p[0])
    out = line(points[-2], points[-1])
    for p, q in reversed(list(zip(points[:-1], points[1:-1], strict=False))):
        out = F.when(x < q[0], line(p, q)).otherwise(out)
    if outside != "extrapolate":
        low, high = (points[0][1], points[-1][1]) if outside == "bound" else (outside, outside)
        out = F.when(x < points[0][0], F.lit(low).cast("double")).when(x > points[-1][0], F.lit(high).cast("double")).otherwise(out)
    return F.when(x.isNotNull(), out)


def interpolate(xs: Column | list, ys: Column | list, x: Column, outside: str | float | None = None) -> Column:
    """Linear interpolation in two arrays, xs ascending; points without a value are left out.

    Outside of the points: null, a number, "bound" (the end's value) or "extrapolate".
    Fewer than two points give null.  Points that are Python lists become one CASE.
    """
    if isinstance(xs, list):
        return on_grid(xs, ys, x, outside)
    points = F.filter(F.arrays_zip(xs.alias("a"), ys.alias("b")), lambda p: p["b"].isNotNull() & ~F.isnan(p["b"].cast("double")))
    points = F.transform(points, lambda p: F.struct(p["a"].cast("double").alias("a"), p["b"].cast("double").alias("b")))
    n = F.size(points)
    below = F.size(F.filter(points, lambda p: p["a"] <= x))
    at = F.greatest(F.least(below, n - 1), F.lit(1))
    p, q = F.get(points, at - 1), F.get(points, at)
    line = p["b"] + (q["b"] - p["b"]) * (x - p["a"]) / F.nullif(q["a"] - p["a"], F.lit(0.0))
    first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
    if outside == "extrapolate":
        out = line
    else:
        low = first["b"] if outside == "bound" else F.lit(None if outside is None else outside).cast("double")
        high = last["b"] if outside == "bound" else low
        out = F.when(x < first["a"], low).when(x > last["a"], high).otherwise(line)
    return F.when(n >= 2, out)


def interpolate_kind(df: DataFrame, xs: str, ys: str, x: str, out: str, kind: str = "cubic") -> DataFrame:
    """"nearest", "previous", "next" or natural "cubic" interpolation per row, in numpy batches."""
    import numpy as np
    import pandas as pd

    def one(a, b, at):
        a, b = np.asarray(a, float), np.asarray(b, float)
        ok = ~np.isnan(b)
        a, b = a[ok], b[ok]
        if len(a) < 2 or at is None or not a[0] <= at <= a[-1]:
            return np.nan
        i = int(np.clip(np.searchsorted(a, at, "right") - 1, 0, len(a) - 2))
        if kind == "previous":
            return b[i + 1] if at == a[-1] else b[i]
        if kind == "next":
            return b[i] if at == a[i] else b[i + 1]
        if kind == "nearest":
            return b[i] if at - a[i] <= a[i + 1] - at else b[i + 1]
        h = np.diff(a)
        m = np.diag(np.r_[1.0, 2 * (h[:-1] + h[1:]), 1.0]) + np.diag(np.r_[0.0, h[1:]], 1) + np.diag(np.r_[h[:-1], 0.0], -1)
        d = np.r_[0.0, 6 * np.diff(np.diff(b) / h), 0.0]
        s = np.linalg.solve(m, d)
        t, w = at - a[i], h[i]
        return s[i] * (w - t) ** 3 / (6 * w) + s[i + 1] * t**3 / (6 * w) + (b[i] / w - s[i] * w / 6) * (w - t) + (b[i + 1] / w - s[i + 1] * w / 6) * t

    if kind not in ("nearest", "previous", "next", "cubic"):
        raise ValueError(f"no such kind: {kind}")

    run = F.pandas_udf(lambda a, b, at: pd.Series([one(p, q, r) for p, q, r in zip(a, b, at, strict=True)], dtype=float), "double")
    return df.withColumn(out, F.nanvl(run(xs, ys, F.col(x).cast("double")), F.lit(None).cast("double")))
