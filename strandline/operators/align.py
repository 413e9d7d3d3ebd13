"""Aligned time series: joint indexes, as-of reads, element-wise and horizontal operators.

A series is a frame with an index column, optional keys (``by``) and value columns.
Policies are named by their first letter: inner, outer, left, right.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_float, is_nan, spare, valid
from .fill import fill, frames, nona, values_of
from .joins import null_safe

_HOW = {"i": "inner", "o": "full", "l": "left", "r": "right"}


def joint_columns(lists: list[list[str]], policy: str = "inner") -> list[str]:
    """The common column list of several frames by a policy."""
    first = policy[0]
    if first == "l":
        return list(lists[0])
    if first == "r":
        return list(lists[-1])
    if first == "i":
        return [c for c in lists[0] if all(c in x for x in lists[1:])]
    return list(dict.fromkeys(c for x in lists for c in x))


def joint_index(series: list[DataFrame], idx: str, policy: str | DataFrame = "inner", by=()) -> DataFrame:
    """Distinct index rows by a policy, or those of a given frame."""
    keys = [*by, idx]
    if isinstance(policy, DataFrame):
        return policy.select(*keys).distinct()
    parts = [s.select(*keys).distinct() for s in series]
    first = policy[0]
    if first == "l":
        return parts[0]
    if first == "r":
        return parts[-1]
    if first == "i":
        return reduce(lambda a, b: null_safe(a, b, keys, "left_semi"), parts)
    return reduce(DataFrame.union, parts).distinct()


def recolumn(df: DataFrame, columns: list[str], idx: str, by=(), default=None) -> DataFrame:
    """Exactly the given value columns; those that lack become ``default``."""
    return df.select(*by, idx, *[F.col(c) if c in df.columns else F.lit(default).cast("double").alias(c) for c in columns])


def reindex(df: DataFrame, index: DataFrame, idx: str, by=(), method=None, limit: int | None = None) -> DataFrame:
    """The series at the rows of ``index``, then filled.

    A forward or backward fill reads as of the index: for every column the last (next)
    valid value of the series, also between index rows.  A limit counts index rows
    without a value of their own.  Other methods fill what the plain lookup lacks.
    """
    by = list(by)
    keys = [*by, idx]
    columns = values_of(df, idx, by)
    index = index.select(*keys).distinct()
    chain = method if isinstance(method, list) else [method]
    if chain[0] not in ("ffill", "pad", "bfill", "backfill"):
        out = null_safe(index, df, keys, "left").select(*keys, *columns)
        return fill(out, idx, method, by, columns, limit)
    ahead = chain[0] in ("ffill", "pad")
    clean = df.select(*keys, *[valid(df, c).alias(c) for c in columns])
    target, place, many = (spare(df, n) for n in ("_target", "_order", "_many"))
    marked = clean.withColumn(target, F.lit(0))
    both = marked.unionByName(index.withColumn(target, F.lit(1)), allowMissingColumns=True)
    # at equal stamps the series' row stands before the index's on the side it is read from
    order = F.struct(F.col(idx), F.col(target) if ahead else -F.col(target))
    both = both.withColumn(place, order)
    a, b, _, w = frames(place, by)
    span, pick = (a, F.last) if ahead else (b, F.first)
    out = {c: pick(F.col(c), ignorenulls=True).over(span) for c in columns}
    if limit is not None:
        both = both.withColumn(many, F.sum(target).over(a))
        for c in columns:
            at = pick(F.when(F.col(c).isNotNull(), F.col(many)), ignorenulls=True).over(span)
            gap = F.col(many) - at if ahead else at - F.col(many) + 1
            own = F.max(F.when(F.col(c).isNotNull(), 1)).over(_peers(idx, by))
            out[c] = F.when(own.isNotNull() | (gap <= limit), out[c])
    filled = both.withColumns(out).where(F.col(target) == 1).select(*keys, *columns)
    return fill(filled, idx, chain[1:], by, columns, limit) if chain[1:] else filled


def _peers(idx: str, by):
    from pyspark.sql import Window

    return Window.partitionBy(*by, idx)


def recent(left: DataFrame, right: DataFrame, idx: str, by=()) -> DataFrame:
    """As-of join: every row of the left series with the last values of the right one."""
    got = reindex(right, left, idx, by, "ffill")
    return null_safe(left, got, [*by, idx], "left")


def sync(series: list[DataFrame], idx: str, join="inner", method=None, columns: str | None = "inner", by=()) -> list[DataFrame]:
    """All series on one index, and on one list of columns unless ``columns`` is None."""
    index = joint_index(series, idx, join, by)
    names = joint_columns([values_of(s, idx, by) for s in series], columns) if columns else None
    out = [reindex(s, index, idx, by, method) for s in series]
    return [recolumn(s, names, idx, by) for s in out] if names is not None else out


def hconcat(series: dict[str, DataFrame], idx: str, join="outer", method=None, by=(), limit=None) -> DataFrame:
    """Series side by side; a single value column takes the series' name, others get it as prefix."""
    parts = []
    for name, s in series.items():
        cols = values_of(s, idx, by)
        names = {c: name if len(cols) == 1 else f"{name}_{c}" for c in cols}
        parts.append(s.withColumnsRenamed(names))
    how = _HOW[join[0]]
    out = reduce(lambda a, b: a.join(b, [*by, idx], how), parts)
    return fill(out, idx, method, by, None, limit) if method is not None else out


def vconcat(series: list[DataFrame], columns: str = "outer", idx: str = "idx", by=()) -> DataFrame:
    """Series one below the other, on a common list of columns."""
    names = joint_columns([values_of(s, idx, by) for s in series], columns)
    return reduce(DataFrame.unionByName, [recolumn(s, names, idx, by) for s in series])


# -- element-wise -----------------------------------------------------------------
def _nan_to_null(df: DataFrame, c: str) -> Column:
    return valid(df, c) if c in df.columns and is_float(df.schema[c].dataType) else F.col(c)


def _operands(a, b, idx, join, method, columns, by, default):
    """One wide frame and, for each result column, the two operands."""
    frames_ = [x for x in (a, b) if isinstance(x, DataFrame)]
    if not frames_:
        raise ValueError("one operand must be a series")
    if len(frames_) == 1:
        s = frames_[0]
        cols = values_of(s, idx, by)
        side = lambda x, c: _nan_to_null(s, c) if isinstance(x, DataFrame) else F.lit(x)
        return s, {c: (side(a, c), side(b, c)) for c in cols}
    ca, cb = values_of(a, idx, by), values_of(b, idx, by)
    index = joint_index([a, b], idx, join, by) if method is not None or not isinstance(join, str) else None
    if index is not None:
        a, b, how = reindex(a, index, idx, by, method), reindex(b, index, idx, by, method), "inner"
    else:
        how = _HOW[join[0]]
    x = a.select(*by, idx, *[_nan_to_null(a, c).alias(f"_a{c}") for c in ca])
    y = b.select(*by, idx, *[_nan_to_null(b, c).alias(f"_b{c}") for c in cb])
    wide = x.join(y, [*by, idx], how)
    if len(ca) == 1 and len(cb) == 1 and ca != cb:
        return wide, {ca[0]: (F.col(f"_a{ca[0]}"), F.col(f"_b{cb[0]}"))}
    if len(ca) == 1 and len(cb) > 1:
        return wide, {c: (F.col(f"_a{ca[0]}"), F.col(f"_b{c}")) for c in cb}
    if len(cb) == 1 and len(ca) > 1:
        return wide, {c: (F.col(f"_a{c}"), F.col(f"_b{cb[0]}")) for c in ca}
    names = joint_columns([ca, cb], columns)
    pick = lambda p, have, c: F.col(f"{p}{c}") if c in have else F.lit(default)
    return wide, {c: (pick("_a", ca, c), pick("_b", cb, c)) for c in names}


def apply(kernel: Callable, a, b, idx: str = "idx", join="inner", method=None, columns="inner", by=(), default=None) -> DataFrame:
    """A function of two Columns over two aligned series (or a series and a number)."""
    wide, pairs = _operands(a, b, idx, join, method, columns, list(by), default)
    return wide.select(*by, idx, *[kernel(x, y).alias(c) for c, (x, y) in pairs.items()])


def _many(kernel, default):
    def run(a, b=None, idx: str = "idx", join="inner", method=None, columns="inner", by=()) -> DataFrame:
        parts = [*(a if isinstance(a, list) else [a]), *([] if b is None else b if isinstance(b, list) else [b])]
        return reduce(lambda x, y: apply(kernel, x, y, idx, join, method, columns, by, default), parts)

    return run


def _divide(x: Column, y: Column) -> Column:
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


add = _many(lambda x, y: x + y, 0.0)
mul = _many(lambda x, y: x * y, 1.0)


def sub(a, b, **how) -> DataFrame:
    """a - b; lists are added up first."""
    return apply(lambda x, y: x - y, _folded(add, a, how), _folded(add, b, how), **how, default=0.0)


def div(a, b, **how) -> DataFrame:
    """a / b, null where b is 0; lists are multiplied first."""
    return apply(_divide, _folded(mul, a, how), _folded(mul, b, how), **how, default=1.0)


def _folded(op, x, how):
    return op(x, **how) if isinstance(x, list) else x


def power(a, b, **how) -> DataFrame:
    return apply(lambda x, y: F.pow(x.cast("double"), y.cast("double")), a, b, **how)


def _compare(test):
    def run(a, b, **how) -> DataFrame:
        """False wherever a side is missing."""
        return apply(lambda x, y: F.coalesce(test(x, y), F.lit(False)), a, b, **how)

    return run


gt, ge, lt, le = (_compare(t) for t in (lambda x, y: x > y, lambda x, y: x >= y, lambda x, y: x < y, lambda x, y: x <= y))


def _both(pick):
    return lambda x, y: F.when(x.isNotNull() & y.isNotNull(), pick(x, y))


#: Missing on either side is missing in the result.
minimum, maximum = _many(_both(F.least), None), _many(_both(F.greatest), None)


def absolute(df: DataFrame, idx: str = "idx", by=()) -> DataFrame:
    return df.select(*by, idx, *[F.abs(c).alias(c) for c in values_of(df, idx, by)])


# -- across series ----------------------------------------------------------------
def across(series: list[DataFrame], what: str | list[str], idx: str = "idx", join="outer", method=None, columns="outer", by=(), exclude: list | None = None) -> DataFrame:
    """Per index and column the count, sum, mean or std of the valid values of all series.

    ``exclude`` lists values that do not count, instead of NaN and infinities.  The
    standard deviation is the biased one and needs two values.  Several statistics
    come from one aggregation, as columns "<column>_<statistic>".
    """
    by = list(by)
    names = joint_columns([values_of(s, idx, by) for s in series], columns)
    if method is not None or join[0] != "o":
        index = joint_index(series, idx, join, by)
        series = [reindex(s, index, idx, by, method) for s in series]
    rows = reduce(DataFrame.unionByName, [recolumn(s, names, idx, by) for s in series])

    def value(c):
        if exclude is not None:
            return F.when(~F.coalesce(F.col(c).isin(*exclude), F.lit(False)), F.col(c))
        return F.when(~is_nan(F.col(c).cast("double")), F.col(c))

    make = {
        "count": lambda v: F.count(v),
        "sum": lambda v: F.sum(v),
        "mean": lambda v: F.avg(v),
        "std": lambda v: F.when(F.count(v) >= 2, F.stddev_pop(v)),
    }
    one = isinstance(what, str)
    out = [make[w](value(c)).alias(c if one else f"{c}_{w}") for c in names for w in ([what] if one else what)]
    return rows.groupBy(*by, idx).agg(*out)


def aggregate(df: DataFrame, function: Callable, idx: str = "idx", by=()) -> DataFrame:
    """An aggregate function over valid values of each column; null without any."""
    cols = values_of(df, idx, by)
    out = [F.when(F.count(valid(df, c)) > 0, function(valid(df, c))).alias(c) for c in cols]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


# -- any function ------------------------------------------------------------------
def _series_in(value, found: list) -> None:
    if isinstance(value, DataFrame):
        found.append(value)
    elif isinstance(value, dict):
        for v in value.values():
            _series_in(v, found)
    elif isinstance(value, list | tuple):
        for v in value:
            _series_in(v, found)


def _with_columns(value, pick, places):
    """The argument with each series replaced by one of its columns."""
    if isinstance(value, DataFrame):
        return pick(next(places), value)
    if isinstance(value, dict):
        return {k: _with_columns(v, pick, places) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return type(value)(_with_columns(v, pick, places) for v in value)
    return value


def aligned(function: Callable, idx: str = "idx", join="inner", method=None, columns: str | None = "inner", by=(), default=None) -> Callable:
    """A function of Columns as one of series: all series among its arguments, also in lists
    and dicts, are put on one index and one list of columns, and it runs column by column.

    A series of one column takes part in every result column; others lend the column of
    that name, or ``default``.  The result has the joint columns, or "value" if each
    series has one.  Keyword arguments ``join``, ``method`` and ``columns`` of the call
    override the policies.  All of it is one plan: joins on the index, then projections.
    """
    by = list(by)

    @functools.wraps(function)
    def run(*args, **kwargs) -> DataFrame:
        how = {k: kwargs.pop(k, v) for k, v in (("join", join), ("method", method), ("columns", columns))}
        found: list[DataFrame] = []
        _series_in([args, kwargs], found)
        if not found:
            return function(*args, **kwargs)
        index = joint_index(found, idx, how["join"], by)
        lists = [values_of(s, idx, by) for s in found]
        many = [x for x in lists if len(x) > 1]
        names = joint_columns(many, how["columns"]) if many else ["value"]
        keys, wide = [*by, idx], index
        for i, s in enumerate(found):
            at = reindex(s, index, idx, by, how["method"])
            wide = null_safe(wide, at.select(*keys, *[_nan_to_null(at, c).alias(f"_s{i}_{c}") for c in lists[i]]), keys, "left")

        def call(name: str) -> Column:
            def pick(i, _):
                own = lists[i][0] if len(lists[i]) == 1 else name
                return F.col(f"_s{i}_{own}") if own in lists[i] else F.lit(default).cast("double")

            places = iter(range(len(found)))
            a = _with_columns(list(args), pick, places)
            out = function(*a, **_with_columns(kwargs, pick, places))
            return out if isinstance(out, Column) else F.lit(out)

        return wide.select(*keys, *[call(n).alias(n) for n in names])

    return run


def as_series(df: DataFrame, name: str, idx: str = "idx", by=(), column: str | None = None) -> DataFrame:
    """A frame with one value column, or the named one of several, under a name."""
    own = values_of(df, idx, by)
    if column is None and len(own) != 1:
        raise ValueError(f"one value column is asked for, not {own}")
    return df.select(*by, idx, F.col(column or own[0]).alias(name))


__all__ = ["aligned", "as_series", "joint_columns", "joint_index", "recolumn", "reindex", "recent", "sync", "hconcat", "vconcat", "apply", "add", "mul", "sub", "div", "power", "gt", "ge", "lt", "le", "minimum", "maximum", "absolute", "across", "aggregate", "nona"]
