"""Functions of named columns: bound by parameter name, ordered by dependency."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(function: Callable) -> list[str]:
    """Names of a function's positional and keyword parameters."""
    kinds = (inspect.Parameter.POSITIONAL_OR_KEYWORD, inspect.Parameter.KEYWORD_ONLY)
    return [p.name for p in inspect.signature(function).parameters.values() if p.kind in kinds]


def required(function: Callable) -> list[str]:
    """Parameters without a default."""
    return [p.name for p in inspect.signature(function).parameters.values() if p.default is p.empty and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]


def bind(function: Callable, columns, **extra) -> Column:
    """Call a function with the columns that its parameters name."""
    given = dict(extra)
    for name in parameters(function):
        if name not in given and name in columns:
            given[name] = F.col(name)
    lacking = [n for n in required(function) if n not in given]
    if lacking:
        raise KeyError(f"no column for {lacking}")
    out = function(**{k: v for k, v in given.items() if k in parameters(function)})
    return out if isinstance(out, Column) else F.lit(out)


def expression(value, columns, **extra) -> Column:
    """A Column from a Column, a function of columns, or a constant."""
    if isinstance(value, Column):
        return value
    return bind(value, columns, **extra) if callable(value) else F.lit(value)


def levels(columns, functions: dict[str, Callable]) -> list[list[str]]:
    """Names in an order that computes inputs before outputs, as independent groups.

    A function that takes its own name reads the old column.  Cycles raise ValueError.
    """
    left = dict(functions)
    out = []
    while left:
        ready = [k for k, f in left.items() if not any(p in left and p != k for p in parameters(f))]
        if not ready:
            raise ValueError(f"these depend on each other: {sorted(left)}")
        out.append(ready)
        for k in ready:
            left.pop(k)
    return out


def derive(df: DataFrame, **values) -> DataFrame:
    """New columns: constants and Columns first, then functions level by level."""
    plain = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items() if isinstance(v, Column) or not callable(v)}
    if plain:
        df = df.withColumns(plain)
    functions = {k: v for k, v in values.items() if callable(v) and not isinstance(v, Column)}
    for group in levels(df.columns, functions):
        df = df.withColumns({k: bind(functions[k], df.columns) for k in group})
    return df


def row_function(function: Callable, kind: str) -> Callable:
    """A Python function on batches of column values (pandas Series), as a Column function.

    For logic that has no Column form.  Its parameters name the columns.
    """
    from pyspark.sql.functions import pandas_udf

    names = parameters(function)
    wrapped = pandas_udf(lambda *a: function(*a), kind)

    def column(**given):
        return wrapped(*[given.get(n, F.col(n)) for n in names])

    column.__signature__ = inspect.Signature([inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD, default=None) for n in names])
    return column


def fold(function: Callable, values, default=None):
    """Reduce without a forced start; ``default`` for no values."""
    values = list(values)
    return reduce(function, values) if values else default


def try_value(build: Callable[[], Column], otherwise) -> Column:
    """A Column, or a constant where building it fails (a missing column, a wrong type)."""
    try:
        return build()
    except Exception:
        return otherwise if isinstance(otherwise, Column) else F.lit(otherwise)


def tried(build: Callable[[], Column]) -> dict:
    """A column that may fail to build, with each of the usual stand-ins, by name."""
    stand_ins = {"nan": float("nan"), "zero": 0.0, "none": None, "true": True, "false": False, "list": F.array()}
    return {k: try_value(build, v) for k, v in stand_ins.items()}


def if_not_none(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Apply a Column function only where its argument is not null."""
    return lambda c: F.when(c.isNotNull(), function(c))
