"""Table algebra: DataFrame to DataFrame, each a small declarative plan.

Rows have no order of their own here.  Operators whose result depends on an order
take it as an argument (``order``).  Null is a value of its own in keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.missing import is_float, is_nan, missing, spare
from ..plans.derive import derive, expression, parameters

__all__ = ["derive", "inc", "exc", "one_or_none", "find", "keep", "minus", "matching", "get", "relabel", "do", "if_else", "if_none", "sort_by", "concat", "listby", "groupby", "ungroup", "unlist", "pivot", "unpivot", "paste", "take", "invert", "unique_value", "shape", "to_text", "without", "either", "loop"]


# -- columns --------------------------------------------------------------------
def keep(df: DataFrame, names) -> DataFrame:
    """The columns that ``names`` (or another frame) has too, in the frame's order."""
    names = names.columns if isinstance(names, DataFrame) else [names] if isinstance(names, str) else list(names)
    return df.select(*[c for c in df.columns if c in names])


def minus(df: DataFrame, *names) -> DataFrame:
    """Without the named columns; a tuple is a path into a struct."""
    for n in names:
        if isinstance(n, tuple):
            df = df.withColumn(n[0], F.col(n[0]).dropFields(".".join(n[1:])))
        else:
            df = df.drop(*([n] if isinstance(n, str) else n))
    return df


def matching(df: DataFrame, text: str) -> DataFrame:
    """The columns whose names contain a text."""
    return df.select(*[c for c in df.columns if text in c])


def without(df: DataFrame, test) -> DataFrame:
    """Without the columns of a Spark type (or several), or those whose field passes a predicate."""
    gone = test if callable(test) and not isinstance(test, type) else lambda f: isinstance(f.dataType, test)
    return df.select(*[f.name for f in df.schema if not gone(f)])


def either(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Columns of both by keys; where both have a column the right one's value wins unless it is null."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    theirs = {c: f"_r{i}" for i, c in enumerate(right.columns) if c not in keys}
    both = left.join(right.withColumnsRenamed(theirs), keys, "left")
    shared = [c for c in left.columns if c in theirs]
    return both.select(*[F.coalesce(F.col(theirs[c]), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns], *[F.col(v).alias(c) for c, v in theirs.items() if c not in shared])


def get(df: DataFrame, name: str, default=None) -> Column:
    """A column, or a constant where the frame lacks it."""
    return F.col(name) if name in df.columns else F.lit(default)


def new_names(names: list[str], *how, **renames) -> dict[str, str]:
    """Old to new names: "x_" prefixes, "_x" suffixes, a list is by place, then dicts and functions."""
    out = dict(renames)
    for h in how:
        if isinstance(h, dict):
            out |= h
        elif callable(h):
            out |= {n: h(n) for n in names}
        elif isinstance(h, str):
            out |= {n: h + n if h.endswith("_") else n + h for n in names}
        else:
            h = list(h)
            if len(h) != len(names):
                raise ValueError(f"{len(h)} names for {len(names)} columns")
            out |= dict(zip(names, h, strict=True))
    return {k: v for k, v in out.items() if k in names}


def relabel(df: DataFrame, *how, **renames) -> DataFrame:
    """Rename columns; see new_names."""
    return df.withColumnsRenamed(new_names(df.columns, *how, **renames))


def header(name: str) -> str:
    """A clean column name: stripped, blanks to "_", no quotes or commas, lower case."""
    return re.sub(r"[\"',]", "", name.strip()).replace(" ", "_").lower()


def do(df: DataFrame, functions, *names: str) -> DataFrame:
    """Apply functions, one after the other, to each named column (all if none).

    A function's first parameter is the column itself, others name columns.
    """
    functions = [functions] if callable(functions) else list(functions)
    for name in names or tuple(df.columns):
        c = F.col(name)
        for f in functions:
            try:
                first, *others = parameters(f)
                more = {p: F.col(p) for p in others if p in df.columns}
            except (ValueError, TypeError):
                more = {}
            c = f(c, **more)
        df = df.withColumn(name, c)
    return df


def loop(df: DataFrame, function: Callable, *others, columns=None, axis: int = 0, name: str = "value") -> DataFrame:
    """A function of each column (axis 0), or of all columns of a row at once (axis 1).

    Other arguments go along: a dict lends its member of the column's name, a list or
    tuple the one at the column's place, anything else is the same for all.  On axis 1
    the function gets the list of Columns and makes the column ``name``.
    """
    columns = list(columns or df.columns)
    if axis == 1:
        return df.withColumn(name, function([F.col(c) for c in columns], *others))

    def of(other, i: int, c: str):
        if isinstance(other, dict):
            return other[c]
        if isinstance(other, list | tuple):
            if len(other) != len(columns):
                raise ValueError(f"{len(other)} values for {len(columns)} columns")
            return other[i]
        return other

    return df.withColumns({c: function(F.col(c), *[of(o, i, c) for o in others]) for i, c in enumerate(columns)})


def if_else(df: DataFrame, condition, if_true, if_false) -> Column:
    """A conditional; each part is a column's name, a function of columns, or a Column."""

    def part(v):
        return F.col(v) if isinstance(v, str) and v in df.columns else expression(v, df.columns)

    return F.when(F.coalesce(part(condition).cast("boolean"), F.lit(False)), part(if_true)).otherwise(part(if_false))


def if_none(df: DataFrame, none=None, **fills) -> DataFrame:
    """Fill missing cells with a constant or a function of columns; new columns are made.

    ``none``: null by default; NaN for missing floats; a list of values; or a
    predicate of the column.
    """
    out = {}
    for name, value in fills.items():
        if name not in df.columns:
            out[name] = expression(value, df.columns)
            continue
        c = F.col(name)
        if callable(none):
            gone = none(c)
        elif isinstance(none, float) and none != none:
            gone = missing(df, name)
        elif isinstance(none, list | tuple):
            gone = c.isNull() | c.isin(*[v for v in none if v is not None])
        else:
            gone = c.isNull()
        fill = expression(value, df.columns, key=F.lit(name)) if callable(value) and not isinstance(value, Column) else expression(value, df.columns)
        out[name] = F.when(F.coalesce(gone, F.lit(False)), fill).otherwise(c)
    return df.withColumns(out)


# -- rows -----------------------------------------------------------------------
def matches(df: DataFrame, name: str, value) -> Column:
    """Never null: None is null, NaN any non-number, a pattern searches, a list is membership."""
    c = F.col(name)
    if value is None:
        return c.isNull()
    if isinstance(value, float) and value != value:
        return is_nan(c) if is_float(df.schema[name].dataType) else F.lit(False)
    if isinstance(value, re.Pattern):
        return F.coalesce(c.rlike(value.pattern), F.lit(False))
    if isinstance(value, list | tuple | set | range):
        parts = [matches(df, name, v) for v in value if v is None or (isinstance(v, float) and v != v)]
        plain = [v for v in value if v is not None and v == v]
        if plain:
            parts.append(F.coalesce(c.isin(*plain), F.lit(False)))
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    return F.coalesce(c == value, F.lit(False))


def _all(df: DataFrame, filters: dict) -> Column:
    return reduce(lambda a, b: a & b, [matches(df, k, v) for k, v in filters.items()], F.lit(True))


def _true(df: DataFrame, condition) -> Column:
    return F.coalesce(expression(condition, df.columns).cast("boolean"), F.lit(False))


def inc(df: DataFrame, *conditions, **filters) -> DataFrame:
    """Rows that pass every condition and every filter."""
    for c in conditions:
        df = df.where(_true(df, c))
    return df.where(_all(df, filters)) if filters else df


def exc(df: DataFrame, *conditions, **filters) -> DataFrame:
    """Without the rows that pass any condition, and without those that pass all filters."""
    for c in conditions:
        df = df.where(~_true(df, c))
    return df.where(~_all(df, filters)) if filters else df


def one_or_none(df: DataFrame, *conditions, exclude: dict | None = None, column: str | None = None, **filters):
    """The only row (or its value in a column), None without one; several raise ValueError."""
    rows = exc(inc(df, *conditions, **filters), **(exclude or {})).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return None if not rows else rows[0][column] if column else rows[0]


def find(df: DataFrame, name: str, *conditions, **filters):
    """The single distinct value of a column; none or several raise ValueError."""
    rows = inc(df, *conditions, **filters).select(name).distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} value of {name}")
    return rows[0][0]


def take(df: DataFrame, order, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows by place in an order: a global sort with limit and offset; with a stop, a top-k plan."""
    order = [order] if isinstance(order, str | Column) else list(order)
    if start == 0 and stop is not None:
        return df.orderBy(*order).limit(stop)
    if stop is not None:
        return df.orderBy(*order).limit(stop).offset(start)
    return df.orderBy(*order).offset(start)


def sort_by(df: DataFrame, *by, **orders) -> DataFrame:
    """Ascending by columns or functions, null first; or by a stated order of values.

    ``orders``: column=[values]; other values come last.
    """
    keys = []
    for b in by:
        for x in b if isinstance(b, list | tuple) else [b]:
            keys.append(F.col(x).asc() if isinstance(x, str) else expression(x, df.columns).asc())
    for name, values in orders.items():
        rank = F.lit(len(values))
        for i, v in reversed(list(enumerate(values))):
            rank = F.when(F.col(name).eqNullSafe(F.lit(v)), i).otherwise(rank)
        keys.append(rank)
    return df.orderBy(*keys) if keys else df


def concat(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name, missing ones null; None is skipped."""
    frames = [f for f in frames if f is not None and not isinstance(f, int)]
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def paste(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Columns side by side, row by row in the stated orders; right wins on equal names.

    Places are numbered over the whole of each side, which a single task does for
    the order's keys; use a keyed join wherever there is a key.
    """
    rest = [c for c in left.columns if c not in right.columns]
    place = spare(right, spare(left, "_place"))
    a = left.select(*rest, F.row_number().over(Window.orderBy(*_list(left_order))).alias(place))
    b = right.withColumn(place, F.row_number().over(Window.orderBy(*_list(right_order))))
    return a.join(b, place, "full").drop(place)


def _list(x):
    return [x] if isinstance(x, str | Column) else list(x)


# -- groups ---------------------------------------------------------------------
def _rows(df: DataFrame, rest: list[str], order) -> Column:
    """The group's rows as an array of structs in order; null members stay."""
    order = _list(order) if order is not None else []
    packed = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    return F.transform(F.array_sort(F.collect_list(packed)), lambda s: F.struct(*[s[c].alias(c) for c in rest]))


def listby(df: DataFrame, *by: str, order=None) -> DataFrame:
    """One row per key, other columns as arrays; without keys the distinct rows."""
    if not by:
        return df.distinct()
    rest = [c for c in df.columns if c not in by]
    if not rest:
        return df.distinct()
    packed = spare(df, "_rows")
    g = df.groupBy(*by).agg(_rows(df, rest, order).alias(packed))
    return g.select(*by, *[F.col(packed).getField(c).alias(c) for c in rest])


def groupby(df: DataFrame, *by: str, grp: str = "grp", order=None) -> DataFrame:
    """One row per key with the other columns as a nested table in ``grp``."""
    rest = [c for c in df.columns if c not in by]
    if not by or not rest:
        raise ValueError("some but not all columns must be keys")
    return df.groupBy(*by).agg(_rows(df, rest, order).alias(grp))


def ungroup(df: DataFrame, grp: str = "grp") -> DataFrame:
    """The rows of a nested table, each with its key."""
    return df.select(*[c for c in df.columns if c != grp], F.inline(grp))


def unlist(df: DataFrame, *names: str) -> DataFrame:
    """Explode arrays in step, other columns repeated; unequal lengths raise."""
    arrays = list(names) or [f.name for f in df.schema if f.dataType.typeName() == "array"]
    if not arrays:
        return df
    size = F.size(arrays[0])
    equal = reduce(lambda a, b: a & b, [F.size(c) == size for c in arrays], F.lit(True))
    zipped = F.when(F.assert_true(equal, F.lit("arrays of unequal lengths")).isNull(), F.arrays_zip(*arrays))
    name = spare(df, "_zip")
    out = df.withColumn(name, F.explode(zipped))
    return out.select(*[F.col(f"{name}.{c}").alias(c) if c in arrays else F.col(c) for c in df.columns])


#: Columns that a pivot makes at most from values that were not stated.
HEADERS = 1_000


def pivot(df: DataFrame, x, y: str, z, agg: Callable | None = None, values: list | None = None) -> DataFrame:
    """Rows by ``x``, columns by the values of ``y``, cells of ``z``.

    Without ``agg`` a cell is the array of its values, null if there is none.  Give
    ``values`` wherever they are known: it saves a job and fixes the schema.  Without
    them at most HEADERS values are read; more raise.
    """
    x = [x] if isinstance(x, str) else list(x)
    cell = expression(z, df.columns) if not isinstance(z, str) else F.col(z)
    if values is None:
        values = [r[0] for r in df.select(y).distinct().orderBy(y).limit(HEADERS + 1).collect()]
        if len(values) > HEADERS:
            raise ValueError(f"more than {HEADERS} values of {y}")
    name = spare(df, "_z")
    g = df.withColumn(name, cell).groupBy(*x).pivot(y, values)
    if agg is not None:
        return g.agg(agg(F.col(name)))
    out = g.agg(F.collect_list(name))
    return out.select(*x, *[F.when(F.size(f"`{c}`") > 0, F.col(f"`{c}`")).alias(c) for c in out.columns[len(x) :]])


def unpivot(df: DataFrame, x, y, z: str) -> DataFrame:
    """Wide to long; ``y`` is a name, or {name: columns} for some of the columns."""
    x = [x] if isinstance(x, str) else list(x)
    name, columns = next(iter(y.items())) if isinstance(y, dict) else (y, [c for c in df.columns if c not in x])
    return df.unpivot(x, columns, name, z)


def first(c, order) -> Column:
    """Aggregate: the value at the least order."""
    return F.min_by(c, order)


def last(c, order) -> Column:
    return F.max_by(c, order)


def unique_value(c: str) -> Column:
    """Aggregate: the single distinct value; several raise."""
    same = F.min(c).eqNullSafe(F.max(c))
    return F.when(F.assert_true(same, F.lit(f"{c} is not unique")).isNull(), F.max(c))


def invert(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per value with the sorted array of its keys."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(key))


# -- views ----------------------------------------------------------------------
def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def records(df: DataFrame):
    """Rows as dicts, partition by partition."""
    return (r.asDict() for r in df.toLocalIterator())


def to_text(df: DataFrame, rows: int = 6, width: int = 50, colsep: str = "|") -> str:
    """A table of the first rows as text; values cut at ``width`` characters."""
    got: list[Row] = df.limit(rows + 1).collect()
    cells = [df.columns, *[["" if v is None else str(v).replace("\n", " ")[:width] for v in r] for r in got[:rows]]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = [colsep.join(v.ljust(w) for v, w in zip(r, wide, strict=True)) for r in cells]
    return "\n".join([*lines, *["..."] * (len(got) > rows)])
