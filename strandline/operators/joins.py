"""Joins on keys where null matches null, with rules for columns that both sides have."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.derive import expression

#: Names of the rules.
LEFT, RIGHT, LEFT_FIRST, RIGHT_FIRST, BOTH = "l", "r", "l|r", "r|l", None
_ALIASES = {0: "l", "lhs": "l", "left": "l", 1: "r", "rhs": "r", "right": "r"}


def _keys(left: DataFrame, right: DataFrame, lcols, rcols):
    """Pairs (left column or formula, right column or formula, name of the result)."""
    if lcols is None and rcols is None:
        lcols = [c for c in left.columns if c in right.columns]
    lcols = lcols if lcols is not None else rcols
    rcols = rcols if rcols is not None else lcols
    lcols, rcols = ([c] if isinstance(c, str) or callable(c) or isinstance(c, Column) else list(c) for c in (lcols, rcols))
    if len(lcols) != len(rcols):
        raise ValueError("unequal numbers of keys")
    out = []
    for a, b in zip(lcols, rcols, strict=True):
        if not isinstance(a, str) and not isinstance(b, str):
            raise ValueError("a formula may stand on one side only")
        out.append((a, b, a if isinstance(a, str) else b))
    return out


def _side(df: DataFrame, keys: list, tag: str) -> DataFrame:
    """The frame with its columns as tag0, tag1, ... and its keys as tagk0, ..."""
    made = [(F.col(k) if isinstance(k, str) else expression(k, df.columns)).alias(f"{tag}k{i}") for i, k in enumerate(keys)]
    return df.select(*made, *[F.col(c).alias(f"{tag}{i}") for i, c in enumerate(df.columns)])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on equal names in which null meets null; keys come once, from the left side."""
    theirs = {c: f"_n{i}" for i, c in enumerate(keys)}
    on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(n)) for c, n in theirs.items()])
    out = left.join(right.withColumnsRenamed(theirs), on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*theirs.values())


def _both(left: DataFrame, right: DataFrame, lcols, rcols, mode, how: str, defaults: dict | None = None) -> DataFrame:
    keys = _keys(left, right, lcols, rcols)
    if not keys:
        a, b = _side(left, [], "l"), _side(right, [], "r")
        joined = a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
    else:
        a, b = _side(left, [k[0] for k in keys], "l"), _side(right, [k[1] for k in keys], "r")
        on = reduce(lambda p, q: p & q, [F.col(f"lk{i}").eqNullSafe(F.col(f"rk{i}")) for i in range(len(keys))])
        joined = a.join(b, on, how)
    names = [k[2] for k in keys]
    pick = {}
    for i, name in enumerate(names):
        of_right = how == "right"
        pick[name] = F.col(f"rk{i}" if of_right and keys[i][0] == keys[i][1] else f"lk{i}")
        if how == "full":
            pick[name] = F.coalesce(F.col(f"lk{i}"), F.col(f"rk{i}"))
    at_left, at_right = ({c: F.col(f"{t}{i}") for i, c in enumerate(df.columns)} for t, df in (("l", left), ("r", right)))
    rule = _ALIASES.get(mode, mode) if not callable(mode) else mode
    for c in [*left.columns, *[c for c in right.columns if c not in left.columns]]:
        if c in names:
            continue
        x, y = at_left.get(c), at_right.get(c)
        pick[c] = x if y is None else y if x is None else _rule(rule, x, y)
    out = joined.select(*[v.alias(k) for k, v in pick.items()])
    if defaults:
        out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items() if k in out.columns})
    return out


def _rule(rule, x: Column, y: Column) -> Column:
    if callable(rule):
        return rule(x, y)
    if rule == LEFT:
        return x
    if rule == RIGHT:
        return y
    if rule == LEFT_FIRST:
        return F.coalesce(x, y)
    if rule == RIGHT_FIRST:
        return F.coalesce(y, x)
    if rule is None:
        return F.struct(x.alias("l"), y.alias("r"))
    raise ValueError(f"no such rule: {rule}")


def join(left: DataFrame, right: DataFrame, lcols=None, rcols=None, mode: str | Callable | None = None) -> DataFrame:
    """Inner join; keys are names, or a formula on one side; no shared column gives the product.

    Keys keep the left name (the right one if the left is a formula).  ``mode`` says
    what becomes of other columns that both have: a struct (l, r), l, r, "l|r", "r|l"
    or a function of both.
    """
    return _both(left, right, lcols, rcols, mode, "inner")


def xor(left: DataFrame, right: DataFrame, lcols=None, rcols=None, mode: str = "l") -> DataFrame:
    """Rows of the left side without a partner ("l"), or of the right ("r")."""
    keys = _keys(left, right, lcols, rcols)
    if not keys:
        return left
    if _ALIASES.get(mode, mode) == RIGHT:
        left, right, keys = right, left, [(b, a, n) for a, b, n in keys]
    other = right.select(*[(F.col(b) if isinstance(b, str) else expression(b, right.columns)).alias(f"_k{i}") for i, (_, b, _) in enumerate(keys)])
    on = reduce(lambda p, q: p & q, [(F.col(a) if isinstance(a, str) else expression(a, left.columns)).eqNullSafe(F.col(f"_k{i}")) for i, (a, _, _) in enumerate(keys)])
    return left.join(other, on, "left_anti")


def left_join(left: DataFrame, right: DataFrame, lcols=None, rcols=None, mode=None, **defaults) -> DataFrame:
    """Every left row; ``defaults`` fill null in the named columns, also genuine ones."""
    return _both(left, right, lcols, rcols, mode, "left", defaults)


def right_join(left: DataFrame, right: DataFrame, lcols=None, rcols=None, mode=None, **defaults) -> DataFrame:
    return _both(left, right, lcols, rcols, mode, "right", defaults)


def _value(name: str, df: DataFrame, on: list[str], rename: str | None) -> DataFrame:
    """The input's keys and its value column, named after the input."""
    rest = [c for c in df.columns if c not in on]
    column = rename or (name if name in rest else "data" if "data" in rest else rest[0] if len(rest) == 1 else None)
    if column not in df.columns:
        raise KeyError(f"no value column for {name}")
    return df.select(*[c for c in on if c in df.columns], F.col(column).alias(name))


def join_all(inputs: dict, on, renames: dict[str, str] | None = None, defaults: dict | None = None) -> DataFrame:
    """Many named inputs (frames or constants) joined on those of ``on`` that each has.

    An input with a default keeps rows that it lacks: both sides with one make a full join.
    """
    on = [on] if isinstance(on, str) else list(on)
    renames, defaults = renames or {}, defaults or {}
    frames = {k: _value(k, v, on, renames.get(k)) for k, v in inputs.items() if isinstance(v, DataFrame)}
    order = sorted(frames, key=lambda k: k in defaults)  # those without defaults first
    out, open_ = None, False
    for k in order:
        if out is None:
            out, open_ = frames[k], k in defaults
            continue
        shared = [c for c in on if c in out.columns and c in frames[k].columns]
        how = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full"}[open_, k in defaults]
        lcols = rcols = shared
        out = _both(out, frames[k], lcols, rcols, None, how)
        open_ = open_ and k in defaults
    if out is None:
        raise ValueError("no table among the inputs")
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items() if k in frames and v is not None})
    constants = {k: F.lit(v) for k, v in inputs.items() if not isinstance(v, DataFrame)}
    out = out.withColumns(constants) if constants else out
    keys = [c for c in on if c in out.columns]
    return out.select(*keys, *inputs)
