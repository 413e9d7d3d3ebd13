"""Slices of series: ranges, times of day, stitching of contracts, gaps."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fill import frames, values_of


def bounds(c: Column, low=None, high=None, ends: str = "(]") -> Column:
    """Whether a value lies between two bounds; None is open.  ``ends`` like "[)"."""
    if len(ends) != 2 or ends[0] not in "([" or ends[1] not in ")]":
        raise ValueError(f"not a pair of brackets: {ends}")
    out = F.lit(True)
    if low is not None:
        low = low if isinstance(low, Column) else F.lit(low)
        out = out & (c >= low if ends[0] == "[" else c > low)
    if high is not None:
        high = high if isinstance(high, Column) else F.lit(high)
        out = out & (c <= high if ends[1] == "]" else c < high)
    return out


def between(df: DataFrame, idx: str, low=None, high=None, ends: str = "(]") -> DataFrame:
    """Rows of an index range; reaches the scan as a pushed filter."""
    return df.where(bounds(F.col(idx), low, high, ends))


def second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def time_in_day(c: Column) -> Column:
    """Seconds of the day with their fraction."""
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")


def time_of_day(df: DataFrame, idx: str, low: float, high: float, ends: str = "(]") -> DataFrame:
    """Rows between two seconds of the day, fractions included.

    Past midnight, if low is above high, both parts are "(]" whatever ``ends`` says.
    """
    s = time_in_day(F.col(idx))
    if low <= high:
        return df.where(bounds(s, low, high, ends))
    return df.where((s > low) | (s <= high))


def is_ascending(values: list) -> bool:
    """True for bounds that never fall, False for ones that never rise; others raise.  None may stand at the ends."""
    known = [v for v in values if v is not None]
    inner = values[next((i for i, v in enumerate(values) if v is not None), 0) : len(values) - next((i for i, v in enumerate(reversed(values)) if v is not None), 0)]
    if len(inner) != len(known):
        raise ValueError("a bound is missing between others")
    if all(a <= b for a, b in zip(known, known[1:], strict=False)):
        return True
    if all(a >= b for a, b in zip(known, known[1:], strict=False)):
        return False
    raise ValueError("bounds neither rise nor fall")


def cut(series, idx: str, low=None, high=None, ends: str = "(]", depth: int = 1, by=()) -> DataFrame:
    """One operator for all kinds of bounds.

    Scalars give a range and ``datetime.time`` bounds a time of day.  Lists, one bound
    for each of a list of series, stitch them: series k counts from the bound before it
    up to its own (upper bounds), or from its own up to the next one (lower bounds).
    Descending bounds stand for the reversed lists.  ``depth`` asks for the next series
    as columns "0", "1", ...
    """
    if isinstance(low, datetime.time) or isinstance(high, datetime.time):
        at = lambda t, otherwise: otherwise if t is None else t.hour * 3600 + t.minute * 60 + t.second + t.microsecond / 1e6
        return time_of_day(series, idx, at(low, -1.0), at(high, 86400.0), ends)
    if not isinstance(low, list) and not isinstance(high, list):
        return between(series, idx, low, high, ends)
    series, known = list(series), low if isinstance(low, list) else high
    if len(series) != len(known):
        raise ValueError("one bound for each series")
    if not is_ascending(known):
        series, known = series[::-1], known[::-1]
    spark = series[0].sparkSession
    if isinstance(low, list):  # series k ends where the next one begins
        until = [*known[1:], None]
        first = known[0]
    else:
        until, first = list(known), None
    # an end that is open lies after everything
    kind = series[0].schema[idx].dataType
    chain = spark.createDataFrame([(k, u) for k, u in enumerate(until)], T.StructType([T.StructField("_series", T.IntegerType()), T.StructField("_until", kind)]))
    value = values_of(series[0], idx, by)[0]
    rows = reduce(DataFrame.unionByName, [s.select(*by, idx, F.lit(k).alias("_series"), F.col(value).alias("_value")) for k, s in enumerate(series)])
    w = Window.orderBy("_series")  # the chain alone: a row for each series
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.lag("_until", k + 1).over(w).alias("low"), F.lag("_until", k).over(w).alias("high"), (F.row_number().over(w) > k).alias("there")) for k in range(depth)])
    spans = chain.select("_series", slots.alias("_s")).select("_series", F.inline("_s")).where("there")
    joined = rows.join(spans, "_series")
    inside = (F.col("low").isNull() | bounds(F.col(idx), F.col("low"), None, ends)) & (F.col("high").isNull() | bounds(F.col(idx), None, F.col("high"), ends))
    if first is not None:
        inside = inside & bounds(F.col(idx), first, None, ends)
    return joined.where(inside).groupBy(*by, idx).pivot("slot", list(range(depth))).agg(F.first("_value"))


def stitch(series: DataFrame, chain: DataFrame, idx: str, contract: str, until: str, depth: int = 1, ends: str = "(]", by=()) -> DataFrame:
    """A curve of the next ``depth`` contracts from a chain of expiring ones.

    ``chain`` has a row for each contract with the last stamp (``until``) at which it
    is the front one.  Column "0" of the result is the front contract's value, "1" the
    next one's, and so on.  The chain, one row per contract, is small beside the series:
    each series row meets only its contract's own bounds, by an equi-join.
    """
    value = next(c for c in series.columns if c not in (idx, contract, *by))
    w = Window.partitionBy(*by).orderBy(until)
    slots = []
    for k in range(depth):
        # contract c is number k while contract c - k is the front one
        slots.append(F.struct(F.lit(k).alias("slot"), F.lag(until, k + 1).over(w).alias("low"), F.lag(until, k).over(w).alias("high"), (F.row_number().over(w) > k).alias("there")))
    spans = chain.select(*by, contract, F.array(*slots).alias("_s")).select(*by, contract, F.inline("_s")).where("there")
    joined = series.join(spans, [*by, contract])
    inside = F.col("low").isNull() | bounds(F.col(idx), F.col("low"), None, ends)
    inside = inside & bounds(F.col(idx), None, F.col("high"), ends)
    return joined.where(inside).groupBy(*by, idx).pivot("slot", list(range(depth))).agg(F.first(value))


def unstitch(curve: DataFrame, chain: DataFrame, idx: str, contract: str, until: str, depth: int = 1, ends: str = "(]", value: str = "value") -> DataFrame:
    """The contracts' own values, back from a curve made by stitch.

    The spans of the front contracts become days, so that the curve joins by equal
    days; what lies before the first end meets the first contract.
    """
    long = curve.unpivot([idx], [str(k) for k in range(depth)], "_slot", value).where(F.col(value).isNotNull())
    w = Window.orderBy(until)  # the chain alone: a row for each contract
    numbered = chain.select(contract, until, F.row_number().over(w).alias("_n"), F.lag(until).over(w).alias("_low"))
    begin = chain.agg(F.min(until)).first()[0]
    day = F.col(idx).cast("date") if begin is None else F.greatest(F.col(idx).cast("date"), F.lit(begin).cast("date"))
    days = F.sequence(F.coalesce(F.col("_low"), F.col(until)).cast("date"), F.col(until).cast("date"))
    front = numbered.select(F.col("_n").alias("_front"), "_low", F.col(until).alias("_high"), F.explode(days).alias("_day"))
    inside = (F.col("_low").isNull() | bounds(F.col(idx), F.col("_low"), None, ends)) & bounds(F.col(idx), None, F.col("_high"), ends)
    at = long.withColumn("_day", day).join(front, "_day").where(inside)
    return at.join(numbered.select(contract, "_n"), F.col("_n") == F.col("_front") + F.col("_slot").cast("int")).select(contract, idx, value)


def roll(chain: DataFrame, series: DataFrame, idx: str, contract: str, until: str, depth: int = 1, history: DataFrame | None = None, cutoff=None) -> DataFrame:
    """A continuous curve: stitched rows after the cutoff below a previous result up to it.

    Without a cutoff the previous result's last stamp is it.  Only contracts that are
    still live after it are read.
    """
    if history is None:
        return stitch(series, chain, idx, contract, until, depth)
    if cutoff is None:
        cutoff = history.agg(F.max(idx)).first()[0]
    live = chain if cutoff is None else chain.where(F.col(until) > F.lit(cutoff))
    # the first live contract begins where its predecessor ended: keep that bound
    past = chain.where(F.col(until) <= F.lit(cutoff)).orderBy(F.desc(until)).limit(1) if cutoff is not None else None
    fresh = stitch(series, live if past is None else past.unionByName(live), idx, contract, until, depth)
    if cutoff is None:
        return fresh
    return history.where(F.col(idx) <= F.lit(cutoff)).unionByName(fresh.where(F.col(idx) > F.lit(cutoff)), allowMissingColumns=True)


def infer_until(chain: DataFrame, last_seen: DataFrame, contract: str, until: str, order: str) -> DataFrame:
    """Fill missing ends of contracts by their last stamp, never after the next contract's end."""
    seen = chain.join(last_seen.withColumnRenamed(until, "_seen"), contract, "left")
    later = F.min(F.coalesce(until, "_seen")).over(Window.orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    return seen.withColumn(until, F.coalesce(F.col(until), F.least("_seen", later))).drop("_seen")


def gap_days(df: DataFrame, idx: str, by=(), now=None, name: str = "gap") -> DataFrame:
    """Whole days to the next stamp (elapsed time, rounded down); to ``now`` at the end."""
    w = frames(idx, by)[3]
    nxt = F.lead(idx).over(w)
    if now is not None:
        nxt = F.coalesce(nxt, F.lit(now).cast("timestamp_ntz"))
    seconds = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(idx).cast("timestamp"))
    return df.withColumn(name, F.floor(seconds / F.lit(86_400_000_000)))


def after_issue(df: DataFrame, flag: Column, idx: str, by=(), deal: str | int = "last") -> DataFrame:
    """What follows the last (first, k-th) flagged stamp; all of it without one; "raise" raises."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    if deal == "raise":
        return marked.where(F.assert_true(~F.col("_flag"), F.lit("the series has an issue")).isNull()).drop("_flag")
    z = frames(idx, by)[2]
    if isinstance(deal, int):
        w = Window.partitionBy(*by, "_flag").orderBy(F.col(idx) if deal >= 0 else F.col(idx).desc())
        marked = marked.withColumn("_k", F.row_number().over(w))
        k = deal + 1 if deal >= 0 else -deal
        cut = F.max(F.when(F.col("_flag") & (F.col("_k") == k), F.col(idx))).over(z)
    else:
        cut = {"last": F.max, "first": F.min}[deal](F.when(F.col("_flag"), F.col(idx))).over(z)
    out = marked.withColumn("_cut", cut)
    return out.where(F.col("_cut").isNull() | (F.col(idx) > F.col("_cut"))).drop("_flag", "_k", "_cut")


def degap(df: DataFrame, idx: str, by=(), max_gap: int = 0, deal: str | int = "last") -> DataFrame:
    """The part of a series after a gap of at least ``max_gap`` days."""
    if not max_gap:
        return df
    with_gap = gap_days(df, idx, by, name="_gap")
    return after_issue(with_gap, F.col("_gap") >= max_gap, idx, by, deal).drop("_gap")


def one_per_index(df: DataFrame, idx: str, order, by=(), keep: str = "last") -> DataFrame:
    """One row per index: the last or first by an order; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in (idx, *by)]
    pick = F.max_by if keep == "last" else F.min_by
    g = df.groupBy(*by, idx).agg(pick(F.struct(*rest), order).alias("_r"))
    return g.select(*by, idx, "_r.*").select(*df.columns)


__all__ = ["bounds", "between", "cut", "is_ascending", "second_of_day", "time_in_day", "time_of_day", "stitch", "unstitch", "roll", "infer_until", "gap_days", "after_issue", "degap", "one_per_index", "values_of"]
