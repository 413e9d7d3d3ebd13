"""Holiday calendars as a dimension table.

A calendar has one row per day with its flags, its business-day number and its
neighbours; arithmetic is a join on it.  It holds at most four centuries of days
(about 146,000 rows), so it may be broadcast: its size is fixed, not the data's.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dates import NTZ, parse_bump, parse_steps, plus_days

FIRST, LAST = "1900-01-01", "2300-01-01"


class Calendar:
    """Business days from holidays and weekend days (0 is Monday)."""

    def __init__(self, spark: SparkSession, key: str = "calendar", holidays=(), weekend=(5, 6), first: str = FIRST, last: str = LAST, adjust: str = "m", day_start: int = 0, day_end: int = 86399):
        self.spark, self.key, self.rule = spark, key, adjust
        self.day_start, self.day_end = day_start, day_end
        self.holidays = sorted({str(h)[:10] if isinstance(h, date) else str(h) for h in holidays})
        self.weekend = tuple(weekend)
        self.first, self.last = first, last
        self._table: DataFrame | None = None

    @property
    def table(self) -> DataFrame:
        """day, is_bday, clock (business days before it), the business days at or after and
        at or before it (next, prev), and those strictly after and before it."""
        if self._table is None:
            days = self.spark.sql(f"select explode(sequence(date'{self.first}', date'{self.last}')) as day")
            off = F.weekday("day").isin(*self.weekend) if self.weekend else F.lit(False)
            if self.holidays:
                off = off | F.col("day").isin(*[F.lit(h).cast("date") for h in self.holidays])
            w = Window.orderBy("day")  # a table of fixed size
            flagged = days.withColumn("is_bday", ~off)
            on = F.when(F.col("is_bday"), F.col("day"))
            self._table = flagged.select(
                "day",
                "is_bday",
                (F.count(on).over(w) - F.col("is_bday").cast("int")).alias("clock"),
                F.first(on, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
                F.last(on, ignorenulls=True).over(w).alias("prev"),
                F.first(on, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
                F.last(on, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            ).cache()
        return self._table

    def _at(self, df: DataFrame, t: str) -> DataFrame:
        """The rows with the calendar's columns of their day, prefixed by "_c_"."""
        c = self.table.select(*[F.col(x).alias(f"_c_{x}") for x in self.table.columns])
        return df.join(F.broadcast(c), F.col(t).cast("date") == F.col("_c_day"), "left")

    def _out(self, df: DataFrame, made: dict[str, Column]) -> DataFrame:
        return df.withColumns(made).drop(*[c for c in df.columns if c.startswith(("_c_", "_d_"))])

    def flag(self, df: DataFrame, t: str, name: str = "is_bday") -> DataFrame:
        return self._out(at := self._at(df, t), {name: at["_c_is_bday"]})

    def _adjusted(self, rule: str) -> Column:
        nxt, prev, day = F.col("_c_next"), F.col("_c_prev"), F.col("_c_day")
        if rule == "f":
            return nxt
        if rule == "p":
            return prev
        if rule == "m":
            return F.when(F.month(nxt) == F.month(day), nxt).otherwise(prev)
        raise ValueError(f"no such rule: {rule}")

    def adjust(self, df: DataFrame, t: str, rule: str | None = None, name: str = "adjusted") -> DataFrame:
        """To a business day: f following, p preceding, m following but within the month."""
        return self._out(self._at(df, t), {name: self._adjusted(rule or self.rule).cast(NTZ)})

    def add(self, df: DataFrame, t: str, n: int | Column, rule: str | None = None, name: str = "added") -> DataFrame:
        """n business days after the day, which is adjusted first (by the calendar's rule)."""
        n = n if isinstance(n, Column) else F.lit(n)
        start = self._at(df, t).withColumn("_d_start", self._adjusted(rule or self.rule))
        days = self.table.where("is_bday").select(F.col("day").alias("_d_day"), F.col("clock").alias("_d_clock"))
        clocks = self.table.where("is_bday").select(F.col("day").alias("_d_from"), F.col("clock").alias("_d_at"))
        at = start.join(F.broadcast(clocks), F.col("_d_start") == F.col("_d_from"), "left")
        out = at.join(F.broadcast(days), F.col("_d_at") + n == F.col("_d_clock"), "left")
        return self._out(out, {name: F.col("_d_day").cast(NTZ)})

    def bump(self, df: DataFrame, t: str, text: str, rule: str | None = None, name: str = "bumped") -> DataFrame:
        """A bump whose "b" counts business days; "+0b" only rolls forward, "-0b" back."""
        from .dates import bump

        out = df.withColumn(name, F.col(t))
        for step in parse_steps(text):
            n, unit = parse_bump(step)[0]
            if unit != "b":
                out = out.withColumn(name, bump(F.col(name), step))
                continue
            if step in ("+0b", "-0b"):
                out = self.adjust(out, name, "f" if step[0] == "+" else "p", name)
            out = self.add(out, name, n, rule, name)
        return out

    def _clock(self, rule: str) -> Column:
        """The number of the adjusted day."""
        return F.when(self._adjusted(rule) < F.col("_c_day"), F.col("_c_clock") - 1).otherwise(F.col("_c_clock"))

    def clock(self, df: DataFrame, t: str, name: str = "clock", rule: str | None = None) -> DataFrame:
        """The number of the (adjusted) business day."""
        return self._out(self._at(df, t), {name: self._clock(rule or self.rule)})

    def bdays(self, df: DataFrame, t0: str, t1: str, name: str = "bdays", rule: str | None = None) -> DataFrame:
        """Business days from one stamp to another, both adjusted."""
        a = self.clock(df, t0, "_x0", rule)
        b = self.clock(a, t1, "_x1", rule)
        return b.withColumn(name, F.col("_x1") - F.col("_x0")).drop("_x0", "_x1")

    def days(self, t0: str, t1: str, step: int = 1, overshoot: bool = True) -> DataFrame:
        """Every ``step``-th business day from one (adjusted) day to another.

        The last one may lie beyond the end by less than a step, unless ``overshoot`` is False.
        """
        ends = self.spark.createDataFrame([(t0, t1)], "a string, b string").selectExpr("cast(a as date) a", "cast(b as date) b")
        i0, i1 = self.clock(self.clock(ends, "a", "i"), "b", "j").select("i", "j").first()
        top = i1 + step - 1 if overshoot else i1
        inside = F.col("is_bday") & F.col("clock").between(i0, top) & ((F.col("clock") - i0) % step == 0)
        return self.table.where(inside).select(F.col("day").cast(NTZ).alias("day"))

    def trading(self, df: DataFrame, t: str, name: str = "trading") -> DataFrame:
        """In session on a business day; a session from late to early belongs to the next day."""
        from ..operators.slices import second_of_day

        s = second_of_day(F.col(t))
        if self.day_start <= self.day_end:
            return self._out(at := self._at(df, t), {name: F.coalesce(at["_c_is_bday"], F.lit(False)) & s.between(self.day_start, self.day_end)})
        owner = df.withColumn("_d_t", F.when(s >= self.day_start, plus_days(F.col(t), 1)).otherwise(F.col(t)))
        at = self._at(owner, "_d_t")
        return self._out(at, {name: F.coalesce(F.col("_c_is_bday"), F.lit(False)) & ((s >= self.day_start) | (s <= self.day_end))})

    def trade_date(self, df: DataFrame, t: str, rule: str | None = None, name: str = "trade_date") -> DataFrame:
        """The business day that a stamp trades for.

        After a session f and m go to the next business day; before one p goes to the
        one before.  A session past midnight belongs to the day on which it ends.
        """
        from ..operators.slices import second_of_day

        rule = rule or self.rule
        s = second_of_day(F.col(t))
        overnight = self.day_end < self.day_start
        tomorrow = (s > self.day_start) if overnight else F.lit(False)
        late = ~tomorrow & (s >= self.day_end) if overnight else s > self.day_end
        early = F.lit(False) if overnight else s < self.day_start
        moved = df.withColumn("_d_t", F.when(tomorrow, plus_days(F.col(t), 1)).otherwise(F.col(t).cast(NTZ)))
        at = self._at(moved, "_d_t")
        day, res = F.col("_c_day"), self._adjusted(rule)
        if rule == "p":
            out = F.when(early & (res == day), F.col("_c_before")).otherwise(res)
        else:
            out = F.when(late, F.when(res > day, res).when(res == day, F.col("_c_after")).otherwise(F.col("_c_next"))).otherwise(res)
        return self._out(at, {name: out.cast(NTZ)})

    def filter(self, df: DataFrame, t: str) -> DataFrame:
        """Rows in session on business days."""
        return self.trading(df, t, "_trading").where("_trading").drop("_trading")


_known: dict[str, tuple[Calendar, dict]] = {}


def calendar(spark: SparkSession, key: str = "calendar", **how) -> Calendar:
    """The calendar registered under a key, or a new one where it is asked for differently."""
    if key not in _known or _known[key][0].spark is not spark or (how and _known[key][1] != how):
        _known[key] = Calendar(spark, key, **how), how
    return _known[key][0]
