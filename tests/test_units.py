"""Operators that SQL does not show: errors, files, trees, sessions, streams, tools."""

import datetime as D
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import compare, dates, kinds, missing, nested, tenor, text
from strandline.functions.calendars import Calendar
from strandline.operators import align, bitemporal, fill, frame, joins, slices
from strandline.plans import derive as plans
from strandline.plans import tooling
from strandline.queries import QUERIES
from strandline.sources import files
from strandline.streaming import incremental

T = D.datetime


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def series(spark, values, start=T(2024, 1, 1), name="v"):
    return spark.createDataFrame([(start + D.timedelta(i), v) for i, v in enumerate(values)], f"idx timestamp_ntz, {name} double")


# -- plans -------------------------------------------------------------------------
def test_dependencies(spark):
    t = spark.createDataFrame([(1, 2)], "a long, b long")
    assert rows(frame.derive(t, d=lambda c: c + 1, c=lambda a, b: a + b, e=7).select("c", "d", "e")) == [(3, 4, 7)]
    assert rows(frame.derive(t, a=lambda a: a + 10)) == [(11, 2)]
    with pytest.raises(ValueError):
        frame.derive(t, c=lambda d: d, d=lambda c: c)
    with pytest.raises(KeyError):
        frame.derive(t, c=lambda nothing: nothing)
    double = plans.row_function(lambda a: a * 2, "long")
    assert rows(frame.derive(t, c=lambda a: double(a=a)).select("c")) == [(2,)]


def test_tools(spark, tmp_path):
    assert plans.fold(lambda a, b: a + b, [], 5) == 5 and plans.fold(lambda a, b: a - b, [9, 2, 3]) == 4
    assert tooling.retry(lambda: 1 / 0, repeat=2, value="x")() == "x" and tooling.try_back(lambda v: 1 / 0)(8) == 8
    assert tooling.gather(lambda: spark.range(5).count(), lambda: spark.range(7).count()) == [5, 7]
    n = tooling.Names(["a", "b", "a"])
    assert n == ["a", "b"] and n + "c" == ["a", "b", "c"] and n & ["b"] == ["b"] and n - "a" == ["b"] and ["z", "a"] - n == ["z"] and (n + "ab") % "a" == ["a", "ab"]
    p = tooling.write_settings({"spark.sql.x": 1}, "/proc/none/x.json", str(tmp_path / "d" / "x.json"))
    assert tooling.read_settings(spark, p) == {"spark.sql.x": 1} and spark.conf.get("spark.sql.x") == "1"
    assert tooling.zone("tokyo") == "Asia/Tokyo" and tooling.timed(lambda: 3, 2)()[0] == 3
    with pytest.raises(ValueError):
        tooling.zone("nowhere")
    calls = []
    f = tooling.keyed_cache(lambda *a: calls.append(a) or len(calls))
    assert f(1) == f(1) == 1 and f([1]) == 2 and f([1]) == 3
    assert tooling.chain(spark.range(3), (frame.relabel, "x_"), lambda d: d.where("x_id > 0")).count() == 2


# -- tables -------------------------------------------------------------------------
def test_rows(spark):
    t = spark.createDataFrame([(1, "x"), (2, None), (2, "y")], "a long, b string")
    assert frame.one_or_none(t, a=9) is None and frame.one_or_none(t, a=1, column="b") == "x"
    with pytest.raises(ValueError):
        frame.one_or_none(t, a=2)
    assert frame.find(t, "b", a=1) == "x"
    with pytest.raises(ValueError):
        frame.find(t, "b")
    assert frame.inc(frame.inc(t, lambda a: a > 5), b="x").columns == ["a", "b"]  # an empty table keeps its columns
    assert frame.exc(t, b="x").count() == 2 and frame.inc(t, b=None).count() == 1
    assert frame.sort_by(t, []).count() == 3 and rows(frame.sort_by(t, b=["y", "x"]).select("b")) == [("y",), ("x",), (None,)]
    assert rows(frame.paste(t.select("a"), t.select(F.upper("b").alias("c")), "a", F.col("c").asc_nulls_last()), "a", "c")[0] == (1, "X")
    assert "..." in frame.to_text(t, rows=1) and frame.shape(t) == (3, 2) and len(list(frame.records(t))) == 3
    assert t.groupBy("a").agg(frame.unique_value("a").alias("u")).count() == 2
    with pytest.raises(Exception, match="not unique"):
        t.agg(frame.unique_value("b")).collect()


def test_groups(spark):
    t = spark.createDataFrame([(1, None, 2), (1, 5, 1), (None, 7, 3)], "a long, b long, o long")
    got = {r.a: r.b for r in frame.listby(t.select("a", "b", "o"), "a", order="o").collect()}
    assert got == {1: [5, None], None: [7]}
    with pytest.raises(ValueError):
        frame.groupby(t, "a", "b", "o")
    back = frame.ungroup(frame.groupby(t, "a", order="o"))
    assert sorted(map(str, rows(back))) == sorted(map(str, rows(t.select("a", "b", "o"))))
    bad = spark.createDataFrame([([1, 2], [3], "k")], "x array<long>, y array<long>, k string")
    with pytest.raises(Exception, match="unequal"):
        frame.unlist(bad).collect()
    assert rows(frame.unlist(bad, "x"), "x") == [(1, [3], "k"), (2, [3], "k")]
    p = frame.pivot(t.withColumn("o", F.col("o").cast("string")), "a", "o", "b", values=["1", "2"]).orderBy("a")
    assert rows(p) == [(None, None, None), (1, [5], None)]


def test_joins(spark):
    a = spark.createDataFrame([(1, float("nan")), (None, 1.0)], "k long, v double")
    b = spark.createDataFrame([(None, 2.0), (3, float("nan"))], "k long, v double")
    assert rows(joins.join(a, b, "k", mode=lambda x, y: x + y)) == [(None, 3.0)]
    assert joins.join(a, b, "v").count() == 1  # NaN meets NaN
    assert rows(joins.xor(a, b, "k").select("k")) == [(1,)] and rows(joins.xor(a, b, "k", mode="r").select("k")) == [(3,)]
    assert joins.xor(a, b.toDF("p", "q")).count() == 2  # nothing shared: unchanged
    with pytest.raises(ValueError):
        joins.join(a, b, lambda k: k, lambda v: v)
    with pytest.raises(KeyError):
        joins.join_all({"z": a.withColumn("w", F.lit(1))}, "k")
    assert rows(joins.join_all({"x": a.toDF("k", "x"), "y": b.toDF("k", "y")}, "k", defaults={"y": 0.5}).orderBy("k").select("k", "y")) == [(None, 2.0), (1, 0.5)]


# -- series ----------------------------------------------------------------------------
NAN = float("nan")


@pytest.mark.parametrize(
    ("method", "limit", "want"),
    [
        ("ffill", None, [None, 1, 1, 1, 4, 4]),
        ("ffill", 1, [None, 1, 1, None, 4, 4]),
        ("bfill", None, [1, 1, 4, 4, 4, None]),
        ("bfill", 1, [1, 1, None, 4, 4, None]),
        ("ffill_na", None, [None, 1, 1, 1, 4, None]),
        ("ffill_0", None, [None, 1, 1, 1, 4, 0]),
        ("linear", None, [None, 1, 2, 3, 4, 4]),
        ("linear", 1, [None, 1, 2, None, 4, 4]),
        (9.0, None, [9, 1, 9, 9, 4, 9]),
        ("fnna", None, [1, None, None, 4, None]),
        ("nona", None, [1, 4]),
        (["ffill", 0.0], None, [0, 1, 1, 1, 4, 4]),
    ],
)
def test_fills(spark, method, limit, want):
    t = series(spark, [None, 1.0, NAN, float("inf"), 4.0, None])
    got = missing.clean(fill.fill(t, "idx", method, limit=limit), "v")
    assert [r[1] for r in rows(got, "idx")] == want


def test_reads_as_of(spark):
    t = series(spark, [1.0, None, 3.0])
    index = spark.createDataFrame([(T(2023, 12, 31),), (T(2024, 1, 2),), (T(2024, 1, 2, 12),), (T(2024, 1, 9),), (T(2024, 1, 10),)], "idx timestamp_ntz")
    read = lambda m, n=None: [r[1] for r in rows(align.reindex(t, index, "idx", (), m, n), "idx")]
    assert read("ffill") == [None, 1, 1, 3, 3] and read("bfill") == [1, 3, 3, None, None] and read(None) == [None] * 5
    assert read("ffill", 1) == [None, 1, None, 3, None]
    assert align.reindex(t.limit(0), index, "idx", (), "ffill").count() == 5


def test_arithmetic(spark):
    a, b = series(spark, [1.0, NAN, 3.0]), series(spark, [0.0, 5.0], T(2024, 1, 2))
    val = lambda df: [r[1] for r in rows(df, "idx")]
    assert val(align.add(a, b)) == [None, 8] and val(align.div(a, b)) == [None, 0.6] and val(align.div(b, 0.0)) == [None, None]
    assert val(align.sub([a, a], 1.0)) == [1, None, 5] and val(align.power(a, 2.0)) == [1, None, 9]
    assert val(align.gt(a, b)) == [False, False] and val(align.le(a, b)) == [False, True] and val(align.absolute(align.mul(a, -1.0))) == [1, None, 3]
    assert val(align.maximum(a, b, join="outer")) == [None, None, 5] and val(align.minimum([a, a], 2.0)) == [1, None, 2]
    two = a.withColumn("w", F.col("v") * 10)
    assert rows(align.mul(two, b), "idx")[1][1:] == (15, 150)
    assert align.vconcat([a, two]).columns == ["idx", "v", "w"] and align.vconcat([a, two], "inner").columns == ["idx", "v"]
    assert rows(align.aggregate(two, F.sum)) == [(4.0, 40.0)] and rows(align.aggregate(series(spark, [NAN]), F.sum)) == [(None,)]
    assert [r[1] for r in rows(align.across([a, b], "count", exclude=[5.0]), "idx")] == [1, 2, 1]
    assert rows(fill.mask_to_value(a, ["v"]), "idx")[1][1] == 0.0


def test_slices(spark):
    t = series(spark, [1.0, 2.0, 3.0, 4.0])
    with pytest.raises(ValueError):
        slices.between(t, "idx", None, None, "  ")
    assert slices.between(t, "idx", T(2024, 1, 1), T(2024, 1, 3)).count() == 2 and slices.between(t, "idx", None, T(2024, 1, 3), "[)").count() == 2
    flag = F.col("v").isin(2.0, 3.0)
    kept = lambda deal: [r[1] for r in rows(slices.after_issue(t, flag, "idx", (), deal), "idx")]
    assert kept("last") == [4] and kept("first") == [3, 4] and kept(0) == [3, 4] and kept(1) == [4] and kept(-1) == [4] and kept(7) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="issue"):
        slices.after_issue(t, flag, "idx", (), "raise").collect()
    assert slices.degap(t, "idx").count() == 4
    assert rows(slices.gap_days(t, "idx", now=T(2024, 1, 9, 23)), "idx")[-1][2] == 5
    twice = t.union(t.withColumn("v", F.col("v") + 10))
    assert [r[1] for r in rows(slices.one_per_index(twice, "idx", "v", keep="first"), "idx")] == [1, 2, 3, 4]
    chain = spark.createDataFrame([(1, None), (2, None), (3, T(2024, 3, 1))], "c long, until timestamp_ntz")
    seen = spark.createDataFrame([(1, T(2024, 2, 9)), (2, T(2024, 2, 1))], "c long, until timestamp_ntz")
    assert [r[1] for r in rows(slices.infer_until(chain, seen, "c", "until", "c"), "c")] == [T(2024, 2, 1), T(2024, 2, 1), T(2024, 3, 1)]


def test_bitemporal(spark):
    t = series(spark, [1.0, None, 3.0])
    assert bitemporal.stamp(t, "idx", None, "2024-02-01") is t and bitemporal.read(t, "idx") is t
    s = bitemporal.stamp(t, "idx", lambda i: dates.bump(i, "1b"), "2024-01-03")
    assert max(r[2] for r in rows(s)) == T(2024, 1, 3)
    again = bitemporal.merge(bitemporal.merge(None, s, "idx"), s, "idx")
    assert again.count() == 3  # merging twice changes nothing
    new = bitemporal.merge(s, s.withColumns({"updated": dates.plus_days(F.col("updated"), 9), "v": F.col("v") * 2}), "idx")
    assert sorted(r.v or 0 for r in bitemporal.read(new, "idx").collect()) == [0, 2, 6] and bitemporal.read(new, "idx", what="all").count() == 5


def test_by_update_keeps_each_row_of_a_stamp(spark):
    stamps = [(T(2024, 1, 1), "a", T(2024, 1, 5), 1), (T(2024, 1, 2), "a", T(2024, 1, 5), 2), (T(2024, 1, 2), "a", T(2024, 1, 5), None), (T(2024, 1, 2), "a", T(2024, 1, 5), 2), (None, None, None, 7), (None, None, None, 7)]
    t = spark.createDataFrame(stamps, "idx timestamp_ntz, k string, updated timestamp_ntz, v long")
    each = lambda n: sorted((r.v or 0) for r in bitemporal.by_update(t, "idx", n, ["k"], whole=True).collect())
    assert each(-1) == [0, 2, 2, 7, 7] and each(0) == [1, 7, 7] and each(1) == [0, 2, 2, 7, 7] and each(-9) == [1, 7, 7]
    assert bitemporal.by_update(t, "idx", by=["k"]).count() == 2


def test_merge_orders_rows_of_a_stamp(spark):
    rev = lambda *r: spark.createDataFrame([(T(2024, 1, 1), T(2024, 1, d), n, v, w) for d, n, v, w in r], "idx timestamp_ntz, updated timestamp_ntz, n long, v double, w double")
    old = rev((2, 1, 1.0, 1.0), (3, 2, 9.0, 9.0))
    new = rev((3, 6, math.nan, 5.0), (3, 4, 2.0, None), (3, 5, 3.0, None), (4, 7, 3.0, 5.0), (5, 9, 3.0, 6.0), (5, 8, 3.0, 5.0), (6, 10, 2.0, None))
    got = bitemporal.merge(old, new, "idx", order=["n"])
    assert [(r.n, r.v, r.w) for r in got.orderBy("updated").collect()] == [(1, 1.0, 1.0), (4, 2.0, None), (8, 3.0, 5.0), (10, 2.0, None)]
    assert [r.v for r in bitemporal.merge(old.drop("n"), new.drop("n"), "idx").orderBy("updated").collect() if r.updated.day == 5] == [3.0]


# -- dates -------------------------------------------------------------------------------
def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_bumps(spark):
    assert dates.parse_bump("1y1m-1d") == [(1, "y"), (1, "m"), (-1, "d")] and dates.parse_bump("o/n") == [(1, "b")]
    assert dates.negative("2w") == "-2w" and dates.negative(5) == -5 and dates.is_bump("3m") and not dates.is_bump("m3") and dates.is_bump(1499) and not dates.is_bump(1500)
    for bad in ("", "3x", "3m?", "hello"):
        with pytest.raises(ValueError):
            dates.parse_bump(bad)
    t = F.lit("2022-08-30 10:00:00").cast("timestamp_ntz")
    got = one(spark, *[dates.bump(t, b) for b in ("6m", "1d", 2, "-1w", "2h", "30n", "5s", "1y-1d")], dates.bump(t, "6m", eom=True), dates.bump(t, "6m", eom=0))
    assert got == (T(2023, 3, 2), T(2022, 8, 31, 10), T(2022, 9, 1, 10), T(2022, 8, 23, 10), T(2022, 8, 30, 12), T(2022, 8, 30, 10, 30), T(2022, 8, 30, 10, 0, 5), T(2023, 8, 29), T(2023, 2, 27, 10), T(2023, 3, 2))
    for n in range(-23, 24):
        day = np.datetime64("2024-03-01") + np.arange(14)
        want = np.busday_offset(day, n, roll="forward")
        df = spark.createDataFrame([(str(d),) for d in day], "d string").select("d", dates.bump(F.col("d").cast("timestamp_ntz"), f"{n}b").alias("x")) if n % 11 == 0 else None
        if df is not None:
            assert [str(r.x)[:10] for r in df.orderBy("d").collect()] == [str(w) for w in want]


def test_parse_tries_no_format_in_vain(spark, data):
    """One format a group, in a method that Java compiles (below 8,000 bytes)."""
    text = F.col("s")
    df = spark.createDataFrame([("2001-02-03",)], "s string").select(dates.parse(text).alias("uk"), dates.parse(text, "us").alias("us"))
    assert df._jdf.queryExecution().analyzed().toString().count("try_to_timestamp(") == 6
    for made in (df, QUERIES["date_text"](spark, data)):
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(made._jdf.queryExecution().executedPlan())
        assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    shapes = [dates._WHOLE, dates._SLASHED, dates._NAMED_MONTH]
    texts = {"2001-2-3 4:5", "+12001-2-3", "2001-2", "20010203", "2001/2/3", "2001", "01", "2001 4:5:6", "3 May 2001", "3-Sept-2001", "May 2001", "May - 3 2001", "0001-02-03T4:5:6"}
    assert all(sum(bool(re.search(f"^{shape}$", t)) for shape, _ in group) <= 1 for group in shapes for t in texts)


def test_parse_of_odd_texts(spark):
    d = T(2001, 2, 3)
    want = {
        "2001-2-3t4:5:6": T(2001, 2, 3, 4, 5, 6), "2001-02-03 4:5:6": T(2001, 2, 3, 4, 5, 6), "2001-002-3 4:5": T(2001, 2, 3, 4, 5), "2001/2/3": d, "2001-02-30": None, "2001-13": None,
        "3.2.2001": d, "3 2 2001 4:5": T(2001, 2, 3, 4, 5), "03/02/2001 04:05:06": T(2001, 2, 3, 4, 5, 6), "003/2/2001": d, "003-2-2001": None, "3-2/2001": None, "3/2/001": None, "31/2/2001": None,
        "0003/2/2001": d, "0003/2/0001": T(3, 2, 1), "0013/03/0002": T(13, 3, 2), "3-feb-2001": d, "3  FEBRUARY -2001": d, "Feb - 2001": T(2001, 2, 1), "feb 3 2001": d, "3 Febr 2001": None, "-3 Feb 2001": None,
        "3 May 2001": T(2001, 5, 3), " 20010203 ": d, "120010203": None, "20010203\n": None, "2001-02-03 ": d, "2001-02-03Z": None,
    }
    rows = spark.createDataFrame(list(enumerate(want)), "i int, s string").orderBy("i").select("s", dates.parse(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == want
    assert one(spark, dates.parse(F.lit("0003/13/0002"), "us"), dates.parse(F.lit("0003/13/0002"))) == (T(2, 3, 13), None)


def test_dates(spark):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    texts = ["2001-02-03", "20010203", "3/2/2001", "03-02-01", "3 Feb 2001", "2001-02", "nonsense", "", None, "2001-02-03T04:05:06"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").orderBy("i").select(dates.parse(F.col("s"))).collect()]
    d = T(2001, 2, 3)
    assert got == [d, d, d, d, d, T(2001, 2, 1), None, None, None, T(2001, 2, 3, 4, 5, 6)]
    assert one(spark, dates.parse(F.lit("2/3/2001"), "us")) == (d,)
    n = lambda v: dates.from_number(F.lit(float(v)), ntz("2024-05-06 07:08:09"))
    assert one(spark, n(0), n(-1), n(1999), n(36526), n(730120), n(20000101), n(946684800)) == (T(2024, 5, 6), T(2024, 5, 5), T(1999, 1, 1), *[T(2000, 1, 1)] * 4)
    assert one(spark, *[dates.month_number(F.lit(m)) for m in ("5", "May", "k", "september", "?")]) == (5, 5, 5, 9, None)
    assert one(spark, dates.nth_weekday(F.lit(2020), F.lit(2), -1, 5), dates.nth_weekday(F.lit(2020), F.lit(12), -2, 0)) == (T(2020, 2, 29), T(2020, 12, 21))
    a, b = ntz("2024-01-31"), ntz("2024-04-30")
    counts = one(spark, *[F.size(dates.sequence(a, b, s)) for s in (1, "1w", "1m", "1q", "1b", "-1d", "12h")])
    assert counts == (91, 13, 3, 1, 65, 0, 181)
    assert one(spark, F.size(dates.sequence(b, a, "-2d")), F.size(dates.sequence(a, a, "1y"))) == (46, 1)
    with pytest.raises(ValueError):
        dates.sequence(a, b, "1m1d")
    assert one(spark, *[dates.seconds_of_day(F.lit(x)) for x in ("9", "0930", "93015", "9:30", "09:30:15", "x")]) == (32400, 34200, 34215, 34200, 34215, None)
    assert one(spark, dates.convert_zone(ntz("2024-01-01 12:00:00"), "UTC", tooling.zone("tokyo"))) == (T(2024, 1, 1, 21),)
    assert one(spark, dates.to_text(ntz("2024-01-02 03:04:05")), dates.to_text(a, "Ymd"), dates.to_text(a, "Y-m")) == ("2024-01-02T03:04:05", "20240131", "2024-01")
    assert one(spark, dates.clock(a, None), dates.clock(a, "f"), dates.clock(ntz("2000-01-01 12:00:00"), "k")) == (None, 738916.0, 26090)
    moved = dates.bump_index(series(spark, [1.0, 2.0, 3.0], T(2024, 1, 5)), "idx", "0b")
    assert rows(moved, "idx") == [(T(2024, 1, 5), 1.0), (T(2024, 1, 8), 3.0)]


def test_calendar(spark):
    c = Calendar(spark, "t", [D.date(2021, 2, 9)], first="2020-01-01", last="2023-01-01", day_start=9 * 3600, day_end=17 * 3600)
    t = spark.createDataFrame([(T(2021, 2, 8, 18),), (T(2021, 2, 8, 8),), (T(2021, 2, 8, 12),), (T(2021, 2, 9, 12),), (T(2021, 2, 5, 23),)], "t timestamp_ntz")
    assert [r.trading for r in c.trading(t, "t").orderBy("t").collect()] == [False, False, True, False, False]
    assert [r.trade_date.day for r in c.trade_date(t, "t", "f").orderBy("t").collect()] == [8, 8, 8, 10, 10]
    assert [r.trade_date.day for r in c.trade_date(t, "t", "p").orderBy("t").collect()] == [5, 5, 8, 8, 8]
    night = Calendar(spark, "n", [], first="2020-01-01", last="2023-01-01", day_start=22 * 3600, day_end=5 * 3600)
    u = spark.createDataFrame([(T(2021, 2, 5, 23),), (T(2021, 2, 7, 23),), (T(2021, 2, 8, 4),), (T(2021, 2, 8, 12),)], "t timestamp_ntz")
    assert [r.trading for r in night.trading(u, "t").orderBy("t").collect()] == [False, True, True, False]
    assert [r.trade_date.day for r in night.trade_date(u, "t", "f").orderBy("t").collect()] == [8, 8, 8, 9]
    assert night.filter(u, "t").count() == 2
    assert [r.bumped.day for r in c.bump(t, "t", "+0b").orderBy("t").collect()] == [5, 8, 8, 8, 10]
    assert [r.bumped.day for r in c.bump(t, "t", "-1b").orderBy("t").collect()] == [4, 5, 5, 5, 8]
    assert c.days("2021-02-05", "2021-02-12", 2, overshoot=False).count() == 3 and c.days("2021-02-05", "2021-02-12", 3).count() == 3


def test_curves(spark):
    assert one(spark, *[tenor.tenor_years(F.lit(x)) for x in ("6m", "spot", "t/n", "1.5", "x")]) == (0.5, 0.0, 2 / 365, 1.5, None)
    xs, ys = F.array(*map(F.lit, (1.0, 2.0, 4.0))), F.array(*map(F.lit, (10.0, NAN, 40.0)))
    at = lambda x, o=None: tenor.interpolate(xs, ys, F.lit(x), o)
    assert one(spark, at(2.0), at(0.0), at(5.0, "bound"), at(5.0, "extrapolate"), at(0.0, -1.0)) == (20.0, None, 40.0, 50.0, -1.0)
    assert one(spark, tenor.interpolate(F.array(F.lit(1.0)), F.array(F.lit(1.0)), F.lit(1.0))) == (None,)
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 8.0, 27.0], x) for x in (0.4, 1.0, 9.0)], "x array<double>, y array<double>, at double")
    got = {k: [r.o for r in tenor.interpolate_kind(df, "x", "y", "at", "o", k).orderBy("at").collect()] for k in ("nearest", "previous", "next", "cubic")}
    assert got["nearest"] == [0, 1, None] and got["previous"] == [0, 1, None] and got["next"] == [1, 1, None] and math.isclose(got["cubic"][1], 1.0)


# -- text and trees ------------------------------------------------------------------------
def test_text(spark):
    r = lambda s, *a: one(spark, text.replace(F.lit(s), *a))[0]
    assert r("this    has lots  of   spaces", "  ", " ") == "this has lots of spaces" and r("a,b!c?", list(",!?")) == "abc"
    assert r("aabbab", "ab") == "" and r("xaaab", "ab", "b") == "xb" and r("aaaa", "aa", "") == "" and r("aaa", "aa", "") == "a" and r("", "a", "b") == ""
    with pytest.raises(ValueError):
        text.replace(F.lit("x"), "a", "aa")
    nums = ["1,234", "-1.5 bn", "100 pct", "20bp", "3 lakh", "", "abc", "1.2.3", "7", "1e3", ".5k"]
    assert [one(spark, text.as_float(F.lit(n)))[0] for n in nums] == [1234.0, -1.5e9, 1.0, 0.002, 300000.0, None, None, None, 7.0, 1000.0, 500.0]
    assert one(spark, text.ticker_case(F.lit("es1 index")), text.ticker_case(F.lit("x index y")), text.ticker_case(F.lit("aapl us"))) == ("ES1 Index", "X Index Y", "AAPL US")
    assert one(spark, text.clean_name(F.lit(' A.b (c)/"d" & e')), text.capitalize(F.lit("hELLO wORLD")), text.lower(F.array(F.lit("A")), array=True)) == ("ab_c_d___e", "Hello world", ["a"])
    assert one(spark, text.without_prefix(F.lit("a_b_x"), F.lit("a_b_")), text.without_prefix(F.lit("a_bx"), F.lit("a_b"), "_")) == ("x", "bx")
    assert one(spark, text.split(F.lit("a b/c"), [" ", "/"]), text.two_decimals(F.lit(1.126))) == (["a", "b", "c"], "1.13")
    assert one(spark, text.strip(F.lit("\t x \n")), text.strip(F.lit("--x-"), "-"), text.as_ascii(F.lit("a\\é~\x7f"))) == ("x", "x", "a~")


def test_trees(spark):
    doc = '{"school": {"ann": {"age": 9, "kind": "girl"}, "bob": {"age": 8, "kind": "boy"}, "cy": {"kind": "boy"}}}'
    t = spark.createDataFrame([(1, doc)], "k long, j string").select("k", F.parse_json("j").alias("tree"))
    assert nested.is_pattern("a/%b") and not nested.is_pattern("a/b")
    assert rows(nested.to_table(t, "tree", "school/%name/age/%age", {"age": "int"}), "name") == [(1, "ann", 9), (1, "bob", 8)]
    assert rows(nested.to_table(t, "tree", "school/%name/kind/boy").select("name"), "name") == [("bob",), ("cy",)]
    assert nested.to_table(t, "tree", "school/%name/%rest", leaf=True).count() == 3
    got = rows(nested.leaves(t.select("k", F.to_json("tree").alias("tree")), "tree", 3).select("k1", "k2", "leaf"), "k1", "k2")
    assert got[0] == ("ann", "age", "9") and len(got) == 5
    assert one(spark, nested.get(F.parse_json(F.lit(doc)), ["school", "bob", "age"], "int"), nested.get(F.parse_json(F.lit(doc)), ["x"], "int", -1)) == (8, -1)
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    assert one(spark, nested.update(m(a=1, b=2), m(b=3, c=4)), nested.set_item(m(a=1), ["b"], F.lit(2)), nested.map_at_depth(m(a=1), lambda v: v + 1)) == ({"a": 1, "b": 3, "c": 4}, {"a": 1, "b": 2}, {"a": 2})
    table = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 3)], "a string, b string, v long")
    assert nested.from_table(table, "%a/in/%b/%v").first().tree == {"x": {"in": {"p": 1, "q": 2}}, "y": {"in": {"p": 3}}}
    with pytest.raises(Exception):  # noqa: B017  a repeated path
        nested.from_table(table.union(table), "%a/%b/%v").collect()
    assert one(spark, F.size(nested.zipped(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"))))) == (2,)
    with pytest.raises(Exception, match="unequal"):
        one(spark, nested.zipped(F.array(*map(F.lit, (1, 2))), F.array(*map(F.lit, (1, 2, 3)))))
    assert one(spark, nested.vector_reduce(F.array(F.lit(1), F.lit(2)), F.lit(0), lambda a, b: a + b), nested.vector_map(F.array(F.lit(1)), lambda x: x * 2)) == (3, [2])


def test_compare(spark):
    n = F.lit(None).cast("double")
    assert one(spark, compare.equal(n, n), compare.near(F.lit(1.0), F.lit(1.0 + 1e-12)), compare.near(n, F.lit(1.0)), compare.near(F.lit(NAN), F.lit(NAN)), compare.member(n, [None, 2]), compare.member(F.lit(NAN), [NAN])) == (True, True, False, True, True, True)
    t = spark.createDataFrame([(1, "number", "5"), (2, "str", "a"), (3, "number", "2"), (4, "str", None)], "i int, k string, v string")
    mixed = F.when(F.col("k") == "number", compare.tagged("number", F.col("v").try_cast("double"))).otherwise(compare.tagged("str", F.col("v")))
    assert [r.i for r in t.orderBy(mixed).collect()] == [4, 3, 1, 2]
    s = spark.createDataFrame([], "t timestamp_ntz, a int, b boolean, c array<int>, d map<string,map<string,int>>")
    assert kinds.is_series(s) and kinds.series_columns(s, kinds.is_int) == ["a"] and kinds.is_tree(kinds.kind(s, "d"), 2) and not kinds.is_tree(kinds.kind(s, "c"))
    assert kinds.floats(s).dtypes[1] == ("a", "double") and kinds.is_primitive(kinds.kind(s, "b"))


# -- files -------------------------------------------------------------------------------------
def test_files(spark, tmp_path):
    with open(tmp_path / "Mixed Case.csv", "w") as f:
        f.write("A b,c\n1,x\n2\n,#N/A\n")
    t = files.read(spark, f"{tmp_path}/Mixed Case.csv")
    assert t.dtypes == [("A b", "string"), ("c", "string")] and t.count() == 3
    clean = files.clean_sheet(t, ints=["a_b"], required=["a_b"])
    assert rows(clean, "a_b") == [(1, "x"), (2, None)]
    open(tmp_path / "empty.csv", "w").write("a,b\n")
    assert files.read_csv(spark, f"{tmp_path}/empty").count() == 0
    files.write(clean, f"{tmp_path}/out.parquet", by=["a_b"])
    assert files.read(spark, f"{tmp_path}/out.parquet").count() == 2 and files.tables(spark, f"file://{tmp_path}/out.parquet", "*.parquet").count() == 2
    assert {r.k0 for r in files.tree(spark, f"file:{tmp_path}", 1).collect()} >= {"empty.csv", "out.parquet"}
    np.save(tmp_path / "a.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert rows(files.read(spark, f"{tmp_path}/a.npy"), "i") == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    assert files.is_path("x.csv") and files.is_path("x.xlsx!s") and not files.is_path("x.pickle")
    with pytest.raises(ValueError):
        files.read(spark, "x.pickle")
    assert rows(files.table(spark, a=[1, 2], b="k"), "a") == [(1, "k"), (2, "k")] and rows(files.table(spark, [("a", "b"), (1, 2)])) == [(1, 2)]
    with pytest.raises(ValueError):
        files.table(spark, a=[1, 2], b=[1, 2, 3])
    shape = files.record("a int, b string", {"b": "d"}, checks={"a": lambda c: c > 0})
    assert rows(shape(spark.createDataFrame([("7",)], "a string"))) == [(7, "d")]
    with pytest.raises(Exception, match="check"):
        shape(spark.createDataFrame([(0,)], "a int")).collect()
    with pytest.raises(KeyError):
        shape(spark.createDataFrame([("x",)], "b string"))


# -- incremental ---------------------------------------------------------------------------------
def test_per_row(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "k string, x long")
    b = spark.createDataFrame([("p", 10), ("q", 20), ("r", 30)], "k string, y long")
    old = spark.createDataFrame([("p", 0), ("q", None)], "k string, data long")
    f = lambda x, y: x + y
    get = lambda **k: [r[1] for r in rows(incremental.per_row(f, {"x": a, "y": b}, "k", **k), "k")]
    ends = spark.createDataFrame([("p", D.date(2020, 1, 1)), ("q", D.date(2020, 1, 1)), ("r", D.date(2020, 1, 1))], "k string, expiry date")
    assert get() == [11, 22, 33] and get(cached=old) == [0, None, 33] and get(cached=old, if_none=True) == [0, 22, 33]
    assert get(cached=old, expiry=ends, today=D.date(2020, 1, 1)) == [11, 22, 33] and get(cached=old, expiry=ends, today=D.date(2020, 1, 2)) == [0, None, 33]
    two = incremental.per_row(lambda x, y: F.struct((x + y).alias("s"), (x * y).alias("m")), {"x": a, "y": b}, "k", outputs={"s": "long", "m": "long"}, include_inputs=True)
    assert rows(two, "k")[0] == ("p", 1, 10, 11, 10)


def test_resume(spark):
    s = series(spark, [1.0, 2.0, 3.0]).withColumn("k", F.lit("a"))
    old = s.where("v <= 2").withColumn("v", -F.col("v"))
    f = lambda x: x.withColumn("v", F.col("v") * 10)
    assert sorted(r.v for r in incremental.resume(f, "idx", old, s, by=["k"]).collect()) == [-1, 20, 30]
    assert sorted(r.v for r in incremental.resume(f, "idx", old, s, by=["k"], redo_last=False).collect()) == [-2, -1, 30]
    assert sorted(r.v for r in incremental.resume(f, "idx", None, s).collect()) == [10, 20, 30]


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    series(spark, [1.0, 2.0]).withColumn("updated", F.col("idx")).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("idx timestamp_ntz, v double, updated timestamp_ntz").parquet(src)
    merge = lambda old, new: bitemporal.merge(old, new, "idx")
    incremental.merge_stream(stream(), out, f"{tmp_path}/c", merge).awaitTermination()
    series(spark, [5.0]).withColumn("updated", dates.plus_days(F.col("idx"), 4)).coalesce(1).write.mode("append").parquet(src)
    incremental.merge_stream(stream(), out, f"{tmp_path}/c", merge).awaitTermination()
    last = max(int(p.split("=")[1]) for p in os.listdir(out) if "=" in p)
    assert last == 1 and spark.read.parquet(f"{out}/version={last}").count() == 3
    w = incremental.windowed(stream(), "idx", "2 days", "1 day", total=F.sum("v"))
    assert w.isStreaming and w.columns == ["start", "end", "total"]


def test_null_keys_are_keys_of_series(spark):
    left = spark.createDataFrame([(None, 1, 1.0), (None, 3, 2.0), ("a", 2, 3.0)], "k string, t int, v double")
    right = spark.createDataFrame([(None, 2, 10.0), ("a", 1, 20.0)], "k string, t int, w double")
    got = {(r.k, r.t): r.w for r in align.recent(left, right, "t", ["k"]).collect()}
    assert got == {(None, 1): None, (None, 3): 10.0, ("a", 2): 20.0}
    assert align.joint_index([left, left.where("t > 1")], "t", "inner", ["k"]).count() == 2
    old = left.where("t < 3").withColumn("v", F.lit(-1.0))
    from strandline.streaming import incremental

    assert sorted(map(str, incremental.resume(lambda x: x, "t", old, left, by=["k"]).collect())) == sorted(map(str, [left.first(), *left.where("t > 1").collect()]))


def test_times_of_day_have_fractions(spark):
    t = spark.sql("select id, timestamp_ntz'2024-01-01 22:00:00' + make_dt_interval(0, 0, 0, id * 0.5) as ts from range(4)")
    assert [r.id for r in slices.time_of_day(t, "ts", 22 * 3600, 2 * 3600).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in slices.time_of_day(t, "ts", 22 * 3600, 22 * 3600 + 1).orderBy("id").collect()] == [1, 2]


def test_bounds_that_neither_rise_nor_fall():
    assert slices.is_ascending([None, 1, 1, 3, None]) and not slices.is_ascending([3, 2, None])
    for bad in ([1, 3, 2], [1, None, 2]):
        with pytest.raises(ValueError):
            slices.is_ascending(bad)


def test_wrappers_collapse():
    from strandline.plans import tooling

    class Note(tooling.Wrapper):
        def run(self, *a):
            return self.function(*a) + self.options["note"]

    class Twice(tooling.Wrapper):
        def run(self, *a):
            return self.function(*a) * 2

    one = Note(Twice(Note(str.lower, note="!")), note="?")
    assert one("A") == "aa?" and isinstance(one.function, Twice) and one.function.function is str.lower
    assert Note(note="#")(str.upper)("b") == "B#" and "note='?'" in repr(one) and one.__name__ == "lower"
    with pytest.raises(KeyError):
        tooling.Picked(lambda a: a, strict=True)({"b": 1})
    assert tooling.Picked(lambda a, b: (a, b), remap={"b": "x"})({"a": 1}, {"x": 2}) == (1, 2)


def test_streams_write_the_partitions_that_change(spark, tmp_path):
    from strandline.streaming import incremental

    folder = str(tmp_path)
    for k, part in enumerate((["a", "b"], ["b"], ["c", "b"])):
        spark.createDataFrame([(p, k) for p in part], "p string, k int").coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema("p string, k int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")

    def combine(old, new):
        new = new.groupBy("p").agg(F.count("*").alias("n"))
        both = new if old is None else new.unionByName(old)
        return both.groupBy("p").agg(F.sum("n").alias("n"))

    incremental.merge_stream(stream, f"{folder}/out", f"{folder}/log", combine, by="p").awaitTermination()
    assert sorted(map(tuple, incremental.merged(spark, f"{folder}/out", "p").select("p", "n").collect())) == [("a", 1), ("b", 3), ("c", 1)]
    assert spark.read.parquet(f"{folder}/out").where("p = 'a'").select("version").distinct().count() == 1
