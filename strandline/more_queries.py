"""Queries over single cells, names, sources and tools; they register beside those of ``queries``."""

from __future__ import annotations

import datetime
import enum
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import compare, dates, kinds, missing, nested, tenor, text
from .functions.calendars import calendar
from .operators import align, fill, frame, slices
from .plans import derive, tooling
from .queries import _daily, _day, query, read
from .sources import files
from .streaming import incremental


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared one that the session names; a temporary one on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/strandline-{uuid.uuid4().hex}"


# -- comparison -----------------------------------------------------------------------
_CELLS = "with t as (select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 5 = 0 then 'nan'::double else c_acctbal end as a, case when c_custkey % 6 = 0 then null when c_custkey % 5 = 0 then 'nan'::double else floor(c_acctbal) end as b from customer) "


def _cells(spark, sf):
    k, nan = F.col("c_custkey"), F.lit(float("nan"))
    a = F.when(k % 3 == 0, None).when(k % 5 == 0, nan).otherwise(F.col("c_acctbal"))
    b = F.when(k % 6 == 0, None).when(k % 5 == 0, nan).otherwise(F.floor("c_acctbal").cast("double"))
    return read(spark, sf, "customer").select("c_custkey", a.alias("a"), b.alias("b"))


@query(_CELLS + "select c_custkey, a is not distinct from b as same, coalesce(not isnan(a) and not isnan(b) and abs(a - b) < 0.25, false) or a is not distinct from b as close, a is null or coalesce(isnan(a) or a in (2229.54, 6281.08), false) as known from t")
def cells_compared(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _cells(spark, sf).select("c_custkey", compare.equal(a, b).alias("same"), compare.near(a, b, 0.25).alias("close"), compare.member(a, [None, float("nan"), 2229.54, 6281.08]).alias("known"))


@query(
    "with t as (select p_partkey, p_size, p_partkey % 5 as k, p_brand, p_retailprice from part), r as (select *, case k when 0 then 0 when 1 then 1 when 2 then 3 when 4 then 3 else 4 end as kind, case k when 1 then p_partkey % 2 when 2 then p_partkey % 97 when 4 then p_retailprice end as num, case k when 3 then p_brand end as txt from t) "
    "select p_partkey, row_number() over (partition by p_size order by kind, num nulls first, txt nulls first, p_partkey)::int as place from r"
)
def mixed_sort(spark, sf):
    from pyspark.sql import Window

    k = F.col("p_partkey") % 5
    cell = F.when(k == 1, F.when(F.col("p_partkey") % 2 == 1, "true").otherwise("false")).when(k == 2, (F.col("p_partkey") % 97).cast("string")).when(k == 3, F.concat(F.lit('"'), "p_brand", F.lit('"'))).when(k == 4, F.col("p_retailprice").cast("string"))
    t = read(spark, sf, "part").select("p_partkey", "p_size", F.parse_json(cell).alias("v"))
    keyed = t.select("p_partkey", "p_size", compare.mixed(F.col("v")).alias("key"))
    return keyed.select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy("key", "p_partkey")).alias("place"))


@query("select p_partkey, row_number() over (order by case when p_size % 3 = 0 then 0 else 3 end, case when p_size % 3 = 1 then 'inf'::double when p_size % 3 = 2 then p_retailprice end, p_partkey)::int as place from part")
def tagged_sort(spark, sf):
    from pyspark.sql import Window

    size = F.col("p_size") % 3
    number = F.when(size == 1, float("nan")).when(size == 2, F.col("p_retailprice"))
    t = read(spark, sf, "part").select("p_partkey", compare.tagged("number", number).alias("key"))
    return t.select("p_partkey", F.row_number().over(Window.orderBy("key", "p_partkey")).alias("place"))


@query("select column_name as name, column_type in ('BIGINT', 'INTEGER') as is_int, column_type in ('DOUBLE', 'FLOAT') as is_float, column_type in ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') as is_num, column_type = 'VARCHAR' as is_str, column_type like 'TIMESTAMP%' as is_date, column_type = 'BOOLEAN' as is_bool, column_type like '%[]' as is_array, column_type not like '%[]' as is_primitive from (describe orders) union all select column_name, column_type in ('BIGINT', 'INTEGER'), column_type in ('DOUBLE', 'FLOAT'), column_type in ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT'), column_type = 'VARCHAR', column_type like 'TIMESTAMP%', column_type = 'BOOLEAN', column_type like '%[]', column_type not like '%[]' from (describe embeddings)")
def column_kinds(spark, sf):
    tests = (kinds.is_int, kinds.is_float, kinds.is_num, kinds.is_str, kinds.is_date, kinds.is_bool, kinds.is_array, kinds.is_primitive)
    rows = [(f.name, *(t(f.dataType) for t in tests)) for name in ("orders", "embeddings") for f in read(spark, sf, name).schema]
    return spark.createDataFrame(rows, "name string, is_int boolean, is_float boolean, is_num boolean, is_str boolean, is_date boolean, is_bool boolean, is_array boolean, is_primitive boolean")


@query("select * from (values ('series', true), ('no series', false), ('tree', true), ('deep tree', false), ('pattern', true), ('no pattern', false), ('json', true), ('no json', false), ('zone', true), ('no zone', false), ('path', true), ('no path', false), ('regex', true), ('flat', true)) t(test, holds)")
def value_kinds(spark, sf):
    events = read(spark, sf, "events")
    tree = T.MapType(T.StringType(), T.LongType())
    held = {
        "series": kinds.is_series(events.select("ts", "value")),
        "no series": kinds.is_series(events),
        "tree": kinds.is_tree(tree),
        "deep tree": kinds.is_tree(tree, 2),
        "pattern": nested.is_pattern("a/%b"),
        "no pattern": nested.is_pattern("a/b"),
        "json": kinds.is_jsonable({"a": [1, None]}),
        "no json": kinds.is_jsonable({1, 2}),
        "zone": kinds.is_zone("Europe/London"),
        "no zone": kinds.is_zone("Atlantis"),
        "path": files.is_path("x/y.csv"),
        "no path": files.is_path("x/y"),
        "regex": kinds.is_regex(re.compile("a")),
        "flat": kinds.primitive({"a": (1, datetime.date(2024, 1, 2)), "b": enum.Enum("E", {"X": 5}).X}) == {"a": [1, "2024-01-02"], "b": 5} and kinds.as_list(None) == [] and kinds.as_list("ab") == ["ab"] and kinds.as_tuple(range(2)) == (0, 1),
    }
    return spark.createDataFrame(list(held.items()), "test string, holds boolean")


@query("select p_partkey, p_size::double as p_size, p_retailprice from part")
def floats_of_ints(spark, sf):
    return kinds.floats(read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size")


@query("select c_custkey, case when c_custkey % 4 in (0, 1) then null else c_acctbal end as v from customer")
def clean_missing(spark, sf):
    k = F.col("c_custkey") % 4
    t = read(spark, sf, "customer").select("c_custkey", F.when(k == 0, float("nan")).when(k == 1, float("-inf")).otherwise(F.col("c_acctbal")).alias("v"))
    return missing.clean(t)


@query("select c_custkey, c_custkey % 3 <> 0 and c_custkey % 2 = 0 as even, c_custkey % 3 <> 0 as there from customer")
def plural_tests(spark, sf):
    k = F.col("c_custkey")
    cells = F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k, k + 2))
    return read(spark, sf, "customer").select("c_custkey", missing.all_of(cells, lambda x: x % 2 == 0).alias("even"), missing.all_of(cells, lambda x: x.isNotNull()).alias("there"))


# -- columns and rows --------------------------------------------------------------------
@query("select c_custkey, c_acctbal as have, 5 as lack from customer")
def get_or_default(spark, sf):
    t = read(spark, sf, "customer")
    return t.select("c_custkey", frame.get(t, "c_acctbal").alias("have"), frame.get(t, "nothing", 5).alias("lack"))


@query("select c_custkey, c_nationkey, c_acctbal, c_custkey as a from customer")
def without_columns(spark, sf):
    t = read(spark, sf, "customer").withColumn("s", F.struct(F.col("c_custkey").alias("a"), F.col("c_name").alias("b")))
    t = frame.minus(t, ("s", "b"))
    plain = frame.without(t, T.StringType)
    return frame.without(plain.select(*frame.matching(plain, "c_").columns, "s.a", F.lit(1.5).alias("x")), lambda f: f.name == "x")


@query("select c_custkey, case when c_custkey % 4 = 0 and c_custkey % 8 <> 0 then -c_acctbal else c_acctbal end as bal, c_name, case when c_custkey % 4 = 0 then 'x' end as tag from customer")
def either_side(spark, sf):
    t = read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), "c_name")
    other = t.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 != 0, -F.col("bal")).alias("bal"), F.lit("x").alias("tag"))
    return frame.either(t, other, "c_custkey")


@query("select c_custkey as customer_key, c_name as name_of_it, c_nationkey as nation from customer")
def headers_cleaned(spark, sf):
    t = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").toDF(" Customer Key ", 'Name "of" it', "Nation,")
    return frame.relabel(t, frame.header)


@query("select (select count(*) from customer) as n, (select count(*) from (describe customer)) as columns, (select n_name from nation where n_nationkey = 7) as one, null::varchar as none, 'BUILDING' as found, true as several")
def single_rows(spark, sf):
    nation, customer = read(spark, sf, "nation"), read(spark, sf, "customer")
    rows, columns = frame.shape(customer)
    one = frame.one_or_none(nation, n_nationkey=7, column="n_name")
    none = frame.one_or_none(nation, n_nationkey=[99], column="n_name")
    try:
        several = frame.find(customer, "c_mktsegment") is None
    except ValueError:
        several = True
    found = frame.find(customer, "c_mktsegment", lambda c_mktsegment: c_mktsegment.startswith("BUIL"))
    return spark.createDataFrame([(rows, columns, one, none, found, several)], "n long, columns long, one string, none string, found string, several boolean")


@query("select n_nationkey::bigint as n_nationkey, upper(n_name) as n_name from nation")
def table_records(spark, sf):
    rows = [(r["n_nationkey"], r["n_name"].upper()) for r in frame.records(read(spark, sf, "nation"))]
    return files.table(spark, rows, "n_nationkey long, n_name string")


@query("with w as (select greatest(max(length(r_regionkey::varchar)), length('r_regionkey')) as a, greatest(max(length(r_name)), length('r_name')) as b from region) select 0 as line, rpad('r_regionkey', a::int, ' ') || '|' || rpad('r_name', b::int, ' ') as shown from w union all select r_regionkey + 1, rpad(r_regionkey::varchar, a::int, ' ') || '|' || rpad(r_name, b::int, ' ') from region, w")
def table_text(spark, sf):
    lines = frame.to_text(read(spark, sf, "region").orderBy("r_regionkey")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, shown string")


@query("select c_custkey, c_mktsegment, c_acctbal * 2 as twice from customer")
def copied_columns(spark, sf):
    """Deleting, setting and reading columns by name on a frame that stays as it was."""
    t = read(spark, sf, "customer")
    changed = t.drop("c_name").withColumn("twice", t.c_acctbal * 2).drop("c_acctbal", "c_nationkey")
    return changed.select(*[c for c in changed.columns if c in [*t.columns, "twice"]])


@query("select o_custkey, first(o_orderkey order by o_orderdate, o_orderkey) as first, last(o_orderkey order by o_orderdate, o_orderkey) as last, max(length(o_orderstatus)) as width from orders group by o_custkey")
def first_last_unique(spark, sf):
    order = F.struct("o_orderdate", "o_orderkey")
    t = read(spark, sf, "orders").withColumn("width", F.length("o_orderstatus"))
    return t.groupBy("o_custkey").agg(frame.first("o_orderkey", order).alias("first"), frame.last("o_orderkey", order).alias("last"), frame.unique_value("width").cast("long").alias("width"))


@query("select p_partkey, p_name || '|' || p_brand as both, p_size + 1 as p_size from part")
def columns_done(spark, sf):
    t = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    t = frame.do(t, lambda c, p_brand: F.concat_ws("|", c, p_brand), "p_name")
    t = frame.do(t, lambda c: c + 1, "p_size")
    return t.select("p_partkey", F.col("p_name").alias("both"), "p_size")


@query("select l_orderkey, l_linenumber, round(l_quantity * (1 + l_tax), 6) as v, l_quantity + l_tax + l_discount as total, 0 as nothing from lineitem".replace("l_quantity + l_tax + l_discount", "round(l_quantity + l_tax + l_discount, 6)"))
def row_functions(spark, sf):
    priced = derive.row_function(lambda l_quantity, l_tax: (l_quantity * (1 + l_tax)).round(6), "double")
    t = frame.derive(read(spark, sf, "lineitem"), v=priced, total=F.round(derive.fold(lambda a, b: a + b, map(F.col, ("l_quantity", "l_tax", "l_discount"))), 6), nothing=derive.fold(lambda a, b: a + b, [], 0))
    return t.select("l_orderkey", "l_linenumber", "v", "total", "nothing")


@query("select c_custkey, case when c_custkey % 2 = 0 then upper(c_name) end as up, 'none' as fallback, 0.0::double as zero, c_acctbal as kept, 1 + c_custkey % 2 as some from customer")
def guarded_columns(spark, sf):
    t = read(spark, sf, "customer")
    lacking = lambda: derive.bind(lambda nothing: nothing, t.columns)
    up = derive.if_not_none(F.upper)(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    some = derive.expression(lambda c_custkey: c_custkey % 2, t.columns) + 1
    return t.select("c_custkey", up.alias("up"), derive.try_value(lacking, "none").alias("fallback"), derive.tried(lacking)["zero"].alias("zero"), derive.tried(lambda: F.col("c_acctbal"))["none"].alias("kept"), some.alias("some"))


@query("select l_orderkey, l_linenumber, round(l_quantity * 2 + 10 + 1, 6) as l_quantity, round(l_tax * 3 + 20 + 1, 6) as l_tax, round(greatest(l_quantity * 2 + 11, l_tax * 3 + 21), 6) as top from lineitem")
def looped_columns(spark, sf):
    t = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    values = ["l_quantity", "l_tax"]
    t = frame.loop(t, lambda c, times, plus, one: F.round(c * times + plus + one, 6), {"l_tax": 3, "l_quantity": 2}, [10, 20], 1, columns=values)
    return frame.loop(t, lambda cells: F.greatest(*cells), columns=values, axis=1, name="top")


# -- names and wrappers -------------------------------------------------------------------
@query("select * from (values ('join', 'a,b,c,d'), ('meet', 'b'), ('less', 'a,c'), ('back', 'd'), ('with', 'b'), ('type', 'a'), ('value', 'a,c')) t(op, names)")
def name_algebra(spark, sf):
    a, b = tooling.Names(["a", "b", "c", "a"]), tooling.Names(["b", "d"])
    made = {"join": a | b, "meet": a & b, "less": a - b, "back": ["b", "d"] - a, "with": a % "b", "type": tooling.Names(["a", 1]) / int, "value": a / "b"}
    return spark.createDataFrame([(k, ",".join(v)) for k, v in made.items()], "op string, names string")


class _Noted(tooling.Wrapper):
    """Adds its note to a text column."""

    def run(self, *args, **kwargs):
        return F.concat(self.function(*args, **kwargs), F.lit(self.options["note"]))


class _Doubled(tooling.Wrapper):
    def run(self, *args, **kwargs):
        return F.repeat(self.function(*args, **kwargs), 2)


@query("select c_custkey, repeat(lower(c_mktsegment), 2) || '?' as once, c_name || '-' || c_mktsegment as picked, c_mktsegment || '/' || c_nationkey as part, c_acctbal * 3 as given from customer")
def wrapped_functions(spark, sf):
    t = read(spark, sf, "customer")
    once = _Noted(_Doubled(_Noted(F.lower, note="!")), note="?")  # the outer note takes the inner one's place
    picked = tooling.Picked(lambda c_name, segment: F.concat_ws("-", c_name, segment), remap={"segment": "c_mktsegment"})
    part = tooling.Partial(lambda c_mktsegment, **more: F.concat_ws("/", c_mktsegment, *more.values()), kw=("c_nationkey",))
    given = tooling.partialize(lambda c_acctbal, times: c_acctbal * times, times=3, unknown=1)
    t = t.select("c_custkey", once("c_mktsegment").alias("once"), picked(t, t).alias("picked"), "c_mktsegment", "c_nationkey", "c_acctbal")
    t = frame.derive(t, part=part)
    return t.select("c_custkey", "once", "picked", "part", given(F.col("c_acctbal")).alias("given"))


@query("select (select count(*) from orders where o_orderstatus = 'F') as chained, (select count(*) from nation) as a, (select count(*) from region) as b, 7 as back, -1 as value, 2 as calls, true as timed, 'yes' as setting")
def tool_calls(spark, sf):
    calls = []

    def slow(x):
        calls.append(x)
        return len(calls)

    def fails(x):
        raise ValueError(x)

    cached = tooling.keyed_cache(slow)
    cached(1), cached(1), cached(2)
    chained = tooling.chain(read(spark, sf, "orders"), (frame.inc, lambda o_orderstatus: o_orderstatus == "F"), lambda df: df.count())
    a, b = tooling.gather(read(spark, sf, "nation").count, read(spark, sf, "region").count)
    took = tooling.timed(lambda: 1, 3)()[1] >= 0
    path = tooling.write_settings({"strandline.test.setting": "yes"}, os.path.join(tempfile.gettempdir(), f"strandline-{uuid.uuid4().hex}.json"))
    setting = tooling.read_settings(spark, path)["strandline.test.setting"]
    os.remove(path)
    tooling.logger().debug("tools called")
    return spark.createDataFrame([(chained, a, b, tooling.try_back(fails)(7), tooling.retry(fails, 1, value=-1)(7), len(calls), took, setting)], "chained long, a long, b long, back int, value int, calls int, timed boolean, setting string")


@query("select * from (values ('spec', 'a,b|c|b|args|kw'), ('attributes', 'days=2'), ('same', 'true'), ('ascending', 'true,false'), ('tree', 'a:\n    b: 1\nc: 2'), ('letters', '26')) t(what, value)")
def driver_helpers(spark, sf):
    spec = tooling.specification(lambda a, b=1, *args, c, **kw: None)
    day = datetime.timedelta(days=2)
    rows = {
        "spec": "|".join([",".join(spec["args"]), ",".join(spec["kwonly"]), ",".join(spec["defaults"]), spec["varargs"], spec["varkw"]]),
        "attributes": ",".join(f"{k}={v}" for k, v in tooling.attributes(day, "days").items()),
        "same": str(tooling.same_attributes(day, datetime.timedelta(days=2), ["days", "seconds"])).lower(),
        "ascending": f"{slices.is_ascending([None, 1, 2, 2])},{slices.is_ascending([3, 1, None])}".lower(),
        "tree": nested.tree_text({"a": {"b": 1}, "c": 2}),
        "letters": str(len(text.ALPHABET)),
    }
    return spark.createDataFrame(list(rows.items()), "what string, value string")


# -- series ---------------------------------------------------------------------------------
@query(f"select idx, round(pow(a.v, 2), 4) as p, a.v >= b.v as ge, a.v < b.v as lt, a.v <= b.v as le, round(abs(b.v - 500), 2) as size from {_day('purchase')} a join {_day('view')} b using (idx)")
def power_compare(spark, sf):
    a, b = _daily(spark, sf, "purchase"), _daily(spark, sf, "view")
    out = align.power(a, 2.0).select("idx", F.round("v", 4).alias("p"))
    for name, op in (("ge", align.ge), ("lt", align.lt), ("le", align.le)):
        out = out.join(op(a, b).withColumnRenamed("v", name), "idx")
    return out.join(align.absolute(align.sub(b, 500.0)).select("idx", F.round("v", 2).alias("size")), "idx")


@query(f"select idx, round(a.v - b.v * 2 + coalesce(c.v, 0.0), 2) as value from {_day('purchase', 2)} a full join {_day('view', 3)} b using (idx) full join {_day('click')} c using (idx)")
def any_function_aligned(spark, sf):
    spread = align.aligned(lambda a, more, times: F.round(a - more["b"] * times + F.coalesce(more["rest"][0], F.lit(0.0)), 2), join="outer")
    return spread(_daily(spark, sf, "purchase", every=2), {"b": _daily(spark, sf, "view", every=3), "rest": [_daily(spark, sf, "click")]}, times=2)


@query(f"with a as {_day('purchase', 2)}, b as (select idx, v, v + 1 as w from {_day('view', 3)}) select a.idx, round(a.v + x.v, 2) as v, round(a.v + x.w, 2) as w from a asof left join b x on a.idx >= x.idx")
def aligned_columns_ffill(spark, sf):
    b = _daily(spark, sf, "view", every=3).withColumn("w", F.col("v") + 1)
    total = align.aligned(lambda a, b: F.round(a + b, 2), join="left", method="ffill")
    return total(_daily(spark, sf, "purchase", every=2), b)


@query(f"select idx, v as sales from {_day('purchase')}")
def named_series(spark, sf):
    return align.as_series(_daily(spark, sf, "purchase").withColumn("w", F.lit(1)), "sales", column="v")


@query("with t as (select user_id, case when event_id % 5 = 0 then null else value end as v, case when event_id % 7 = 0 then value end as w from events) select user_id, max(v) as v, max(w) as w from t group by user_id")
def aggregate_valid(spark, sf):
    t = read(spark, sf, "events").select("user_id", "ts", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("v"), F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("w"))
    return align.aggregate(t, F.max, "ts", ["user_id"])


@query("select event_id, case when event_id % 5 = 0 then 0.0 else value end as v, case when event_id % 3 in (1, 2) then -1 else event_id % 3 end as w from events")
def masked_cells(spark, sf):
    t = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")).alias("v"), (F.col("event_id") % 3).alias("w"))
    return fill.mask_to_value(fill.mask_to_value(t, ["v"]), ["w"], [1, 2], -1)


@query("select event_id from events where epoch_us(ts) % 86400000000 > 34200500000 and epoch_us(ts) % 86400000000 <= 59400000000")
def cut_time_of_day(spark, sf):
    return slices.cut(read(spark, sf, "events"), "ts", datetime.time(9, 30, 0, 500_000), datetime.time(16, 30)).select("event_id")


_CUTS = "with d as (select date_trunc('day', ts)::timestamp as idx, count(*) as n from events group by 1) "


@query(_CUTS + "select idx, case when idx <= timestamp '2024-01-08' then n * 10 when idx <= timestamp '2024-01-16' then n * 10 + 1 else n * 10 + 2 end as \"0\", case when idx <= timestamp '2024-01-08' then n * 10 + 1 when idx <= timestamp '2024-01-16' then n * 10 + 2 end as \"1\" from d where idx <= timestamp '2024-01-25'")
def cut_upper_bounds(spark, sf):
    return slices.cut(_numbered(spark, sf), "idx", None, _stamps("2024-01-08", "2024-01-16", "2024-01-25"), depth=2)


@query(_CUTS + "select idx, case when idx < timestamp '2024-01-08' then n * 10 when idx < timestamp '2024-01-16' then n * 10 + 1 else n * 10 + 2 end as \"0\" from d where idx >= timestamp '2024-01-03'")
def cut_lower_bounds(spark, sf):
    """Descending bounds stand for reversed lists."""
    return slices.cut(_numbered(spark, sf)[::-1], "idx", _stamps("2024-01-16", "2024-01-08", "2024-01-03"), None, ends="[)")


def _stamps(*days):
    return [datetime.datetime.fromisoformat(d) for d in days]


def _numbered(spark, sf):
    t = read(spark, sf, "events").groupBy(dates.midnight(F.col("ts")).alias("idx")).agg(F.count("*").alias("n"))
    return [t.select("idx", (F.col("n") * 10 + k).alias("v")) for k in range(3)]


# -- text ---------------------------------------------------------------------------------------
@query("select p_partkey, lower(p_type) as low, 'part_' || p_size || '_' || lower(replace(p_type, ' ', '_')) as name, upper(p_brand) || ' Comdty' as ticker, printf('%.2f', p_retailprice) as price, list_transform(string_split(p_name, ' '), lambda w: lower(w)) as words from part")
def text_more(spark, sf):
    p = F.col("p_name")
    heading = F.concat(F.lit("  Part ("), F.col("p_size"), F.lit(")/"), F.col("p_type"), F.lit("? "))
    return read(spark, sf, "part").select("p_partkey", text.lower(F.col("p_type")).alias("low"), text.clean_name(heading).alias("name"), text.ticker_case(F.concat("p_brand", F.lit(" comdty"))).alias("ticker"), text.two_decimals(F.col("p_retailprice")).alias("price"), text.lower(F.split(p, " "), array=True).alias("words"))


@query("select c_custkey, substr(c_name, 10) as rest, substr(c_name, 10) as part from customer")
def text_without_prefix(spark, sf):
    t, name = read(spark, sf, "customer"), F.col("c_name")
    return t.select("c_custkey", text.without_prefix(name, F.lit("Customer#")).alias("rest"), text.without_prefix(name, F.lit("Customer#0"), "#").alias("part"))


# -- dates --------------------------------------------------------------------------------------
@query("select o_orderkey, month(o_orderdate)::int as by_name, month(o_orderdate)::int as by_letter, month(o_orderdate)::int as by_number, case when o_orderkey % 2 = 0 then o_orderdate else timestamp '2001-02-03' end as filled from orders")
def months_and_defaults(spark, sf):
    t = F.col("o_orderdate")
    letter = F.substring(F.lit(dates.FUTURES_MONTHS), F.month(t), F.lit(1))
    filled = dates.or_now(F.when(F.col("o_orderkey") % 2 == 0, t), F.lit("2001-02-03").cast("timestamp_ntz"))
    return read(spark, sf, "orders").select("o_orderkey", dates.month_number(F.date_format(t, "MMMM")).alias("by_name"), dates.month_number(letter).alias("by_letter"), dates.month_number(F.month(t)).alias("by_number"), filled.alias("filled"))


@query("select event_id, (ts at time zone 'UTC') at time zone 'America/New_York' as ny, (ts at time zone 'Europe/London') at time zone 'Asia/Tokyo' as tokyo, (ts at time zone 'Asia/Tokyo') at time zone 'UTC' as instant from events")
def zones(spark, sf):
    t = F.col("ts")
    ny = dates.convert_zone(t, tooling.zone("utc"), tooling.zone("new york"))
    tokyo = dates.convert_zone(t, tooling.zone("uk"), tooling.zone("JST"))
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), dates.set_zone(t, tooling.zone("Asia/Tokyo")).cast("timestamp_ntz"))
    return read(spark, sf, "events").select("event_id", ny.alias("ny"), tokyo.alias("tokyo"), instant.alias("instant"))


@query("select o_orderkey, case o_orderkey % 5 when 0 then 32400 when 1 then 34200 when 2 then 34215 when 3 then 34200 else 33315 end::int as s from orders")
def times_of_day(spark, sf):
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, "9").when(k == 1, "0930").when(k == 2, "93015").when(k == 3, "9:30").otherwise("09:15:15")
    return read(spark, sf, "orders").select("o_orderkey", dates.seconds_of_day(t).alias("s"))


@query("select * from (values ('1m', true, '-1m'), ('-2b', true, '+2b'), ('1y2m', true, '-1y-2m'), ('x', false, null), ('5', false, null)) t(bump, is_bump, opposite)")
def bump_kinds(spark, sf):
    rows = [(b, dates.is_bump(b), dates.negative(b) if dates.is_bump(b) else None) for b in ("1m", "-2b", "1y2m", "x", "5")]
    return spark.createDataFrame(rows, "bump string, is_bump boolean, opposite string")


@query("select event_id, round((ts::date - date '0001-01-01' + 1) + (epoch_us(ts) % 86400000000 // 1000000) / 86400.0, 8) as days, round((ts::date - date '1900-01-01') // 7 * 5 + case when isodow(ts) > 5 and month(ts + to_days((8 - isodow(ts))::int)) <> month(ts) then 4 else least(isodow(ts) - 1, 5) end + case when isodow(ts) > 5 then 0 else (epoch_us(ts) % 86400000000 // 1000000) / 86400.0 end, 8) as weekdays, null::double as none from events")
def intraday_clocks(spark, sf):
    t = F.col("ts")
    return read(spark, sf, "events").select("event_id", F.round(dates.clock(t, "f"), 8).alias("days"), F.round(dates.clock(t, "k"), 8).alias("weekdays"), dates.clock(t, None).alias("none"))


_SESSION_HOLIDAYS = ("2024-01-01", "2024-01-15", "2024-01-16")
_SESSION_DAYS = "with days as (select unnest(range(date '2023-12-01', date '2024-03-01', interval 1 day))::date as day), cal as (select day, isodow(day) < 6 and day not in (" + ", ".join(f"date '{h}'" for h in _SESSION_HOLIDAYS) + ") as b from days), nxt as (select day, b, min(case when b then day end) over (order by day rows between current row and unbounded following) as f, max(case when b then day end) over (order by day) as p from cal), e as (select event_id, ts, ts::date as day, epoch_us(ts) % 86400000000 // 1000000 as s from events) "


def _sessions(spark):
    return calendar(spark, "sessions", holidays=_SESSION_HOLIDAYS, first="2023-12-01", last="2024-02-29", day_start=8 * 3600, day_end=17 * 3600)


@query(_SESSION_DAYS + "select event_id, nxt.b and s between 28800 and 61200 as trading, n2.f::timestamp as follows, (case when s < 28800 and nxt.b then n3.p else nxt.p end)::timestamp as precedes from e join nxt using (day) join nxt n2 on n2.day = e.day + (s > 61200)::int join nxt n3 on n3.day = e.day - 1")
def calendar_sessions(spark, sf):
    c = _sessions(spark)
    t = c.trading(read(spark, sf, "events").select("event_id", "ts"), "ts")
    return c.trade_date(c.trade_date(t, "ts", "f", "follows"), "ts", "p", "precedes").select("event_id", "trading", "follows", "precedes")


@query(_SESSION_DAYS + "select event_id from e join cal using (day) where b and s between 28800 and 61200")
def calendar_filter(spark, sf):
    return _sessions(spark).filter(read(spark, sf, "events").select("event_id", "ts"), "ts").select("event_id")


@query(_SESSION_DAYS + ", c as (select day, f, sum(b::int) over (order by day) - b::int as clock from nxt), n as (select event_id, case when month(nxt.f) = month(e.day) then nxt.f else nxt.p end as at, nxt.f from e join nxt using (day)) select event_id, c2.day::timestamp as two, n.f::timestamp as ahead from n join c on c.day = n.at join c c2 on c2.clock = c.clock + 2 and c2.f = c2.day")
def calendar_bump(spark, sf):
    c = _sessions(spark)
    t = c.bump(read(spark, sf, "events").select("event_id", dates.midnight(F.col("ts")).alias("ts")), "ts", "2b", name="two")
    return c.bump(t, "ts", "+0b", name="ahead").select("event_id", "two", "ahead")


# -- curves ----------------------------------------------------------------------------------------
@query("select p_partkey, round(case when p_size < 5 then null when p_size > 40 then null when p_size <= 20 then 2 + (p_size - 5) * 4.0 / 15 else 6 + (p_size - 20) * 4.0 / 20 end, 8) as y, case when p_size < 5 or p_size > 40 then null when p_size < 20 then 2.0 when p_size < 40 then 6.0 else 10.0 end::double as before from part")
def interpolate_arrays(spark, sf):
    xs, ys = F.array(*map(F.lit, (5.0, 12.0, 20.0, 40.0))), F.array(F.lit(2.0), F.lit(None).cast("double"), F.lit(6.0), F.lit(10.0))
    t = read(spark, sf, "part").select("p_partkey", "p_size", xs.alias("xs"), ys.alias("ys"))
    t = tenor.interpolate_kind(t, "xs", "ys", "p_size", "before", "previous")
    return t.select("p_partkey", F.round(tenor.interpolate(F.col("xs"), F.col("ys"), F.col("p_size").cast("double")), 8).alias("y"), "before")


@query("select * from (values ('3m', 0.25), ('2y', 2.0), ('spot', 0.0), ('1q', 0.25), ('nothing', null), ('1.5', 1.5)) t(tenor, years)".replace("0.25", "0.25::double").replace("2.0", "2.0::double").replace("0.0)", "0.0::double)").replace("1.5)", "1.5::double)"))
def tenor_texts(spark, sf):
    t = spark.createDataFrame([(x,) for x in ("3m", "2y", "spot", "1q", "nothing", "1.5")], "tenor string")
    return t.select("tenor", tenor.tenor_years(F.col("tenor")).alias("years"))


# -- trees --------------------------------------------------------------------------------------------
@query("select event_id, (props->>'$.k')::bigint as k, -1::bigint as lack from events")
def tree_get(spark, sf):
    tree = F.parse_json("props")
    return read(spark, sf, "events").select("event_id", nested.get(tree, ["k"], "bigint").alias("k"), nested.get(tree, ["no", "such"], "bigint", -1).alias("lack"))


@query("select event_id, 'a' as k0, j.key as k1, j.value::varchar as leaf from events, json_each(props) j union all select event_id, 'b', null, event_type from events")
def tree_leaves(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit('{"a":'), "props", F.lit(',"b":"'), "event_type", F.lit('"}')).alias("tree"))
    return nested.leaves(e, "tree", 2)


_TYPES = "select event_type, user_id::varchar as u, max(value) as v from events where {} group by all"


def _by_type(spark, sf, condition):
    t = read(spark, sf, "events").where(condition).groupBy("event_type", F.col("user_id").cast("string").alias("u")).agg(F.max("value").alias("v"))
    return nested.from_table(t, "%event_type/%u/%v")


@query(f"with a as ({_TYPES.format('event_id % 2 = 0')}), b as ({_TYPES.format('event_id % 3 = 0')}) select event_type, u, coalesce(b.v, a.v) as v from a full join b using (event_type, u)")
def tree_updated(spark, sf):
    a, b = _by_type(spark, sf, "event_id % 2 = 0").withColumnRenamed("tree", "a"), _by_type(spark, sf, "event_id % 3 = 0").withColumnRenamed("tree", "b")
    both = a.join(b, F.lit(True)).select(nested.update(F.col("a"), F.col("b"), 2).alias("tree"))
    return both.select(F.explode("tree").alias("event_type", "m")).select("event_type", F.explode("m").alias("u", "v"))


@query(f"with a as ({_TYPES.format('true')}) select event_type, u, case when event_type = 'view' and u = 'new' then -1.0 else round(v * 2, 2) end as v from (select * from a union all select 'view', 'new', -0.5)")
def tree_set_and_mapped(spark, sf):
    t = _by_type(spark, sf, "true")
    tree = nested.set_item(F.col("tree"), ["view", "new"], F.lit(-0.5))
    tree = nested.map_at_depth(tree, lambda v: F.round(v * 2, 2), 2)
    return t.select(tree.alias("tree")).select(F.explode("tree").alias("event_type", "m")).select("event_type", F.explode("m").alias("u", "v"))


@query("select vec_id, list_transform(embedding, lambda x: (x * 2)::float) as twice, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 6) as square from embeddings")
def vectors_mapped(spark, sf):
    e = F.col("embedding")
    square = nested.vector_reduce(nested.vector_map(e, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf, "embeddings").select("vec_id", nested.vector_map(e, lambda x: (x * 2).cast("float")).alias("twice"), F.round(square, 6).alias("square"))


@query("select p_partkey, unnest([p_size, p_size + 1]) as a, p_brand as b from part")
def zipped_arrays(spark, sf):
    z = nested.zipped(F.array("p_size", F.col("p_size") + 1).alias("a"), F.array("p_brand").alias("b"))
    t = read(spark, sf, "part").select("p_partkey", F.explode(z).alias("z"))
    return t.select("p_partkey", F.col("z").getField("0").alias("a"), F.col("z").getField("1").alias("b"))


# -- sources ---------------------------------------------------------------------------------------------
@query("select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation")
def csv_roundtrip(spark, sf):
    path = f"{scratch(spark)}/nation.csv"
    files.write(read(spark, sf, "nation"), path)
    return files.read(spark, path)


@query("select * from customer")
def parquet_and_json(spark, sf):
    folder, t = scratch(spark), read(spark, sf, "customer")
    files.write(t, f"{folder}/a.parquet")
    files.write(files.read(spark, f"{folder}/a.parquet"), f"{folder}/b.json")
    back = files.read(spark, f"{folder}/b.json")
    return back.select(*[F.col(f.name).cast(f.dataType) for f in t.schema])


@query("select p_partkey - (select min(p_partkey) from part) as i, p_size::double as size, p_retailprice as price from part")
def npy_roundtrip(spark, sf):
    folder = scratch(spark)
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    files.write(read(spark, sf, "part"), f"{folder}/x.npy", order="p_partkey", columns=["p_size", "p_retailprice"])
    return files.read(spark, f"{folder}/x.npy", columns=["size", "price"])


@query("select 'r_regionkey=' || r_regionkey as part, true as has_bytes from region")
def folder_tree(spark, sf):
    folder = scratch(spark)
    files.write(read(spark, sf, "region"), f"{folder}/t.parquet", by=["r_regionkey"])
    t = files.tree(spark, f"{folder}/t.parquet", 1)
    return t.where(F.col("k1").endswith(".parquet")).select(F.col("k0").alias("part"), (F.col("bytes") > 0).alias("has_bytes"))


@query("select p_partkey::bigint as key, case when p_size % 4 = 0 then null else p_size::double end as size, timestamp '2024-01-02' as day from part where p_size % 4 <> 1")
def sheet_rules(spark, sf):
    size = F.when(F.col("p_size") % 4 == 0, "#N/A").otherwise(F.col("p_size").cast("string"))
    name = F.when(F.col("p_size") % 4 == 1, " ").otherwise(F.col("p_name"))
    t = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias(" Key"), size.alias("Size"), F.lit("2024-01-02").alias("Day"), name.alias("Name"), F.lit(None).cast("string").alias("Unnamed: 4"))
    out = files.clean_sheet(t, floats=["size"], ints=["key"], dates=["day"], required=["name"])
    return out.select(*[c for c in out.columns if c != "name"])


@query("select c_custkey, coalesce(case when c_custkey % 3 <> 0 then c_acctbal end, 0.0) as c_acctbal, upper(c_name) as c_name, 'x' as tag from customer")
def declared_records(spark, sf):
    t = read(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    shape = files.record("c_custkey bigint, c_acctbal double, c_name string, tag string", defaults={"c_acctbal": 0.0, "tag": "x"}, casts={"c_name": F.upper}, checks={"c_custkey": lambda c: c >= 0})
    return shape(t)


@query("select 3 as n, 'a' as x, 1 as k union all select 3, 'b', 2")
def small_tables(spark, sf):
    return files.table(spark, x=["a", "b"], k=[1, 2], n=3, schema="x string, k int, n int").select("n", "x", "k")


# -- streams ------------------------------------------------------------------------------------------------
@query("select event_type, count(*) as n, max(value) as top from events group by all")
def stream_merged(spark, sf):
    """A stream of the events, folded into a table by partitions of their type."""
    folder = scratch(spark)
    source = read(spark, sf, "events")
    source.select("event_type", "value").repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def combine(old, batch):
        new = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
        both = new if old is None else new.unionByName(old)
        return both.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    incremental.merge_stream(stream, f"{folder}/out", f"{folder}/log", combine, by="event_type").awaitTermination()
    return incremental.merged(spark, f"{folder}/out", "event_type").select("event_type", "n", "top")
