"""Incremental recomputation: cached results per row, resumed series, streams by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_all, null_safe
from ..plans.derive import bind


def per_row(function: Callable, inputs: dict, on, cached: DataFrame | None = None, expiry: DataFrame | None = None, today=None, column: str = "data", outputs: dict[str, str] | None = None, if_none: bool = False, inclusive: bool | None = None, renames=None, defaults=None, include_inputs: bool = False) -> DataFrame:
    """A function of named inputs for each joined row, unless a cached result still holds.

    A row is computed if it has no cached row, if it has not expired (no expiry, or one
    after ``today``; equal counts too if ``inclusive``, the default for one output), or,
    with ``if_none``, if its cached value is null.  Others keep the cached value.  The
    rows are split before the function, so that it never runs on rows that keep theirs.

    ``outputs`` names several outputs {name: type}; the function then gives a struct.
    """
    on = [on] if isinstance(on, str) else list(on)
    names = list(outputs) if outputs else [column]
    inclusive = (outputs is None) if inclusive is None else inclusive
    rows = join_all(inputs, on, renames, defaults)
    keys = [c for c in on if c in rows.columns]
    fresh = F.lit(cached is None)
    if cached is not None:
        shared = [c for c in keys if c in cached.columns]
        old = cached.select(*[F.col(c).alias(f"_k{c}") for c in shared], *[F.col(n).alias(f"_c{n}") for n in names], F.lit(True).alias("_known"))
        match = F.lit(True)
        for c in shared:
            match = match & F.col(c).eqNullSafe(F.col(f"_k{c}"))
        rows = rows.join(old, match, "left").drop(*[f"_k{c}" for c in shared])
        fresh = F.col("_known").isNull()
        if if_none:
            for n in names:
                fresh = fresh | F.col(f"_c{n}").isNull()
    if expiry is not None:
        shared = [c for c in keys if c in expiry.columns]
        ends = expiry.select(*[F.col(c).alias(f"_k{c}") for c in shared], F.col(next(c for c in expiry.columns if c not in shared)).alias("_expiry"))
        match = F.lit(True)
        for c in shared:
            match = match & F.col(c).eqNullSafe(F.col(f"_k{c}"))
        rows = rows.join(ends, match, "left").drop(*[f"_k{c}" for c in shared])
        day = F.current_date() if today is None else F.lit(today)
        live = F.col("_expiry").isNull() | ((F.col("_expiry") >= day) if inclusive else (F.col("_expiry") > day))
        fresh = fresh | live
    else:
        fresh = F.lit(True) if cached is None else fresh
    shown = [*keys, *[c for c in inputs if include_inputs]]

    def compute(df: DataFrame) -> DataFrame:
        value = bind(function, df.columns)
        if outputs is None:
            return df.select(*shown, value.alias(column))
        return df.withColumn("_v", value).select(*shown, *[F.col("_v").getField(n).cast(t).alias(n) for n, t in outputs.items()])

    if cached is None:
        return compute(rows)
    fresh = F.coalesce(fresh, F.lit(True))
    kept = rows.where(~fresh).select(*shown, *[F.col(f"_c{n}").alias(n) for n in names])
    return compute(rows.where(fresh)).unionByName(kept)


def resume(function: Callable[..., DataFrame], idx: str, data: DataFrame | None, *series: DataFrame, redo_last: bool = True, by=()) -> DataFrame:
    """Run a function of series only from where a previous result ends.

    The previous result's last index is computed again (unless ``redo_last`` is False).
    The bound per series is an aggregate; the filter on the inputs is a join on ``by``
    or, without keys, a pushed constant.
    """
    if data is None:
        return function(*series)
    by = list(by)
    if not by:
        end = data.agg(F.max(idx)).first()[0]
        if end is None:
            return function(*series)
        old = data.where(F.col(idx) < F.lit(end)) if redo_last else data
        new = [s.where(F.col(idx) >= F.lit(end) if redo_last else F.col(idx) > F.lit(end)) for s in series]
        return old.unionByName(function(*new), allowMissingColumns=True)
    ends = data.groupBy(*by).agg(F.max(idx).alias("_end"))

    def cut(df: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
        return null_safe(df, ends, by, "left").where(F.col("_end").isNull() | keep(F.col(idx), F.col("_end"))).drop("_end")

    old = cut(data, lambda t, e: t < e) if redo_last else data
    new = [cut(s, (lambda t, e: t >= e) if redo_last else (lambda t, e: t > e)) for s in series]
    return old.unionByName(function(*new), allowMissingColumns=True)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def merged(spark: SparkSession, path: str, by: str, before: int | None = None) -> DataFrame | None:
    """The table that merge_stream keeps by partition (of batches before a number); None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("version") < before)
    last = rows.groupBy(by).agg(F.max("version").alias("version"))  # reads partition names alone
    return rows.join(last, [by, "version"], "left_semi").drop("version")


def merge_stream(stream: DataFrame, path: str, checkpoint: str, combine: Callable[[DataFrame | None, DataFrame], DataFrame], trigger: dict | None = None, by: str | None = None):
    """Fold each micro-batch of a stream into a stored table by ``combine(old, batch)``.

    Every batch writes a version beside the old one, so a batch that is run again
    starts from the version before it; older ones are deleted.  With ``by`` a batch
    reads and writes only the partitions that its rows fall into, and the table is
    what ``merged`` reads: the last version of each partition.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if by is None:
            old = spark.read.parquet(f"{path}/version={number - 1}") if number else None
            combine(old, batch).write.mode("overwrite").parquet(f"{path}/version={number}")
            _delete(spark, f"{path}/version={number - 2}")
            return
        touched = batch.select(by).distinct()
        old = merged(spark, path, by, number)
        old = old.join(touched, by, "left_semi") if old is not None else None
        new = combine(old, batch).withColumn("version", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "version").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, idx: str, width: str, late: str, by=(), slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Tumbling or sliding aggregates of a stream (or a table); rows late by more than ``late`` go."""
    if stream.isStreaming:  # watermarks need stamps with a zone
        stream = stream.withColumn(idx, F.col(idx).cast("timestamp"))
    w = F.window(idx, width, slide) if slide else F.window(idx, width)
    made = stream.withWatermark(idx, late).groupBy(w, *by).agg(*[a.alias(k) for k, a in aggregates.items()])
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggregates)
