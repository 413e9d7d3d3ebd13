"""Tables from and to files, dispatched by suffix; directories; records with a schema."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import text_to_null
from ..functions.text import as_float
from ..operators.frame import header

#: Rows of an array that a task reads at a time.
ROWS = 1 << 16
#: Suffixes that Spark reads on its executors.
FORMATS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".csv": "csv"}


def suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def is_path(value) -> bool:
    """Whether a text names a file that ``read`` knows."""
    return isinstance(value, str) and suffix(value.split("!")[0]) in {*FORMATS, ".xlsx", ".xls", ".npy"}


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table from a path; the path's case is kept."""
    kind = suffix(path.split("!")[0])
    if kind == ".csv":
        return read_csv(spark, path, **options)
    if kind in (".xlsx", ".xls"):
        return read_excel(spark, path, **options)
    if kind == ".npy":
        return read_npy(spark, path, **options)
    if kind not in FORMATS:
        raise ValueError(f"no reader for {path}")
    return spark.read.options(**options).format(FORMATS[kind]).load(path)


def read_csv(spark: SparkSession, path, encoding: str = "UTF-8", **options) -> DataFrame:
    """Text columns from one or many files with a heading; short rows are padded with null."""
    paths = [path] if isinstance(path, str) else list(path)
    paths = [p if suffix(p) else p + ".csv" for p in paths]
    return spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", encoding=encoding, **options).csv(paths)


def write(df: DataFrame, path: str, mode: str = "overwrite", by=(), **options) -> None:
    """A table to a path by suffix, partitioned by columns."""
    kind = suffix(path)
    if kind in (".xlsx", ".xls"):
        write_excel(df, path, **options)
        return
    if kind == ".npy":
        write_npy(df, path, **options)
        return
    w = df.write.mode(mode).options(**options)
    if kind == ".csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).format(FORMATS[kind]).save(path)


def tables(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """The files below a folder with size and time, listed by Spark (any store)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return found.select("path", F.col("length").alias("bytes"), "modificationTime")


def tree(spark: SparkSession, folder: str, level: int = 1) -> DataFrame:
    """Files with the names of the folders above them as columns k0, k1, ... from ``folder`` on."""
    listed = tables(spark, folder)
    rest = F.split(F.substring_index("path", folder.rstrip("/") + "/", -1), "/")
    return listed.select(*[F.get(rest, F.lit(i)).alias(f"k{i}") for i in range(level + 1)], "path", "bytes")


def clean_sheet(df: DataFrame, floats: Iterable[str] = (), ints: Iterable[str] = (), dates: Iterable[str] = (), required: Iterable[str] = ()) -> DataFrame:
    """Sheet rules for text columns: headings cleaned, blanks to null, types by column.

    Unnamed columns without any value go, as do rows without a required value.
    """
    from ..functions.dates import parse

    df = df.toDF(*[header(c) for c in df.columns])
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: text_to_null(F.col(c)) for c in texts})
    unnamed = [c for c in df.columns if c.startswith("unnamed") or c.startswith("_c")]
    if unnamed:
        used = df.agg(*[F.count(c).alias(c) for c in unnamed]).first()
        df = df.drop(*[c for c in unnamed if not used[c]])
    made = {c: as_float(F.col(c).cast("string")) for c in floats}
    made |= {c: as_float(F.col(c).cast("string")).cast("bigint") for c in ints}
    made |= {c: parse(F.col(c).cast("string")) for c in dates}
    df = df.withColumns(made) if made else df
    return df.dropna(subset=list(required)) if list(required) else df


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, **rules) -> DataFrame:
    """A sheet ("file.xlsx!sheet"), read on the driver; needs pandas' reader for the format."""
    import pandas as pd

    path, _, named = path.partition("!")
    table = pd.read_excel(path, sheet_name=named or sheet, dtype=str)
    schema = ", ".join(f"`{c}` string" for c in map(str, table.columns))
    import pyarrow as pa

    cells = pa.table([pa.array([None if v is None or v != v else str(v) for v in table.iloc[:, k]], pa.string()) for k in range(table.shape[1])], list(map(str, table.columns)))
    return clean_sheet(spark.createDataFrame(cells, schema), **rules)


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", most_rows: int = 1_000_000) -> None:
    """A frame that a sheet can hold; more rows raise before anything is collected."""
    n = df.limit(most_rows + 1).count()
    if n > most_rows:
        raise ValueError("too many rows for a sheet")
    df.toPandas().to_excel(path, sheet_name=sheet, index=False)


def read_npy(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A one- or two-dimensional array as rows with their number in ``i``.

    Tasks map the file and read ROWS rows at a time, so it must lie where they all see it.
    """
    import numpy as np

    a = np.load(path, allow_pickle=False, mmap_mode="r")
    n, width = len(a), int(np.prod(a.shape[1:], dtype=int))
    names = columns or [f"c{k}" for k in range(width)]

    def run(batches):
        import pyarrow as pa

        mapped = np.load(path, allow_pickle=False, mmap_mode="r")
        for batch in batches:
            for first in batch.column(0).to_pylist():
                part = np.asarray(mapped[first : first + ROWS], float).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), *map(pa.array, np.ascontiguousarray(part.T))], ["i", *names])

    schema = ", ".join(["i long", *[f"`{k}` double" for k in names]])
    return spark.range(0, n, ROWS, max(1, min(256, -(-n // ROWS)))).mapInArrow(run, schema)


def write_npy(df: DataFrame, path: str, order, columns: list[str] | None = None, most_rows: int = 10_000_000) -> None:
    """Numeric columns in an order as an array in one file; more rows raise before anything is collected."""
    import numpy as np

    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError("too many rows for one array")
    table = df.orderBy(*([order] if isinstance(order, str) else order)).select(*(columns or df.columns)).toArrow()
    np.save(path, np.column_stack([c.to_numpy() for c in table.columns]), allow_pickle=False)


def table(spark: SparkSession, rows=None, schema: str | None = None, **columns) -> DataFrame:
    """A small table from records, a header and rows, or columns; constants are repeated."""
    if rows is not None:
        rows = list(rows)
        if schema is None and rows and isinstance(rows[0], list | tuple) and all(isinstance(v, str) for v in rows[0]):
            return spark.createDataFrame([tuple(r) for r in rows[1:]], list(rows[0]))
        return spark.createDataFrame(rows, schema)
    lists = {k: v if isinstance(v, list | range) else [v] for k, v in columns.items()}
    size = max(map(len, lists.values()), default=0)
    if any(len(v) not in (1, size) for v in lists.values()):
        raise ValueError("columns of unequal lengths")
    full = [list(v) * (size if len(v) == 1 else 1) for v in lists.values()]
    return spark.createDataFrame(list(zip(*full, strict=True)), schema or list(lists))


def record(schema: str, defaults: dict | None = None, casts: dict | None = None, checks: dict | None = None):
    """A declared record: a function from a frame to one with its columns, types and defaults.

    ``checks`` are functions of a Column that must hold for every row; a row that fails raises.
    """

    def shape(df: DataFrame) -> DataFrame:
        fields = T.StructType.fromDDL(schema)
        out = []
        for f in fields:
            c = F.col(f.name) if f.name in df.columns else F.lit((defaults or {}).get(f.name))
            if f.name not in df.columns and f.name not in (defaults or {}):
                raise KeyError(f.name)
            if f.name in (defaults or {}):
                c = F.coalesce(c, F.lit(defaults[f.name]))
            c = (casts or {}).get(f.name, lambda x: x)(c).cast(f.dataType)
            if f.name in (checks or {}):
                c = F.when(F.assert_true(F.coalesce(checks[f.name](c), F.lit(False)), F.lit(f"{f.name} fails its check")).isNull(), c)
            out.append(c.alias(f.name))
        return df.select(*out)

    return shape
