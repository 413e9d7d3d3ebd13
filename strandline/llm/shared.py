"""Places and tables that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder that the cluster names.

    The setting is read from the session.  Where it is unset, a session on one
    machine (as in tests) gets a temporary folder; a cluster gets an error.
    """
    base = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if not base:
        if not (spark.sparkContext.master or "").startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT} must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set(CHECKPOINT, base)
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


#: Spark's switch for deleting an execution's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Hadoop's file system for ``file:`` without files of checksums beside the files; other stores keep theirs.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def fewer(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The same rows in eight parts a core, or a quarter of the session's parts if that is more.

    Writing a file to a local folder starts processes (``chmod``, several a file), and
    each of them shares its executor's memory until it runs.  Parts that make up one
    are worked on one after the other, so that a task holds no more than before.
    A table of ``narrow`` rows, numbers of nodes and the like, gets a quarter of that.
    """
    spark = df.sparkSession
    parts = max(8 * spark.sparkContext.defaultParallelism, dealt(spark) // 4)
    return df.coalesce(max(1, parts // 4) if narrow else parts)


def settle(df: DataFrame, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, in few files, and return the table read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.  The
    shuffle files of the write go when it has ended, as the table stands in for them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        fewer(df, narrow).write.options(**PLAIN).option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled = path
    return out


#: Rows in a batch that goes to a Python worker; ten thousand whole texts are too many at once.
BATCH_ROWS = 500


def _steady() -> None:
    """Let large arrays of this process go back to the system as soon as they are freed.

    Without it the C library keeps ever larger ones in its heap.  Those of a slice
    (half a megabyte) stay in it, as they come and go all the time.
    """
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        ctypes.CDLL(None).mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_steady()


def trim() -> None:
    """Give freed memory of this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function of batches that leaves its worker small when a task ends.

    Workers serve one task after the other, so what one task leaves in the heap
    counts against the executor during all that follow.
    """

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return out


def unused(columns, base: str) -> str:
    """A column name that none of ``columns`` has."""
    have = {c.lower() for c in columns}
    while base.lower() in have:
        base += "_"
    return base


def release(*tables: DataFrame) -> None:
    """Delete settled tables once all that was made from them is settled itself."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.settled)
        path.getFileSystem(conf).delete(path, True)


#: Narrow rows (64 bytes at most) that may be broadcast; more go by shuffle.
BROADCAST_ROWS = 250_000


def light(df: DataFrame) -> DataFrame:
    """A table of narrow rows, marked for broadcast if its counted size allows it."""
    out = settle(df, narrow=True)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def row_name(id_col, text_col) -> Column:
    """128 bits that name a row by its id and text, so that repeated ids stay apart."""
    return F.concat(F.hex(F.xxhash64(id_col, text_col)), F.hex(F.xxhash64(text_col, id_col)))


#: Rows of a key, as a share of all, from which the key is joined by broadcast: at most 1,024 keys.
SHARE = 1024


def onto(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Left join of ``one`` row a key onto rows of which a few keys, or null, may hold most."""
    total = rows.count()
    heavy = settle(rows.groupBy(key).agg(F.count("*").alias("rows_of")).where(F.col("rows_of") > total / SHARE).select(key), narrow=True)
    mark = unused([*rows.columns, *one.columns], "is_heavy")
    wide = rows.where(F.col(key).isNotNull()).join(F.broadcast(heavy.withColumn(mark, F.lit(True))), key, "left")
    hot = wide.where(mark).drop(mark).join(F.broadcast(one.join(F.broadcast(heavy), key, "left_semi")), key, "left")
    cold = wide.where(F.col(mark).isNull()).drop(mark).join(one, key, "left")
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(t).alias(c) for c, t in one.dtypes if c != key])
    return hot.unionByName(cold).unionByName(none)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts; batches to Python workers are kept small in its session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(id_col: str = "doc_id"):
    """crc32 of the id written as decimal text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0).cast("bigint"))


def dealt(spark: SparkSession, least: int = 1) -> int:
    """Number of parts for a hash exchange: what the session sets."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text for each bucket of a whole-bucket step: what such a task holds does not grow with the table.
BUCKET = 32 << 20


def cuts_of(docs: DataFrame, text_col: str) -> int:
    """Number of buckets for what is made from the texts of a table."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return dealt(docs.sparkSession, size // BUCKET)
