"""What the operators share: the shared folder, written tables, size-checked joins, row helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a broadcast may hold; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_fallback: list[str] = []
_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests) a folder of this machine."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if not _fallback:
        warnings.warn("spark.checkpoint.dir isn't set: intermediate tables go to a folder of this machine", stacklevel=2)
        _fallback.append("file://" + tempfile.mkdtemp(prefix="mapperlake-"))
    return _fallback[0]


def _sweep() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner clears it
            pass


atexit.register(_sweep)


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/mapperlake/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/mapperlake/" in f:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that have ended; without it they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on, and the next operator's needs come on top of what they keep."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tasks(df: DataFrame, size: int = 128 << 20) -> int:
    """Partitions for a shuffle of df: those that the session is set to, or more if they would hold over `size` bytes of the files that df reads."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-known // size) if known < 1 << 56 else 1)


def largest(df: DataFrame, count: str, key: str, limit: int) -> DataFrame:
    """About `limit` rows of staged df with the largest counts, if it has so many: those from a count on that a histogram of some thousand rows tells, so that no task orders all rows. Where more rows than fit have that count's size, a hash of `key` decides."""
    size = F.floor(F.log2(F.col(count).cast("double")) * 64)
    bins = sorted(((x["size"], x["n"]) for x in df.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left = limit
    for b, n in bins:
        if n > left:
            return df.where((size > b) | (size == b) & (F.pmod(F.xxhash64(key), F.lit(4096)) < left * 4096 // n - 64))
        left -= n
    return df


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows have at most `limit` bytes (measured, so stage it first), else as it is."""
    fixed, sizes = 16, []
    for f in df.schema:
        kind = f.dataType
        fixed += 8
        if isinstance(kind, T.ArrayType):
            width = 8 + 16 * isinstance(kind.elementType, T.StructType) + 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 0)
            sizes.append(16 + F.greatest(F.size(f.name), F.lit(0)) * width)
        elif isinstance(kind, T.StructType):
            fixed += 16 + 8 * len(kind.fields)
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
    n = df.select(F.sum(reduce(Column.__add__, sizes, F.lit(fixed)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= limit else df


def lean(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that whole texts pass through Python in bounded memory, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(batch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]
