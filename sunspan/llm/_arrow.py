"""Helpers for operators that run over Arrow batches in Python workers."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of input handled at once inside a batch.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of about ``limit`` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def release() -> None:
    """Gives a worker's free memory back: workers are kept for later tasks, and beside them run those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sweep(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of finished steps now: it does once the driver's JVM collects what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def add_columns(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: list[T.StructField],
    read: list[str],
    limit: int = SLICE_BYTES,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each batch; input columns of the same names are replaced.

    read: columns that ``fn`` needs (they must be unique in ``df``); drop: input columns left out of the result.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    inner = df.select([F.col(f"`{c}`") for c in dict.fromkeys([f.name for f in kept] + read)])
    keep_names, out_names = [f.name for f in kept], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit):
            made = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep_names] + [made[c] for c in out_names], names=keep_names + out_names
            )
            del batch, made
        release()

    return inner.mapInArrow(run, T.StructType(kept + fields))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    The setting is read from the session; where it is unset (local tests), a folder below the warehouse takes its
    place and becomes the checkpoint folder of the context.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing will read again: what was made from them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not re.search(r"-[0-9a-f]{32}$", path):
                raise ValueError(f"{path} is no table of stored()")
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
