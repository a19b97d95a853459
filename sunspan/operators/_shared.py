"""Tables in the folder that all executors share, for loops that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written below spark.checkpoint.dir (below the warehouse where it is unset) and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of a key in one task, sorted.

    By number: few bytes of polygons are much work, and would be put together. By a hash of the key: Spark leaves a
    shuffle by the key itself out where ``df`` has it from a join, and then reads that join's shuffle map by map if the
    join turns out to be a broadcast, which would part groups.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, F.xxhash64(key)).sortWithinPartitions(key, *order)


def by_group(df: DataFrame, key: str, order: list[str], fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``fn`` for each group: it gets a group's rows, as tuples in the order of ``df``'s columns, sorted by ``order``.

    One shuffle by key; groups are told apart while a sorted partition streams by, so that millions of small groups
    cost no call into pandas each.
    """
    names = df.columns
    at = names.index(key)
    out: StructType = df.sparkSession.createDataFrame([], schema).schema
    fields = to_arrow_schema(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[-1][at] != row[at]:
                    made += fn(group)
                    group = []
                    if len(made) > 10_000:
                        yield batch(made)
                        made = []
                group.append(row)
        if group:
            made += fn(group)
        yield batch(made)

    return _dealt(df, key, order).mapInArrow(run, out)


def by_groups(df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """As by_group(), for functions of many groups at once: ``fn`` gets a table of whole groups that follow each other."""
    out: StructType = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key)).to_pylist()
            if held and keys[0] != last:
                yield fn(pa.Table.from_batches(held))
                held = []
            last = keys[-1]
            if keys[0] != last:
                cut = keys.index(last)  # keys are sorted
                yield fn(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, b = [], b.slice(cut)
            held.append(b)
        if held:
            yield fn(pa.Table.from_batches(held))

    return _dealt(df, key, order).mapInArrow(run, out)
