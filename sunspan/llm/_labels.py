"""Bounded samples of labelled documents, for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether the remainder of crc32 of the id as text is ``rest``; a null id counts as the text null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus == rest


def training_rows(docs: DataFrame, labels: DataFrame, label: str, test: tuple[int, int], most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and y (0 or 1) of at most ``most`` labelled rows outside the held-out part, half of either label at most.

    The rows of least digest of their id are taken, so that the sample does not depend on partitions. Labels other
    than 0 and 1 and null ids are left out; an id with several labels counts with the greatest. The sample of ids,
    whose size is bounded by ``most``, is broadcast, so documents are not moved.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col), *test))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "_id").withColumnRenamed("_id", "id")
