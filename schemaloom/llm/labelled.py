"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 5, is 0; such rows never train a model. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, y): about `bound` labelled rows that aren't held out, at most, chosen by a hash of the id.

    Ids with a null id or label are left out; an id with several labels takes the largest.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))
