"""Bounded samples of labelled documents, and the folds that hold rows out of them.

A sample is drawn by a hash of the id at a rate of bound / count, so it has about ``bound`` rows at any
size of the tables and is the same on every run.  Only its ids (at most a few hundred KB) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def thinned(frame: DataFrame, key: Column, bound: int, seed: str) -> DataFrame:
    """About ``bound`` rows of ``frame``, chosen by a hash of ``key`` (all rows when there are no more)."""
    count = frame.count()
    if count <= bound:
        return frame
    limit = int(bound / count * (1 << 30))
    return frame.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < limit)


def labelled_ids(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """``(id, y)`` of the rows that may be learned from: 0/1 labels with an id outside the held-out fold.

    An id that has both labels counts as 1."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
    return usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(column).cast("double")).alias("y"))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, y, text)`` of the sampled documents; ``ids`` is bounded by its sample size."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "y", "text")
