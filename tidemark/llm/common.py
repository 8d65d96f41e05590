"""Helpers shared by the operators: checkpoints, distributed ranks, fixed patterns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, fanout_partitions
from tidemark.sources.tables import table

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of characters that are not ASCII white space (all alphabets alike).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Bytes of one range partition when rows are ranked.
RANGE_BYTES = 128 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends there and lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def carry(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row`` beside the named expressions, so that no names can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[v.alias(k) for k, v in extra.items()])


def give_back() -> None:
    """Freed memory goes back to the system, Arrow's and (with glibc) numpy's and Python's.

    Workers outlive their tasks: what one keeps after a stage stands beside the next stages and the JVM.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that few texts are Python objects at a time.

    What the worker has freed is given back first (an earlier stage's model) and after each part.
    """
    give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
            give_back()


def in_tasks(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` in tasks. As a broadcast a worker loads it once and keeps no pickled bytes of it;
    under Spark Connect, which has no broadcasts, it is sent with the function."""
    try:
        sent = spark.sparkContext.broadcast(value)
    except Exception:  # noqa: BLE001 - Spark Connect
        return lambda: value
    return lambda: sent.value


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold_bucket(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def with_rank(df: DataFrame, group: list[str], order: list[str], rank: str = "rank_in_group",
              total: str | None = None, weight: str | None = None, prefix: str = "prefix_before") -> DataFrame:
    """Number the rows of each group from 1 in ``order`` without giving a group to one task.

    Rows are range-partitioned by (group, order) and checkpointed together with
    their partition number, so that the partition counts and the numbering read
    the same rows; each partition adds the sum of the partitions before it. A
    group of any size spreads over many partitions. Nulls form a group of their
    own. With ``weight`` the exclusive prefix sum of that column is added as
    ``prefix``; with ``total`` the group's row count. Rows that tie in ``order``
    are numbered in any order.
    """
    part = "_range_part"
    n = fanout_partitions(df, 1, RANGE_BYTES)
    df = materialise(df)  # range partitioning reads its input twice: once to choose the bounds
    laid = materialise(df.repartitionByRange(n, *[F.col(c) for c in group + order])
                       .withColumn(part, F.spark_partition_id()))
    sums = [F.count(F.lit(1)).alias("_rows")] + ([F.sum(weight).alias("_weight")] if weight else [])
    keys = [part, *group]
    counts = laid.groupBy(*keys).agg(*sums)
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if group else \
        Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in keys],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *([F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight_before")] if weight else []),
        *([F.sum("_rows").over(whole).alias(total)] if total else []),
    )
    own = Window.partitionBy(*keys).orderBy(*order)
    numbered = laid.withColumn("_row", F.row_number().over(own))
    if weight:
        numbered = numbered.withColumn(
            "_own", F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    cond = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys]
    joined = numbered.join(offsets, cond, "left")
    out = joined.withColumn(rank, F.col("_row") + F.col("_rows_before"))
    if weight:
        out = out.withColumn(prefix, F.col("_own") + F.col("_weight_before"))
    drop = [part, "_row", "_rows_before", "_own", "_weight_before", *[f"_o_{c}" for c in keys]]
    return out.drop(*drop)
