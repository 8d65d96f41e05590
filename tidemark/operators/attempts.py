"""Attempts by rounds: every record is tried again until its text passes the gate, or the rounds are over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import kept


def attempt_rounds(records: DataFrame, attempt: Callable[[DataFrame, int], DataFrame],
                   passes: Callable[[DataFrame], DataFrame], rounds: int) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) frames of ``id, attempt_no, text``.

    ``attempt(open, k)`` gives ``id, text`` (at most one row per id) for the still open
    records in round k = 1..rounds; ``passes(tried)`` adds the boolean ``usable``
    to ``id, text``. A round joins only what is open, and its outcome is
    kept as compressed columns on the shared folder, so a lost executor repeats one
    round at most and a long run keeps a short lineage; of a resolved record only
    its id, number and text are kept. The loop ends early when nothing is open. Unresolved
    records hold their last attempt, or nulls if none was made. Records need unique, non-null ids.
    """
    open_ = kept(records.where(F.col("id").isNotNull()).withColumn("attempt_no", F.lit(None).cast("int")).withColumn(
        "last_text", F.lit(None).cast("string")), "attempts")
    done = []
    carried = [c for c in records.columns if c != "id"]
    for k in range(1, rounds + 1):
        if open_.isEmpty():
            break
        tried = passes(attempt(open_.drop("attempt_no", "last_text"), k)).select(
            "id", F.col("text").alias("new_text"), F.coalesce("usable", F.lit(False)).alias("usable"))
        met = open_.join(tried, "id", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
        met = met.withColumn("attempt_no", F.when(F.col("new_text").isNotNull(), F.lit(k)).otherwise(F.col("attempt_no"))).withColumn(
            "last_text", F.coalesce("new_text", "last_text")).drop("new_text")
        met = kept(met.withColumns({c: F.when(~F.col("usable"), F.col(f"`{c}`")) for c in carried}), "attempts")
        done.append(met.where("usable").select("id", "attempt_no", F.col("last_text").alias("text")))
        open_ = met.where("not usable").drop("usable")
    left = open_.select("id", "attempt_no", F.col("last_text").alias("text"))
    resolved = left.where(F.lit(False))
    for d in done:
        resolved = resolved.unionByName(d)
    return resolved, left
