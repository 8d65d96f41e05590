"""Bounded, repeatable samples of labelled documents for the classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: dict[int, int],
                    seed: int) -> DataFrame:
    """(doc_id, text, label): for each class at most ``per_class`` training documents, by a hash of the id.

    ``train`` is a condition on doc_id. An id with several labels takes the
    largest, an id with several texts the smallest; null labels and ids are no
    examples. The sample is the same for every layout of the tables and its size
    is bounded by ``per_class``, which is what allows the broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(train).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    known = known.join(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi")
    chosen = reduce(DataFrame.unionByName, [
        known.where(F.col("label") == c).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(n)
        for c, n in per_class.items()])
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialise(met.groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")))


def label_share(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> float:
    """The share of label 1 among all training labels, 0 if there are none."""
    known = labels.where(F.col(label).isNotNull() & train)
    return float(known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
