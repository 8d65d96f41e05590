"""Exact dedup of a new batch against immutable snapshots behind static binary-fuse filters.

A snapshot is a table of distinct digests plus one binary-fuse filter per
shard of digests; neither changes once written. The rows of a new batch are
grouped by digest among themselves first, so a text with any number of copies
is screened once. A digest that the filter lets pass is joined with its exact
bucket (the full digest) and the bytes of both texts are compared; only then do
the two groups become one.

Texts are equal when identical after lower-casing A-Z. Defined cases: null text
is the empty text; a null id is never kept while its group has another id;
repeated rows count as copies and are kept or dropped together; an empty batch
or snapshot works; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fuse
from tidemark.llm.common import ASCII_UPPER, carry, materialise, slices

#: Distinct digests per filter shard, on average: what one task holds, at any input size.
SHARD_KEYS = 1 << 14
FILTER_SCHEMA = "shard long, seed int, seg int, starts int, cells binary"


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() folds A-Z only


def with_digest(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, text_sha256[, norm]) of every row: SHA-256 of the whole normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            norm = [_normal(t) for t in b.column(1).to_pylist()]
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())
            cols, names = [b.column(0), sha], ["doc_id", "text_sha256"]
            if keep_text:
                cols.append(pa.array(norm, pa.binary()))
                names.append("norm")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, text_sha256 string" + (", norm binary" if keep_text else "")
    return docs.select("doc_id", "text").mapInArrow(hashed, schema)


def digest64(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def classes(digested: DataFrame) -> DataFrame:
    """One row per distinct digest: keep_id (largest id) and copies. Partial counts precede the shuffle."""
    return digested.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


@dataclass(frozen=True)
class Snapshot:
    """Distinct digests with their classes, and one filter per shard; both checkpointed, never changed."""

    classes: DataFrame
    filters: DataFrame
    shards: int


def _shard(shards: int) -> Column:
    return F.pmod(digest64(F.col("text_sha256")), F.lit(shards).cast("long")).alias("shard")


def build_snapshot(digested: DataFrame, shards: int) -> Snapshot:
    own = materialise(classes(digested))
    keys = own.select(_shard(shards), digest64(F.col("text_sha256")).alias("d"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, starts, cells = fuse.build(pdf["d"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "seed": [seed], "seg": [seg], "starts": [starts], "cells": [cells]})

    filters = materialise(keys.groupBy("shard").applyInPandas(build, FILTER_SCHEMA))
    return Snapshot(own, filters, shards)


def screen(batch_classes: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The batch's digests that the snapshot's filters let pass (all true ones, 1/256 of the others)."""
    asked = batch_classes.select(_shard(snapshot.shards), "text_sha256",
                                 digest64(F.col("text_sha256")).alias("d"))

    def ask(filters: pd.DataFrame, digests: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(digests):
            return pd.DataFrame({"text_sha256": pd.Series([], dtype=object)})
        f = filters.iloc[0]
        hit = fuse.contains(digests["d"].to_numpy(np.int64), int(f.seed), int(f.seg), int(f.starts), f.cells)
        return digests.loc[hit, ["text_sha256"]]

    return (snapshot.filters.groupBy("shard").cogroup(asked.groupBy("shard"))
            .applyInPandas(ask, "text_sha256 string"))


def dedup_batch(batch: DataFrame, digested_batch: DataFrame, snapshot_docs: DataFrame,
                snapshot: Snapshot) -> DataFrame:
    """(text_sha256, in_snapshot, keep_id, group_size) for both sides: the class of each side's digest.

    ``in_snapshot`` tells the side. Digests found on both sides have one class
    when their bytes agree and two when they don't.
    """
    new = classes(digested_batch)
    positives = screen(new, snapshot)
    pairs = materialise(
        new.join(positives, "text_sha256", "left_semi").withColumnRenamed("keep_id", "new_id")
        .withColumnRenamed("copies", "new_copies")
        .join(snapshot.classes, "text_sha256"))
    # byte check: the two representatives' whole texts; copies are spread by (digest, id), one text a side remains
    sides = F.explode(F.array(F.col("new_id"), F.col("keep_id"))).alias("_id")
    wanted = pairs.select(F.col("text_sha256").alias("_sha"), sides)
    texts = with_digest(batch.select("doc_id", "text").unionByName(snapshot_docs.select("doc_id", "text")), True)
    met = texts.join(wanted, (F.col("text_sha256") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")),
                     "left_semi")
    same = met.groupBy("text_sha256").agg((F.min("norm") == F.max("norm")).alias("same"))
    agreed = pairs.join(same.where("same"), "text_sha256").select("text_sha256", "new_id", "new_copies")
    agreed = materialise(agreed)
    old_side = snapshot.classes.join(agreed, "text_sha256", "left").select(
        "text_sha256", F.greatest("keep_id", "new_id").alias("keep_id"),
        (F.col("copies") + F.coalesce("new_copies", F.lit(0))).alias("group_size"))
    new_side = new.join(agreed.select("text_sha256"), "text_sha256", "left_anti").select(
        "text_sha256", F.lit(False).alias("in_snapshot"), "keep_id", F.col("copies").alias("group_size"))
    shared = old_side.join(agreed.select("text_sha256"), "text_sha256", "left_semi").select(
        "text_sha256", F.lit(False).alias("in_snapshot"), "keep_id", "group_size")
    return (old_side.select("text_sha256", F.lit(True).alias("in_snapshot"), "keep_id", "group_size")
            .unionByName(new_side).unionByName(shared))


def dedup_table(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Dedup one table: half of its ids (by hash) form the snapshot, the others arrive as the new batch.

    Returns one row per document: doc_id, keep_id, group_size, kept, text_sha256.
    The digest table is small (id and digest) and is checkpointed once; texts
    cross the network once, for the byte check. Copies of one text are many
    rows with one digest: they are counted before the shuffle and fetch their
    class by a join that adaptive execution splits.
    """
    in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    docs = docs.select("doc_id", "text")
    digested = materialise(with_digest(docs).withColumn("in_snapshot", in_snapshot))
    shards = max(1, -(-digested.count() // shard_keys))
    old = digested.where("in_snapshot")
    new = digested.where(~F.col("in_snapshot"))
    snapshot = build_snapshot(old, shards)
    found = dedup_batch(docs.where(~in_snapshot), new, docs.where(in_snapshot), snapshot)
    out = digested.join(found, ["text_sha256", "in_snapshot"], "left")
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def apply_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated kept rows one stays."""
    keep = dedup_table(docs).where("kept").select(
        F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha")).distinct()
    sha = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower()), 256)
    tagged = carry(docs, id=F.col("doc_id"), sha=sha)
    met = tagged.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    # rows that agree in id and text: one stays; the grouping key holds no more than such repeats
    return met.dropDuplicates(["id", "sha"]).select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
