"""From raw documents to packed sequences, one operator per stage.

toxicity -> exact dedup -> SimHash near-dedup -> mixing to target weights -> packing

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return rows with the columns of documents. run() writes each stage's rows to
Parquet in the shared checkpoint folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import dedup_fuse, mixing, packing, simhash, toxicity
from tidemark.llm.common import documents, labels
from tidemark.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    Null and empty texts score the toxic rate of labelled texts without words and stay
    below the threshold in a corpus that is mostly clean; equal texts are judged alike;
    repeated rows and null ids stay or go each on its own; without labels everything stays.
    """
    return toxicity.reject_toxic(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays.

    Null counts as the empty text; a null id counts as the smallest; of repeated rows one stays; an
    empty table gives none.
    """
    return dedup_fuse.apply_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the smallest id stays.

    Texts without a word share fingerprint zero, so one of them stays; null ids come last, ties go by the text's digest;
    of repeated rows one stays; an empty table gives none.
    """
    return simhash.keep_one(docs, shingle_words=3, max_bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words have size 0 and are copied at their source's rate; a null source is a source of its own, last in order;
    repeated rows are taken each; an empty table gives none.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4096 tokens; the columns of the packing query.

    A null or empty text is one closing id; null ids and repeated rows are packed each on their own; ties in
    length are broken in any order; an empty table gives none.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix),
          ("packing", pack)]

#: Nearest-example votes, components and column generation have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
