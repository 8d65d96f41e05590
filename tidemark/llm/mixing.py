"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. A document's expected number of
copies is target / source size; the documents of a source are laid end to end
by that number, one random offset per source is added, and a copy is emitted
for every integer boundary a document crosses. Documents lie in order of size,
so each size class is sampled at the same rate and the words taken come within
about one long document of the target.

Defined cases: null text has size 0; a null source is a source of its own (last
in order); a source without words has target 0 and nothing is taken; ties in
(size, id) are broken in any order, which changes no result; repeated rows are
separate documents; an empty table gives an empty result; other input columns
are ignored by ``mix_sources`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, carry, with_rank

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this many times its size.
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of all words, capped and reshared.

    Resharing the excess until no target is above its cap ends at one water
    level: sources in ascending order of cap / weight are capped while their
    cap is at most their share of what the capped ones before them leave.
    The rows here are one per source, whatever the number of documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", weight.alias("weight"),
                     (F.col("source_size") * max_copies).alias("cap"))
    # cap_i / weight_i in exact integers: both sides of the order multiplied by the product of the weights
    scale = 1
    for w in set(weights):
        scale *= int(w)
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") * scale / F.col("weight")).cast("double"),
                                                 F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.select(
        "source", "source_size", "weight", "cap",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
        F.row_number().over(order).alias("place"))
    capped = F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words")
    per = per.withColumn("capped", capped)
    first = F.min(F.when(~F.col("capped"), F.struct("place", "left_words", "left_weight"))).over(whole)
    per = per.withColumn("level", first)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("level.left_words")).cast("double") / F.col("level.left_weight").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def source_offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): 32 bits of an md5 of the seed and the name."""
    name = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))


def with_copies(sized: DataFrame, seed: int = 7, weights: Sequence[int] = WEIGHTS,
                max_copies: int = MAX_COPIES) -> DataFrame:
    """Add source_size, target and copies to rows of (doc_id, source, size)."""
    ranked = with_rank(sized, ["source"], ["size", "doc_id"], rank="place")
    targets = source_targets(ranked, weights, max_copies).select(
        F.col("source").alias("_source"), "source_size", "target")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    u = source_offset(F.col("source"), seed)
    copies = F.floor(u + F.col("place") * _rate()) - F.floor(u + (F.col("place") - 1) * _rate())
    return joined.withColumn("copies", copies.cast("long")).drop("place")


def mix_sources(docs: DataFrame, seed: int = 7, weights: Sequence[int] = WEIGHTS,
                max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = with_copies(sized, seed, weights, max_copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 7, weights: Sequence[int] = WEIGHTS,
              max_copies: int = MAX_COPIES) -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, each as often as the mix takes it.

    Copies are decided per (id, size, source) and joined back by those three
    columns: rows that agree in all of them take their summed copies in turn,
    so nothing is lost when ids repeat.
    """
    decided = mix_sources(docs, seed, weights, max_copies).groupBy(
        F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.col("size").alias("d_size")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    keyed = carry(docs, id=F.col("doc_id"), source=F.col("source"), size=word_count(F.col("text")))
    joined = keyed.join(decided.where("copies > 0"), F.col("id").eqNullSafe(F.col("d_id"))
                        & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("size") == F.col("d_size")))
    same = Window.partitionBy("id", "source", "size").orderBy(F.xxhash64("row.text"))
    turn = F.when(F.col("rows") == 1, F.lit(1)).otherwise(F.row_number().over(same))
    # rows that agree share the copies: the first ones take one more when they don't divide evenly
    mine = F.floor((F.col("copies") + F.col("rows") - turn) / F.col("rows")).cast("int")
    out = joined.select("row", mine.alias("mine")).where(F.col("mine") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("mine")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
lev AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS left_weight,
         row_number() OVER o AS place
  FROM per WINDOW o AS (ORDER BY (cap * 10)::DOUBLE / weight, source NULLS LAST)),
capd AS (SELECT *, cap * left_weight <= weight * left_words AS capped FROM lev),
level AS (SELECT left_words, left_weight FROM capd WHERE NOT capped ORDER BY place LIMIT 1),
tgt AS (
  SELECT c.source, c.source_size,
         CASE WHEN c.capped THEN c.cap::DOUBLE
              ELSE (c.weight * l.left_words)::DOUBLE / l.left_weight::DOUBLE END AS target
  FROM capd c LEFT JOIN level l ON true),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM sized),
rated AS (
  SELECT r.doc_id, r.size, r.place, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0e0 END AS rate,
         ('0x' || substr(md5('7:' || CASE WHEN r.source IS NULL THEN '-' ELSE '+' || r.source END), 1, 8))::BIGINT::DOUBLE
           / 4294967296e0 AS u
  FROM ranked r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(u + place * rate) - floor(u + (place - 1) * rate))::BIGINT * size)::BIGINT AS taken
FROM rated
"""
