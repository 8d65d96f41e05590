"""n-gram statistics and BLEU as DataFrame jobs.

Plan shape (the reason for the design): a pair is one row holding the
hypothesis tokens and every reference's tokens. The pairs are hash
partitioned by their id ONCE (a shuffle of the raw token arrays only); the
n-grams are then exploded inside each task and every later aggregation
groups by keys that start with the pair id, so Spark satisfies them from the
existing partitioning: no n-gram ever crosses the network, partial and final
aggregation run in the same stage, and the per-pair result is a narrow
follow-up. Corpus totals then aggregate one small row per pair.

Every pair yields a full grid of orders 1..N (a sentinel row per order), so
pairs shorter than n still contribute ``num = 0, den = 1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bleu_formulas as BF
from tidemark.functions.text import ngram_arrays
from tidemark.session import fanout_partitions

FANOUT = 64  # bytes of grams (four orders, two sides, a map entry each) per byte of compressed text

_GROUP = "struct<side:int,ref:int,n:int,grams:array<string>,hl:bigint,rl:bigint>"


def closest_ref_length(refs: Column, hyp_len: Column) -> Column:
    """Reference length closest to the hypothesis length, ties to the shorter."""
    return F.array_min(
        F.transform(refs, lambda r: F.struct(F.abs(F.size(r) - hyp_len).alias("d"), F.size(r).alias("len")))
    )["len"]


def _group(side: int, ref_no, n: int, grams: Column, hl=None, rl=None) -> Column:
    return F.struct(
        F.lit(side).alias("side"), (ref_no if isinstance(ref_no, Column) else F.lit(ref_no)).cast("int").alias("ref"),
        F.lit(n).alias("n"), grams.alias("grams"),
        (hl if hl is not None else F.lit(None)).cast("bigint").alias("hl"),
        (rl if rl is not None else F.lit(None)).cast("bigint").alias("rl"),
    )


def gram_rows(pairs: DataFrame, ids: Sequence[str], hyp: str, refs: str, max_n: int, sep: str,
              carry: Sequence[str] = (), laid: bool = False) -> DataFrame:
    """One row per (pair, side, reference, order, gram occurrence) plus one sentinel per order.

    Two explodes: first one row per (side, reference, order) holding that
    order's gram array, then the grams themselves, so no struct is built per gram.
    ``carry`` columns ride along as values (not keys). ``laid`` tells that the
    pairs are hash partitioned by some of ``ids`` already, so nothing is shuffled.
    The first of ``ids`` names the pair: rows without it are no pairs and give
    nothing; the other keys (languages, groups) may be null and keep their rows.
    """
    h = F.col(hyp)
    r = F.col(refs)
    hl = F.size(h)
    rl = closest_ref_length(r, F.size(h))
    hyp_groups = [_group(0, 0, n, g) for n, g in enumerate(ngram_arrays(h, max_n, sep), start=1)]
    ref_groups = F.flatten(F.transform(r, lambda t, j: F.array(
        *[_group(1, j, n, g) for n, g in enumerate(ngram_arrays(t, max_n, sep), start=1)])))
    sentinels = [_group(2, 0, n, F.array(F.lit(None).cast("string")), hl, rl) for n in range(1, max_n + 1)]
    groups = F.concat(F.array(*hyp_groups).cast(f"array<{_GROUP}>"), ref_groups.cast(f"array<{_GROUP}>"),
                      F.array(*sentinels).cast(f"array<{_GROUP}>"))
    keep = list(ids) + list(carry)
    rows = pairs.where(F.col(ids[0]).isNotNull())
    rows = rows if laid else rows.repartition(fanout_partitions(pairs, FANOUT), *ids)
    return (
        rows.select(*keep, F.explode(groups).alias("g"))
        .select(*keep, "g.side", "g.ref", "g.n", "g.hl", "g.rl", F.explode("g.grams").alias("gram"))
    )


def order_stats(
    pairs: DataFrame,
    ids: Sequence[str] = ("pair_id",),
    hyp: str = "hyp",
    refs: str = "refs",
    max_n: int = 4,
    sep: str = "\n",
    laid: bool = False,
) -> DataFrame:
    """Modified precision per pair and order: ``ids, n, num, den, hyp_len, ref_len``.

    num = sum over hypothesis grams of min(count, max count in any reference);
    den = max(1, number of hypothesis grams).
    """
    ids = list(ids)
    g = gram_rows(pairs, ids, hyp, refs, max_n, sep, laid=laid)
    per_side = g.groupBy(*ids, "n", "gram", "side", "ref").agg(
        F.count(F.lit(1)).alias("c"), F.max("hl").alias("hl"), F.max("rl").alias("rl")
    )
    per_gram = per_side.groupBy(*ids, "n", "gram").agg(
        F.sum(F.when(F.col("side") == 0, F.col("c"))).alias("h"),
        F.max(F.when(F.col("side") == 1, F.col("c"))).alias("r"),
        F.max("hl").alias("hl"),
        F.max("rl").alias("rl"),
    )
    h = F.coalesce(F.col("h"), F.lit(0))
    return per_gram.groupBy(*ids, "n").agg(
        F.sum(F.least(h, F.coalesce(F.col("r"), F.lit(0)))).cast("bigint").alias("num"),
        F.greatest(F.lit(1), F.sum(h)).cast("bigint").alias("den"),
        F.max("hl").alias("hyp_len"),
        F.max("rl").alias("ref_len"),
    )


def wide_stats(stats: DataFrame, ids: Sequence[str], max_n: int) -> DataFrame:
    """One row per pair: ``num_k``/``den_k`` for k = 1..max_n, plus lengths."""
    ids = list(ids)
    aggs = []
    for k in range(1, max_n + 1):
        aggs.append(F.max(F.when(F.col("n") == k, F.col("num"))).alias(f"num_{k}"))
        aggs.append(F.max(F.when(F.col("n") == k, F.col("den"))).alias(f"den_{k}"))
    return stats.groupBy(*ids).agg(*aggs, F.max("hyp_len").alias("hyp_len"), F.max("ref_len").alias("ref_len"))


def sentence_bleu(
    pairs: DataFrame,
    ids: Sequence[str] = ("pair_id",),
    hyp: str = "hyp",
    refs: str = "refs",
    method: int = 1,
    weights: tuple[float, ...] = BF.DEFAULT_WEIGHTS,
    auto_reweigh: bool = False,
    sep: str = "\n",
    laid: bool = False,
) -> DataFrame:
    """BLEU of each pair: ``ids, bleu`` (rounded to 6 places)."""
    n = BF.orders_needed(method, weights)
    wide = wide_stats(order_stats(pairs, ids, hyp, refs, n, sep, laid), ids, n)
    return wide.select(*ids, F.expr(BF.bleu(method, weights, auto_reweigh)).alias("bleu"))


def corpus_bleu(
    pairs: DataFrame,
    group_cols: Sequence[str] = (),
    ids: Sequence[str] = ("pair_id",),
    hyp: str = "hyp",
    refs: str = "refs",
    method: int = 1,
    weights: tuple[float, ...] = BF.DEFAULT_WEIGHTS,
    sep: str = "\n",
) -> DataFrame:
    """Corpus BLEU: numerators, denominators and lengths summed per group before dividing.

    ``group_cols`` must be columns of ``pairs``; they ride along with the pair id.
    """
    n = BF.orders_needed(method, weights)
    keys = list(ids) + list(group_cols)
    wide = wide_stats(order_stats(pairs, keys, hyp, refs, n, sep), keys, n)
    sums = [F.sum(f"num_{k}").alias(f"num_{k}") for k in range(1, n + 1)]
    sums += [F.sum(f"den_{k}").alias(f"den_{k}") for k in range(1, n + 1)]
    agg = wide.groupBy(*group_cols).agg(*sums, F.sum("hyp_len").alias("hyp_len"), F.sum("ref_len").alias("ref_len"))
    return agg.select(*group_cols, "hyp_len", "ref_len", F.expr(BF.bleu(method, weights)).alias("bleu"))


def smoothing_table(pairs: DataFrame, ids: Sequence[str] = ("pair_id",), hyp: str = "hyp", refs: str = "refs",
                    sep: str = "\n") -> DataFrame:
    """All eight smoothing methods from one pass over the n-grams: ``ids, method, bleu``."""
    wide = wide_stats(order_stats(pairs, ids, hyp, refs, 5, sep), ids, 5)
    per_method = F.array(
        *[F.struct(F.lit(m).alias("method"), F.expr(BF.bleu(m)).alias("bleu")) for m in range(8)]
    )
    return wide.select(*ids, F.explode(per_method).alias("s")).select(*ids, "s.method", "s.bleu")


def brevity(pairs: DataFrame, ids: Sequence[str] = ("pair_id",), hyp: str = "hyp", refs: str = "refs") -> DataFrame:
    """Lengths and brevity penalty per pair; a narrow projection, no n-grams."""
    hl = F.size(F.col(hyp)).cast("bigint")
    rl = closest_ref_length(F.col(refs), F.size(F.col(hyp))).cast("bigint")
    return pairs.select(*ids, hl.alias("hyp_len"), rl.alias("ref_len")).select(
        *ids, "hyp_len", "ref_len", F.expr(BF.r6(BF.brevity_penalty())).alias("bp")
    )


def ngram_counts(docs: DataFrame, id_col: str, tokens: str, max_n: int = 4, sep: str = "\n") -> DataFrame:
    """Multiset of n-grams per document: ``id, n, gram_md5, cnt``; grouped within the doc's partition.

    Partitions are sized by the grams, which come to many times the texts that cross the network.
    """
    groups = F.array(*[F.struct(F.lit(n).alias("n"), g.alias("grams"))
                       for n, g in enumerate(ngram_arrays(F.col(tokens), max_n, sep), start=1)])
    exploded = (docs.repartition(fanout_partitions(docs, FANOUT), id_col).select(id_col, F.explode(groups).alias("g"))
                .select(id_col, "g.n", F.explode("g.grams").alias("gram")))
    return exploded.groupBy(id_col, "n", "gram").agg(F.count(F.lit(1)).alias("cnt")).select(
        id_col, "n", F.md5("gram").alias("gram_md5"), "cnt"
    )
