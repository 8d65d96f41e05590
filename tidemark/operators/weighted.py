"""Keyword-weighted n-gram recall and CodeBLEU combination.

Weighted recall: for order 1 every reference token weighs 1.0 when it is a
keyword of the pair's language and 0.2 otherwise; higher orders are
unweighted. numerator = sum over reference grams of min(ref, hyp) * w,
denominator = max(1, sum ref * w); the BLEU shape (brevity penalty, method-1
smoothing, geometric mean) is then applied. Weights are carried as exact
integers (x5) so sums do not depend on order.

The keyword dimension is a fixed list of about 170 words: a proven-small side,
broadcast into the per-gram aggregation (no shuffle of grams) or sent to the
tasks that count a program's grams on their own (``inrow``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import bleu_formulas as BF
from tidemark.functions.keywords import KEYWORDS, LANG_CODE
from tidemark.operators import bleu as B
from tidemark.operators import inrow as P
from tidemark.session import fanout_partitions

# --- fixed values: keyword weight 1.0, other tokens 0.2, as integer fifths
W_KEYWORD = 5
W_OTHER = 1
W_SCALE = 5


LANG_IDS = {name: i for i, name in enumerate(LANG_CODE)}


def keyword_dim(spark: SparkSession) -> DataFrame:
    rows = [(LANG_IDS[lang], w) for lang, code in LANG_CODE.items() for w in KEYWORDS[code]]
    return spark.createDataFrame(rows, "kw_lang int, keyword string")


def read_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The keyword dimension from a folder of ``<code>.txt`` files, one keyword per line."""
    ids = F.create_map(*[x for name, code in LANG_CODE.items() for x in (F.lit(code), F.lit(LANG_IDS[name]))])
    code = F.regexp_extract(F.col("_metadata.file_name"), "^([A-Za-z_]+)[.]txt$", 1)
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder).select(ids[code].alias("kw_lang"), F.trim("value").alias("keyword"))
    return rows.where(F.col("kw_lang").isNotNull() & (F.col("keyword") != "")).distinct()


def _lang_id(lang: str) -> F.Column:
    out = None
    for name, i in LANG_IDS.items():
        out = F.when(F.col(lang) == name, i) if out is None else out.when(F.col(lang) == name, i)
    return out.otherwise(-1)


def weighted_stats(pairs: DataFrame, ids: Sequence[str], lang: str, hyp: str, ref: str,
                   keywords: DataFrame, max_n: int = 4, sep: str = " ", laid: bool = False) -> DataFrame:
    """Wide per-pair recall statistics ``ids, lang, num_k, den_k, hyp_len, ref_len``.

    The language rides along as a small integer: a string in an aggregation
    buffer would push Spark from hash to sort aggregation.
    """
    ids = list(ids)
    keys = [*ids, lang]  # a pair has one language: as a key it needs no join back
    p = pairs.select(*keys, _lang_id(lang).alias("lang_id"), F.col(hyp).alias("_hyp"), F.array(F.col(ref)).alias("_refs"))
    g = B.gram_rows(p, ids, "_hyp", "_refs", max_n, sep, carry=[lang, "lang_id"], laid=laid)
    per_gram = g.groupBy(*keys, "n", "gram").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("h"),
        F.count(F.when(F.col("side") == 1, 1)).alias("r"),
        F.max("lang_id").alias("lang_id"), F.max("hl").alias("hl"), F.max("rl").alias("rl"),
    )
    kw = F.broadcast(keywords.select("kw_lang", "keyword", F.lit(True).alias("is_kw")))
    j = per_gram.join(kw, (per_gram["lang_id"] == kw["kw_lang"]) & (per_gram["gram"] == kw["keyword"]) & (per_gram["n"] == 1),
                      "left")
    w5 = F.when(F.col("n") == 1, F.when(F.col("is_kw"), W_KEYWORD).otherwise(W_OTHER)).otherwise(W_SCALE)
    per_order = j.groupBy(*keys, "n").agg(
        F.sum(F.least("h", "r") * w5).alias("num5"), F.sum(F.col("r") * w5).alias("den5"),
        F.max("hl").alias("hyp_len"), F.max("rl").alias("ref_len"))
    aggs = []
    for k in range(1, max_n + 1):
        aggs.append(F.max(F.when(F.col("n") == k, F.col("num5") / float(W_SCALE))).alias(f"num_{k}"))
        aggs.append(F.max(F.when(F.col("n") == k, F.greatest(F.lit(1.0), F.col("den5") / float(W_SCALE)))).alias(f"den_{k}"))
    return per_order.groupBy(*keys).agg(*aggs, F.max("hyp_len").alias("hyp_len"), F.max("ref_len").alias("ref_len"))


def weighted_ngram(pairs: DataFrame, ids: Sequence[str], lang: str, hyp: str, ref: str, keywords: DataFrame,
                   laid: bool = False) -> DataFrame:
    """``ids, lang, score``: weighted recall BLEU (method 1), 6 places."""
    wide = weighted_stats(pairs, ids, lang, hyp, ref, keywords, laid=laid)
    return wide.select(*ids, lang, F.expr(BF.bleu(1)).alias("score"))


def keyword_sets(keywords: DataFrame) -> dict[int, frozenset]:
    """The keyword dimension by language number: about 170 words, read by the driver and sent to the tasks."""
    out: dict[int, set] = {}
    for r in keywords.select("kw_lang", "keyword").collect():
        out.setdefault(r["kw_lang"], set()).add(r["keyword"])
    return {k: frozenset(v) for k, v in out.items()}


def recall_columns(max_n: int = 4) -> list[Column]:
    """``num_k, den_k`` from the exact fifths ``num5_k, den5_k``."""
    out = []
    for k in range(1, max_n + 1):
        out += [(F.col(f"num5_{k}") / float(W_SCALE)).alias(f"num_{k}"),
                F.greatest(F.lit(1.0), F.col(f"den5_{k}") / float(W_SCALE)).alias(f"den_{k}")]
    return out


def member_ngram(rows: DataFrame, group: str, lang: str, texts: str, members: int, keywords: DataFrame,
                 max_n: int = 4) -> DataFrame:
    """``group, member, lang, score`` of members 1..``members`` as references against member 0, as ``weighted_ngram`` scores a pair.

    ``texts``: the texts of all members, member 0 first; rows are hash partitioned
    by ``group`` already. A group's words are numbered and its grams counted inside
    the task (``inrow``), once per text whatever the number of pairs.
    """
    known, weights = keyword_sets(keywords), (W_KEYWORD, W_OTHER, W_SCALE)
    laid = rows.where(F.col(group).isNotNull()).select(group, lang, texts).sortWithinPartitions(group, lang)
    out = T.StructType([laid.schema[group], T.StructField("member", T.IntegerType()), laid.schema[lang]] + [
        T.StructField(f"{x}_{k}", T.LongType()) for k in range(1, max_n + 1) for x in ("num5", "den5")] + [
        T.StructField(x, T.LongType()) for x in ("hyp_len", "ref_len")])

    def score(key, same):
        copies = [[None if t is None else P.words_of(t) for t in (r[2] or ())[:members + 1]] for r in same]
        per, lengths = P.recall_stats(copies, known.get(LANG_IDS.get(key[1], -1), frozenset()), max_n, " ", weights)
        for m, orders in enumerate(per, start=1):
            yield (key[0], m, key[1], *(x for o in orders for x in o), lengths[0], lengths[m])

    wide = laid.mapInArrow(P.in_groups(2, to_arrow_schema(out), score), out)
    return wide.select(group, "member", lang, *recall_columns(max_n), "hyp_len", "ref_len").select(
        group, "member", lang, F.expr(BF.bleu(1)).alias("score"))


def recall_counts(pairs: DataFrame, ids: Sequence[str], lang: str, hyp: str, refs: str, keywords: DataFrame,
                  max_n: int = 4, sep: str = " ", laid: bool = False) -> DataFrame:
    """Weighted recall counts against several references: ``ids, lang, n, num5, den5, hyp_len, ref_len``, in exact fifths.

    References add up: the numerator is the sum over references of their matched
    grams, the denominator the sum of their grams, each at least 1 (five fifths),
    so a reference shorter than the order counts 1. The grams of a pair are
    counted inside the task (``inrow``).
    """
    known, weights, ids = keyword_sets(keywords), (W_KEYWORD, W_OTHER, W_SCALE), list(ids)
    p = pairs.where(F.col(ids[0]).isNotNull())
    p = (p if laid else p.repartition(fanout_partitions(pairs, B.FANOUT), *ids)).select(
        *ids, lang, F.size(refs).alias("_n_refs"), F.col(hyp).alias("_hyp"), F.col(refs).alias("_refs"))
    keys = [*ids, lang, "_n_refs"]
    p = p.sortWithinPartitions(*keys)
    out = T.StructType([p.schema[c] for c in keys[:-1]] + [T.StructField("n", T.IntegerType())] + [
        T.StructField(x, T.LongType()) for x in ("num5", "den5", "hyp_len", "ref_len")])

    def count(key, same):
        if key[-1] is None or key[-1] < 0:  # no list of references
            return
        copies = [[r[-2], *(r[-1] or ())] for r in same]
        per, lengths = P.recall_stats(copies, known.get(LANG_IDS.get(key[-2], -1), frozenset()), max_n, sep, weights)
        closest = P.largest(P.closest_length(c[0], c[1:]) for c in copies)
        for n in range(max_n):
            yield (*key[:-1], n + 1, sum(m[n][0] for m in per), sum(max(W_SCALE, m[n][1]) for m in per), lengths[0], closest)

    return p.mapInArrow(P.in_groups(len(keys), to_arrow_schema(out), count), out)


def weighted_corpus(pairs: DataFrame, group_cols: Sequence[str], ids: Sequence[str], lang: str, hyp: str, refs: str,
                    keywords: DataFrame, max_n: int = 4, sep: str = " ", laid: bool = False) -> DataFrame:
    """``group_cols, n_pairs, hyp_len, ref_len, score``: recall counts and lengths summed over a group before dividing.

    ``group_cols`` may be any of ``ids`` and ``lang``; sums are exact integers. A null group is a group; pairs need a non-null first id.
    """
    counts = recall_counts(pairs, ids, lang, hyp, refs, keywords, max_n, sep, laid)
    sums = []
    for k in range(1, max_n + 1):
        sums.append((F.sum(F.when(F.col("n") == k, F.col("num5"))) / float(W_SCALE)).alias(f"num_{k}"))
        sums.append((F.sum(F.when(F.col("n") == k, F.col("den5"))) / float(W_SCALE)).alias(f"den_{k}"))
    first = F.col("n") == 1
    out = counts.groupBy(*group_cols).agg(
        *sums, F.count(F.when(first, 1)).alias("n_pairs"), F.sum(F.when(first, F.col("hyp_len"))).alias("hyp_len"),
        F.sum(F.when(first, F.col("ref_len"))).alias("ref_len"))
    return out.select(*group_cols, "n_pairs", "hyp_len", "ref_len", F.expr(BF.bleu(1)).alias("score"))


# --- fixed values: default CodeBLEU weights alpha, beta, gamma, theta
DEFAULT_PARAMS = "0.25,0.25,0.25,0.25"


def parse_params(params: str = DEFAULT_PARAMS) -> tuple[float, float, float, float]:
    a, b, g, t = (float(x) for x in params.split(","))
    return a, b, g, t


def combine_sql(params: str = DEFAULT_PARAMS) -> str:
    a, b, g, t = parse_params(params)
    return BF.r6(f"{a!r}e0 * bleu + {b!r}e0 * weighted + {g!r}e0 * syntax + {t!r}e0 * dataflow")
