"""BLEU-family queries over ``documents`` (each document against itself with
every third line removed) and ``conversations`` (user turn -> next assistant turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bleu_formulas as BF
from tidemark.functions.text import drop_every_third, line_tokens, word_tokens
from tidemark.operators import bleu as B
from tidemark.plans.registry import register
from tidemark.plans.sql_fixtures import NL, with_ctes, words_sql
from tidemark.sources.tables import table


# ---------------------------------------------------------------- pair builders (Spark)
def docpairs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    lines = line_tokens("text")
    return d.select(
        F.col("doc_id").alias("pair_id"), "lang", "source",
        drop_every_third(lines).alias("hyp"), F.array(lines).alias("refs"),
    )


def conv_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turn -> the assistant turn right after it; word tokens; pair id = conv_id * 1e6 + user turn."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select(
        "conv_id", "turn", "role", "text",
        F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"),
        F.lead("text").over(w).alias("next_text"),
    )
    p = nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("next_turn") == F.col("turn") + 1))
    return p.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"),
        word_tokens("next_text").alias("hyp"), F.array(word_tokens("text")).alias("refs"),
    )


# ---------------------------------------------------------------- oracle SQL builders
DOCPAIR_SRC = """
  SELECT doc_id AS pair_id, lang, source,
         list_filter(string_split(text, chr(10)), lambda x, i: i % 3 <> 0) AS hyp,
         string_split(text, chr(10)) AS ref
  FROM documents"""


CONVPAIR_SRC = f"""
  SELECT conv_id * 1000000 + turn AS pair_id, {words_sql('next_text')} AS hyp, {words_sql('text')} AS ref
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
        FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1"""


def stats_ctes(src: str, max_n: int, sep: str = NL) -> dict[str, str]:
    """CTEs: ``src`` (pair_id, hyp, ref, ...), ``st_o`` (pair_id, n, num, den), ``st_w`` wide row per pair."""
    gram = "array_to_string({t}[i:i+n-1], " + sep + ")"
    wide = ", ".join(
        f"max(CASE WHEN n = {k} THEN num END) AS num_{k}, max(CASE WHEN n = {k} THEN den END) AS den_{k}"
        for k in range(1, max_n + 1)
    )
    return {
        "src": src,
        "st_g": f"""
  SELECT pair_id, 0 AS side, n, {gram.format(t='hyp')} AS gram
  FROM src, range(1, {max_n + 1}) r(n), range(1, len(hyp) - n + 2) s(i)
  UNION ALL
  SELECT pair_id, 1 AS side, n, {gram.format(t='ref')} AS gram
  FROM src, range(1, {max_n + 1}) r(n), range(1, len(ref) - n + 2) s(i)""",
        "st_c": """
  SELECT pair_id, n, gram, count(*) FILTER (WHERE side = 0) AS h, count(*) FILTER (WHERE side = 1) AS r
  FROM st_g GROUP BY pair_id, n, gram""",
        "st_o": f"""
  SELECT s.pair_id, g.n,
         CAST(coalesce(sum(least(c.h, c.r)), 0) AS BIGINT) AS num,
         CAST(greatest(1, coalesce(sum(c.h), 0)) AS BIGINT) AS den
  FROM src s CROSS JOIN range(1, {max_n + 1}) g(n)
  LEFT JOIN st_c c ON c.pair_id = s.pair_id AND c.n = g.n
  GROUP BY s.pair_id, g.n""",
        "st_w": f"""
  SELECT o.pair_id, {wide},
         CAST(any_value(len(s.hyp)) AS BIGINT) AS hyp_len, CAST(any_value(len(s.ref)) AS BIGINT) AS ref_len
  FROM st_o o JOIN src s ON s.pair_id = o.pair_id
  GROUP BY o.pair_id""",
    }


# ---------------------------------------------------------------- queries
NGRAM_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS toks FROM documents),
g AS (SELECT doc_id, n, array_to_string(toks[i:i+n-1], chr(10)) AS gram
      FROM t, range(1, 5) r(n), range(1, len(toks) - n + 2) s(i))
SELECT doc_id, CAST(n AS BIGINT) AS n, md5(gram) AS gram_md5, count(*) AS cnt FROM g GROUP BY doc_id, n, gram"""


@register("ngram_counts", NGRAM_SQL)
def ngram_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", line_tokens("text").alias("toks"))
    return B.ngram_counts(d, "doc_id", "toks", 4).withColumn("n", F.col("n").cast("bigint"))


@register("bleu_precision", with_ctes("SELECT pair_id, CAST(n AS BIGINT) AS n, num, den FROM st_o",
                                      extra=stats_ctes(DOCPAIR_SRC, 4)))
def bleu_precision(spark, sf):
    st = B.order_stats(docpairs(spark, sf), max_n=4)
    return st.select("pair_id", F.col("n").cast("bigint").alias("n"), "num", "den")


@register("bleu_brevity", f"""
WITH src AS ({DOCPAIR_SRC})
SELECT pair_id, CAST(len(hyp) AS BIGINT) AS hyp_len, CAST(len(ref) AS BIGINT) AS ref_len,
       {BF.r6(BF.brevity_penalty('len(hyp)', 'len(ref)'))} AS bp
FROM src""")
def bleu_brevity(spark, sf):
    return B.brevity(docpairs(spark, sf))


@register("bleu_sentence", with_ctes(f"SELECT pair_id, {BF.bleu(1)} AS bleu FROM st_w",
                                     extra=stats_ctes(DOCPAIR_SRC, 4)))
def bleu_sentence(spark, sf):
    return B.sentence_bleu(docpairs(spark, sf))


@register("bleu_sentence_conv", with_ctes(f"SELECT pair_id, {BF.bleu(1)} AS bleu FROM st_w",
                                          extra=stats_ctes(CONVPAIR_SRC, 4, "' '")))
def bleu_sentence_conv(spark, sf):
    return B.sentence_bleu(conv_pairs(spark, sf), sep=" ")


_CORPUS_SUMS = ", ".join(f"sum(num_{k}) AS num_{k}, sum(den_{k}) AS den_{k}" for k in range(1, 5))


@register("bleu_corpus", with_ctes(
    f"""SELECT lang, CAST(hyp_len AS BIGINT) AS hyp_len, CAST(ref_len AS BIGINT) AS ref_len, {BF.bleu(1)} AS bleu
FROM (SELECT s.lang, {_CORPUS_SUMS}, sum(w.hyp_len) AS hyp_len, sum(w.ref_len) AS ref_len
      FROM st_w w JOIN src s ON s.pair_id = w.pair_id GROUP BY s.lang)""",
    extra=stats_ctes(DOCPAIR_SRC, 4)))
def bleu_corpus(spark, sf):
    return B.corpus_bleu(docpairs(spark, sf), group_cols=["lang"])


@register("bleu_smoothing", with_ctes(
    "SELECT pair_id, method, bleu FROM ("
    + " UNION ALL ".join(f"SELECT pair_id, {m} AS method, {BF.bleu(m)} AS bleu FROM st_w" for m in range(8))
    + ")",
    extra=stats_ctes(DOCPAIR_SRC, 5)))
def bleu_smoothing(spark, sf):
    return B.smoothing_table(docpairs(spark, sf))


@register("bleu_reweigh", with_ctes(f"SELECT pair_id, {BF.bleu(1, auto_reweigh=True)} AS bleu FROM st_w",
                                    extra=stats_ctes(DOCPAIR_SRC, 4)))
def bleu_reweigh(spark, sf):
    return B.sentence_bleu(docpairs(spark, sf), auto_reweigh=True)
