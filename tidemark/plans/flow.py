"""Token, data-flow and structure queries over the code corpus and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.bleu_formulas import r6
from tidemark.operators import dataflow as D
from tidemark.operators import inrow as P
from tidemark.plans.build import LANG, corpus, with_lang
from tidemark.plans.registry import register
from tidemark.plans.sql_blocks import REACHING, STRUCTURE
from tidemark.plans.sql_fixtures import with_ctes
from tidemark.plans.sql_flow import flow_ctes, structure_ctes
from tidemark.operators import structure as S
from tidemark.sources.block_programs import block_programs
from tidemark.sources.tables import table

# --- fixed values: the variants scored against the original, and their pair-id digit (the fenced
# variant is left out: the code extracted from it is the original itself)
SCORED_VARIANTS = {"rename": 1, "drop": 2, "comment": 3}


def programs(spark: SparkSession, sf: str) -> DataFrame:
    return with_lang(corpus(spark, sf)).select("id", F.col("code").alias("text"), "lang")


K_SRC = f"SELECT id, code AS text, {LANG} AS lang FROM code_corpus"
_VNO = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORED_VARIANTS.items())
V_SRC = (f"SELECT v.id * 10 + CASE v.variant {_VNO} END AS pair_id, v.id, v.variant, v.text, {LANG} AS lang "
         f"FROM code_variants v JOIN code_corpus c ON c.id = v.id WHERE v.variant IN "
         f"({', '.join(repr(x) for x in SCORED_VARIANTS)})")


@register("code_tokens", with_ctes("SELECT id, pos, line, token, kind FROM k_tok", "code_corpus",
                                   extra=flow_ctes("k", K_SRC, ["id"])))
def code_tokens(spark, sf):
    return D.token_table(programs(spark, sf), ["id"], "text", "lang").select("id", "pos", "line", "token", "kind")


def _nodes(spark, sf):
    return D.program_nodes(programs(spark, sf), ["id"], "text", "lang")


@register("def_use_edges", with_ctes("SELECT id, pos, var, rel, parent, parent_pos FROM k_edges", "code_corpus",
                                     extra=flow_ctes("k", K_SRC, ["id"])))
def def_use_edges(spark, sf):
    return D.edges(_nodes(spark, sf), ["id"])


@register("dataflow_normalize", with_ctes("SELECT id, pos, var, rel, parents FROM k_norm", "code_corpus",
                                          extra=flow_ctes("k", K_SRC, ["id"])))
def dataflow_normalize(spark, sf):
    return D.normalized(_nodes(spark, sf), ["id"])


def _item(prefix: str = "") -> str:
    return f"{prefix}var || '|' || {prefix}rel || '|' || {prefix}parents"


DATAFLOW_MATCH_SQL = with_ctes(f"""
SELECT p.pair_id, CAST(coalesce(m.matched, 0) AS BIGINT) AS matched, CAST(coalesce(m.total, 0) AS BIGINT) AS total,
       CASE WHEN coalesce(m.total, 0) = 0 THEN 0e0
            ELSE floor(CAST(m.matched AS DOUBLE) / m.total * 1e6 + 5e-1) / 1e6 END AS score
FROM (SELECT pair_id FROM ({V_SRC})) p
LEFT JOIN (
  SELECT r.pair_id, sum(least(r.rc, coalesce(c.cc, 0))) AS matched, sum(r.rc) AS total
  FROM (SELECT pair_id, {_item()} AS item, count(*) AS rc FROM v_norm GROUP BY 1, 2) r
  LEFT JOIN (SELECT k.id * 10 + d.x AS pair_id, {_item('k.')} AS item, count(*) AS cc
             FROM k_norm k, (SELECT unnest([{', '.join(str(v) for v in SCORED_VARIANTS.values())}]) AS x) d
             GROUP BY 1, 2) c ON c.pair_id = r.pair_id AND c.item = r.item
  GROUP BY r.pair_id) m ON m.pair_id = p.pair_id""", "code_corpus", "code_variants",
    extra={**flow_ctes("k", K_SRC, ["id"]), **flow_ctes("v", V_SRC, ["pair_id"])})


@register("dataflow_match", DATAFLOW_MATCH_SQL)
def dataflow_match(spark, sf):
    """Reference = variant, candidate = original."""
    from tidemark.plans.codebleu import flow_matches, laid_programs, pair_id

    out = flow_matches(laid_programs(spark, sf))
    score = F.expr(f"CASE WHEN total = 0 THEN 0e0 ELSE {r6('CAST(matched AS DOUBLE) / total')} END")
    return out.select(pair_id(), "matched", "total", score.alias("score"))


# ---------------------------------------------------------------- structure (E11 re-aimed)
PAGE_TOK_SQL = f"""
  SELECT page_id, CAST(k - 1 AS BIGINT) AS pos, nm[k] AS sym, CASE WHEN sl[k] = '/' THEN -1 ELSE 1 END AS delta
  FROM (SELECT page_id, regexp_extract_all(html, '{S.PAGE_TAG_RE}', 1) AS sl,
               regexp_extract_all(html, '{S.PAGE_TAG_RE}', 2) AS nm FROM pages), range(1, len(nm) + 1) r(k)"""


@register("subtree_signatures", with_ctes(
    "SELECT page_id, signature, count(*) AS cnt FROM pg_sig GROUP BY page_id, signature",
    extra=structure_ctes("pg", PAGE_TOK_SQL, ["page_id"])))
def subtree_signatures(spark, sf):
    sig = S.subtree_signatures(S.page_tokens(table(spark, sf, "pages")), ["page_id"])
    return sig.groupBy("page_id", "signature").agg(F.count(F.lit(1)).alias("cnt"))


@register("syntax_match", with_ctes("""
SELECT p.pair_id, CAST(coalesce(m.matched, 0) AS BIGINT) AS matched, CAST(coalesce(m.total, 0) AS BIGINT) AS total,
       CASE WHEN coalesce(m.total, 0) = 0 THEN 0e0
            ELSE floor(CAST(m.matched AS DOUBLE) / m.total * 1e6 + 5e-1) / 1e6 END AS score
FROM (SELECT a.page_id AS pair_id FROM pages a JOIN pages b ON b.page_id = a.page_id + 1) p
LEFT JOIN (
  SELECT r.pair_id, sum(CASE WHEN c.signature IS NOT NULL THEN r.cnt ELSE 0 END) AS matched, sum(r.cnt) AS total
  FROM (SELECT page_id - 1 AS pair_id, signature, count(*) AS cnt FROM pg_sig GROUP BY 1, 2) r
  LEFT JOIN (SELECT DISTINCT page_id AS pair_id, signature FROM pg_sig) c
    ON c.pair_id = r.pair_id AND c.signature = r.signature
  GROUP BY r.pair_id) m ON m.pair_id = p.pair_id""", extra=structure_ctes("pg", PAGE_TOK_SQL, ["page_id"])))
def syntax_match(spark, sf):
    """Each page (candidate) against the next page (reference)."""
    pages = table(spark, sf, "pages")
    sig = S.subtree_signatures(S.page_tokens(pages), ["page_id"])
    ref = sig.select((F.col("page_id") - 1).alias("pair_id"), "signature")
    cand = sig.select(F.col("page_id").alias("pair_id"), "signature")
    ids = pages.select("page_id")
    pairs = ids.join(ids.select((F.col("page_id") - 1).alias("page_id")), "page_id").select(F.col("page_id").alias("pair_id"))
    return S.syntax_match(ref, cand, pairs)


# ---------------------------------------------------------------- programs with blocks (E11 suites, E12 strings, E13 merging)
B_SRC = "SELECT id, text, lang FROM block_programs"
_B_FLOW = flow_ctes("b", B_SRC, ["id"])


@register("block_tokens", with_ctes("SELECT id, pos, line, token, kind FROM b_tok", "block_programs", extra=_B_FLOW))
def block_tokens(spark, sf):
    """Tokens of programs whose strings go over lines: one token each, lines counted by all line feeds."""
    return D.token_table(block_programs(spark, sf), ["id"], "text", "lang").select("id", "pos", "line", "token", "kind")


@register("reaching_definitions", with_ctes(
    f"SELECT id, CAST(use_line AS BIGINT) AS use_line, var, CAST(def_line AS BIGINT) AS def_line FROM ({REACHING})", "block_at"))
def reaching_definitions(spark, sf):
    """Every definition that reaches a use over branches and loops, by lines."""
    return P.reached_lines(block_programs(spark, sf), "id", "text", "lang")


@register("block_signatures", with_ctes(
    "SELECT id, signature, count(*) AS cnt FROM bs_sig GROUP BY id, signature", "block_programs",
    extra={**_B_FLOW, **structure_ctes("bs", STRUCTURE, ["id"])}))
def block_signatures(spark, sf):
    """Subtree signatures of programs with blocks; suites of Python programs are nodes."""
    return P.signature_counts(block_programs(spark, sf), "id", "text", "lang")
