"""Perturbation-side queries: prompts in, model responses out, answers parsed.

The language model itself is outside the engine: these jobs build prompt
frames and parse response frames (fenced code, answer markers, budgets,
segments, nested answer lists).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import WS, py_strip, word_tokens
from tidemark.operators import perturb as P
from tidemark.plans.build import LANG, corpus, with_lang
from tidemark.plans.registry import register
from tidemark.plans.sql_fixtures import NL, sq, strip, with_ctes, words_sql
from tidemark.sources.code_corpus import code_variants, variant_texts
from tidemark.sources.tables import table


def _blocks_sql(text: str) -> str:
    g1 = f"regexp_extract_all({text}, {sq(P.FENCED)}, 1)"
    g2 = f"regexp_extract_all({text}, {sq(P.FENCED)}, 2)"
    choose = f"CASE WHEN coalesce(a, '') <> '' THEN a ELSE coalesce({g2}[i], '') END"
    return f"list_filter(list_transform({g1}, lambda a, i: {strip(choose)}), lambda x: x <> '')"


@register("extract_code", with_ctes(f"""
SELECT id, variant, array_to_string(blocks, {sq(P.BLOCK_SEP)}) AS blocks, coalesce(blocks[1], text) AS first_block
FROM (SELECT id, variant, text, {_blocks_sql('text')} AS blocks FROM code_variants WHERE variant IN ('fence', 'drop'))""",
    "code_variants"))
def extract_code(spark, sf):
    v = code_variants(corpus(spark, sf), ("fence", "drop"))
    blocks = P.fenced_blocks("text")
    return v.select("id", "variant", F.array_join(blocks, P.BLOCK_SEP).alias("blocks"),
                    F.coalesce(F.get(blocks, 0), F.col("text")).alias("first_block"))


MARKER = "### "


@register("response_after_marker", f"""
SELECT doc_id, CASE WHEN contains(text, {sq(MARKER)}) THEN {strip(f"split_part(text, {sq(MARKER)}, 2)")}
                    ELSE {strip('text')} END AS response
FROM documents""")
def response_after_marker(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.response_after_marker("text", MARKER).alias("response"))


@register("build_prompts", with_ctes(f"""
SELECT id, replace(replace({sq(P.TEMPLATES['rewrite'])}, '{{lang}}', {LANG}), '{{code}}', code) AS prompt
FROM code_corpus""", "code_corpus"))
def build_prompts(spark, sf):
    k = with_lang(corpus(spark, sf))
    return k.select("id", P.fill_template(P.TEMPLATES["rewrite"], lang="lang", code="code").alias("prompt"))


_PIVOT_SQL = " ".join(f"WHEN {sq(a)} THEN {sq(b)}" for a, b in P.PIVOT.items())


@register("build_pivot_prompts", with_ctes(f"""
SELECT id, pv AS "pivot", replace(replace(replace({sq(P.TEMPLATES['forward'])}, '{{lang}}', lang), '{{pivot}}', pv), '{{code}}', code)
  AS prompt
FROM (SELECT id, code, {LANG} AS lang, CASE {LANG} {_PIVOT_SQL} END AS pv FROM code_corpus)""", "code_corpus"))
def build_pivot_prompts(spark, sf):
    k = with_lang(corpus(spark, sf)).withColumn("pivot", P.pivot_of("lang"))
    return k.select("id", "pivot", P.fill_template(P.TEMPLATES["forward"], lang="lang", pivot="pivot", code="code").alias("prompt"))


def _after_marker_sql(e: str) -> str:
    m = sq(P.RESPONSE_MARKER)
    return f"(CASE WHEN contains({e}, {m}) THEN {strip(f'split_part({e}, {m}, 2)')} ELSE {strip(e)} END)"


@register("roundtrip_resolve", with_ctes(f"""
SELECT id, CASE WHEN len(b2) > 0 THEN b2[1] ELSE a1 END AS final, len(b2) = 0 AS fallback
FROM (SELECT id, a1, {_blocks_sql('a2')} AS b2
      FROM (SELECT f.id, {_after_marker_sql('f.text')} AS a1,
                   {_after_marker_sql(P.back_answer_sql('f.id', 'r.text'))} AS a2
            FROM code_variants f JOIN code_variants r ON r.id = f.id AND r.variant = 'rename'
            WHERE f.variant = 'fence'))""", "code_variants"))
def roundtrip_resolve(spark, sf):
    """Both answers are columns of the program's own row: no join."""
    k = variant_texts(corpus(spark, sf), ("fence", "rename"))
    both = k.select("id", F.element_at("texts", 2).alias("forward"), P.back_answer("id", F.element_at("texts", 3)).alias("back"))
    return P.roundtrip_resolve(both, "forward", "back").select("id", "final", "fallback")


@register("build_back_prompts", with_ctes(f"""
SELECT id, pv AS "pivot", replace(replace(replace({sq(P.TEMPLATES['back'])}, '{{lang}}', lang), '{{pivot}}', pv), '{{code}}', answer)
  AS prompt
FROM (SELECT c.id, {LANG} AS lang, CASE {LANG} {_PIVOT_SQL} END AS pv,
             CASE WHEN len({_blocks_sql('f.text')}) > 0 THEN {_blocks_sql('f.text')}[1] ELSE {_after_marker_sql('f.text')} END AS answer
      FROM code_corpus c JOIN code_variants f ON f.id = c.id AND f.variant = 'fence')""", "code_corpus", "code_variants"))
def build_back_prompts(spark, sf):
    """Second half of the round trip: the code found in the forward answer, to be translated back."""
    k = with_lang(variant_texts(corpus(spark, sf), ("fence",))).withColumn("pivot", P.pivot_of("lang"))
    k = k.withColumn("blocks", P.fenced_blocks(F.element_at("texts", 2)))
    answer = F.when(F.size("blocks") > 0, F.get("blocks", 0)).otherwise(P.response_after_marker(F.element_at("texts", 2), P.RESPONSE_MARKER))
    k = k.withColumn("answer", answer)
    return k.select("id", "pivot", P.fill_template(P.TEMPLATES["back"].replace("{code}", "{answer}"), lang="lang", pivot="pivot",
                                                   answer="answer").alias("prompt"))


@register("build_summary_prompts", with_ctes(f"""
SELECT id, replace(replace({sq(P.TEMPLATES['summary'])}, '{{lang}}', {LANG}), '{{code}}', code) AS prompt
FROM code_corpus""", "code_corpus"))
def build_summary_prompts(spark, sf):
    k = with_lang(corpus(spark, sf))
    return k.select("id", P.fill_template(P.TEMPLATES["summary"], lang="lang", code="code").alias("prompt"))


BUDGET = 512


@register("prompt_budget", f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) > {BUDGET} AS truncated,
       array_to_string(w[1:{BUDGET}], ' ') AS kept
FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""")
def prompt_budget(spark, sf, budget: int = BUDGET):
    """The first ``budget`` words of each text, and whether there were more."""
    d = table(spark, sf, "documents").select("doc_id", word_tokens("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n_words"), (F.size("w") > budget).alias("truncated"),
                    F.array_join(F.slice("w", 1, budget), " ").alias("kept"))


@register("segment_map", with_ctes(f"""
SELECT id, parts[1] || array_to_string(list_transform(docs, lambda d, i: d || upper(parts[i + 1])), '') AS text
FROM (SELECT id, regexp_split_to_array(code, {sq(P.DOCSTRING)}) AS parts, regexp_extract_all(code, {sq(P.DOCSTRING)}) AS docs
      FROM code_corpus WHERE {LANG} = 'Python')""", "code_corpus"))
def segment_map(spark, sf):
    k = with_lang(corpus(spark, sf)).where(F.col("lang") == "Python")
    return k.select("id", P.segment_map("code", F.upper).alias("text"))


@register("nested_generations", f"""
SELECT conv_id, turn,
       array_to_string(list_transform(string_split(text, {NL}),
         lambda line: '[' || array_to_string(list_filter(list_transform(string_split_regex(line, {sq(P.SENTENCE_END)}),
           lambda leaf: {strip('leaf')}), lambda x: x <> ''), ' | ') || ']'), ' ') AS texts
FROM conversations""")
def nested_generations(spark, sf):
    c = table(spark, sf, "conversations")
    nested = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, P.SENTENCE_END, -1))
    return c.select("conv_id", "turn", P.rebuild_nested(P.map_leaves(nested, py_strip)).alias("texts"))


_GENS_SQL = f"list_transform(string_split(text, {NL}), lambda l: string_split_regex(l, {sq(P.SENTENCE_END)}))"


@register("nested_generations_column", f"""
SELECT conv_id, turn, CAST(to_json(list_transform({_GENS_SQL}, lambda l: list_transform(l, lambda x: {strip('x')}))) AS VARCHAR)
  AS generations
FROM conversations""")
def nested_generations_column(spark, sf):
    """A list-of-lists column in (parsed from its JSON text), every leaf mapped, the same nesting out."""
    c = table(spark, sf, "conversations")
    stored = c.select("conv_id", "turn", F.to_json(F.transform(
        F.split("text", "\n", -1), lambda line: F.split(line, P.SENTENCE_END, -1))).alias("generations"))
    nested = F.from_json("generations", "array<array<string>>")
    return stored.select("conv_id", "turn", F.to_json(P.map_leaves(nested, py_strip)).alias("generations"))


@register("blob_list_map", f"""
SELECT doc_id, CAST(len(blobs) AS BIGINT) AS n_blobs,
       array_to_string(list_transform(blobs, lambda b: {strip(f"regexp_replace(b, '{WS}+', ' ', 'g')")}), {NL}) AS texts
FROM (SELECT doc_id, string_split(text, {NL}) AS blobs FROM documents)""")
def blob_list_map(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("blobs"))
    out = F.transform("blobs", lambda b: py_strip(F.regexp_replace(b, f"{WS}+", " ")))
    return d.select("doc_id", F.size("blobs").cast("bigint").alias("n_blobs"), F.array_join(out, "\n").alias("texts"))
