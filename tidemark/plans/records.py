"""Record-level queries: alignment, id sets, resume/skip, slices, samples, pages, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.bleu_formulas import bleu as bleu_sql
from tidemark.functions.text import py_strip
from tidemark.operators import bleu as B
from tidemark.operators import corpus as K
from tidemark.operators import pages as PG
from tidemark.operators.attempts import attempt_rounds
from tidemark.operators.perturb import first_block
from tidemark.operators.report import score_histogram as histogram
from tidemark.operators.report import score_report as report
from tidemark.operators.report import micro_units_sql, tenth_bucket_sql
from tidemark.plans.build import _VERDICT_CTES, LANG, _gate_sql, _lint_sql, corpus, with_gate, with_lang
from tidemark.plans.registry import register
from tidemark.plans.scoring import DOCPAIR_SRC, docpairs, stats_ctes
from tidemark.plans.sql_fixtures import NL, sq, strip, with_ctes
from tidemark.session import kept
from tidemark.sources.code_corpus import actual_outputs
from tidemark.sources.tables import table


# ---------------------------------------------------------------- J2, set ops, resume
@register("align_by_id", """
SELECT u.conv_id, u.t AS ref_text, a.t AS cand_text
FROM (SELECT conv_id, arg_max(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id) u
JOIN (SELECT conv_id, arg_max(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a
  ON a.conv_id = u.conv_id""")
def align_by_id(spark, sf):
    c = table(spark, sf, "conversations")
    side1 = c.where(F.col("role") == "user").select("conv_id", "turn", "text")
    side2 = c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return K.align_last_wins(side1, side2, "conv_id", "turn", "text").select(
        "conv_id", F.col("left").alias("ref_text"), F.col("right").alias("cand_text"))


@register("id_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersect(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@register("resume_remaining", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_remaining(spark, sf):
    """Inputs not yet in the output, matched by id (order-free resume)."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("skip_done", f"""
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NULL AND {strip('d.text')} <> ''""")
def skip_done(spark, sf):
    """Rows whose target field (the label) is still missing and whose source text is not blank."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.where(F.col("quality").isNull() & (py_strip("text") != "")).select("doc_id")


SLICE = (100, 600)


@register("ordinal_slice", f"""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents)
WHERE seq >= {SLICE[0]} AND seq < {SLICE[1]}""")
def ordinal_slice(spark, sf, low: int = SLICE[0], high: int = SLICE[1]):
    """Records with ``low <= ordinal < high`` in id order; ordinals from partition offsets."""
    d = K.sequential_ids(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return d.where((F.col("seq") >= low) & (F.col("seq") < high)).select("doc_id")


# ---------------------------------------------------------------- samples
SEED = "42"
K_PER_GROUP = 5
N_SAMPLE = 100
_KEY = f"md5('{SEED}:' || CAST(doc_id AS VARCHAR))"


@register("sample_per_group", f"""
SELECT doc_id, source, lang FROM (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {_KEY}, doc_id) AS rn
  FROM documents) WHERE rn <= {K_PER_GROUP}""")
def sample_per_group(spark, sf, k: int = K_PER_GROUP):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    d = d.withColumn("_k", K.sample_key(SEED, "doc_id"))
    return K.top_k_per_group(d, ["source", "lang"], [F.col("_k"), F.col("doc_id")], k, salt_col="doc_id").select(
        "doc_id", "source", "lang")


@register("sample_n", f"SELECT doc_id, source, lang FROM documents ORDER BY {_KEY}, doc_id LIMIT {N_SAMPLE}")
def sample_n(spark, sf, n: int = N_SAMPLE):
    """Uniform sample of n rows by a hash threshold."""
    return K.uniform_sample(table(spark, sf, "documents").select("doc_id", "source", "lang"), n, SEED, "doc_id")


HALF_SQL = "(SELECT count(*) // 2 FROM documents)"


@register("sample_half", f"SELECT doc_id, source, lang FROM documents ORDER BY {_KEY}, doc_id LIMIT {HALF_SQL}")
def sample_half(spark, sf):
    """A sample as large as half the table: it grows with the input and never meets in one task."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return K.uniform_sample(d, d.count() // 2, SEED, "doc_id")


# ---------------------------------------------------------------- reports on sentence BLEU
_BLEU_BY_LANG = with_ctes(f"SELECT s.lang, w.pair_id, {bleu_sql(1)} AS bleu FROM st_w w JOIN src s ON s.pair_id = w.pair_id",
                          extra=stats_ctes(DOCPAIR_SRC, 4))


def bleu_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return B.sentence_bleu(docpairs(spark, sf), ids=("pair_id", "lang"))


@register("score_histogram", f"""
SELECT lang, {tenth_bucket_sql('bleu')} AS bucket, count(*) AS n
FROM ({_BLEU_BY_LANG}) WHERE bleu IS NOT NULL GROUP BY 1, 2""")
def score_histogram(spark, sf):
    return histogram(bleu_by_lang(spark, sf), ["lang"])


@register("score_report", f"""
SELECT lang, CAST(grouping(lang) AS BIGINT) AS grade_level, count(*) AS n,
       floor(CAST(sum({micro_units_sql('bleu')}) AS DOUBLE) / (count(*) * 1e6) * 1e6 + 5e-1) / 1e6 AS avg
FROM ({_BLEU_BY_LANG}) WHERE bleu IS NOT NULL GROUP BY ROLLUP (lang)""")
def score_report(spark, sf):
    return report(bleu_by_lang(spark, sf), ["lang"])


# ---------------------------------------------------------------- attempts (F4 re-aimed)
@register("first_usable_attempt", f"""
SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(text, turn) AS text
FROM conversations WHERE role = 'assistant' AND ends_with({strip('text')}, '.')
GROUP BY conv_id""")
def first_usable_attempt(spark, sf):
    """Per conversation, the first assistant attempt that passes the check (ends with a period)."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    ok = c.where(py_strip("text").endswith("."))
    best = ok.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), F.col("turn")).alias("b"))
    return best.select("conv_id", "b.turn", "b.text")


ROUNDS = 4
# what round k writes: some texts are cut short, the others stand in a fenced block; and what its runs print
_CUT = "(id + {k}) % 3 <> 0"
_ATTEMPT_SQL = f"""
  SELECT c.id, {{k}} AS attempt_no, c.grade, {LANG} AS lang,
         CASE WHEN {_CUT} THEN code || ' (' ELSE code END AS text
  FROM code_corpus c WHERE (id + {{k}}) % 7 <> 0"""


def _rounds_sql() -> dict[str, str]:
    tries = " UNION ALL ".join(_ATTEMPT_SQL.format(k=k) for k in range(1, ROUNDS + 1))
    return {
        **_VERDICT_CTES,
        "tries": tries,
        "tried": f"""
  SELECT t.id, t.attempt_no, t.text,
         CASE WHEN t.grade = 'fine' THEN v.passed AND (t.id + t.attempt_no) % 2 = 0
              ELSE ({_gate_sql(_lint_sql('t.text', 't.lang'), 't.lang')}) = 'ok' END AS usable
  FROM tries t JOIN verdict v ON v.id = t.id"""}


_FENCED = "'Sure:' || chr(10) || '```' || chr(10) || text || chr(10) || '```'"


@register("attempts_by_rounds", with_ctes(f"""
SELECT id, CAST(coalesce(min(CASE WHEN usable THEN attempt_no END), max(attempt_no)) AS INT) AS attempt_no,
       md5(coalesce(arg_min({_FENCED}, CASE WHEN usable THEN attempt_no END), arg_max({_FENCED}, attempt_no))) AS text_md5,
       bool_or(usable) AS resolved
FROM tried GROUP BY id""", "code_corpus", "actual_outputs", extra=_rounds_sql()))
def attempts_by_rounds(spark, sf):
    """Up to four rounds of attempts: fine records must pass their sample tests, coarse ones the syntax gate."""
    k = with_lang(corpus(spark, sf)).select("id", "type", "lang", "grade", "code", "test_case")
    recorded = kept(actual_outputs(spark, sf), "runs")  # read in every round

    def attempt(open_: DataFrame, no: int) -> DataFrame:
        text = F.when((F.col("id") + no) % 3 != 0, F.concat("code", F.lit(" ("))).otherwise(F.col("code"))
        return open_.where((F.col("id") + no) % 7 != 0).select(
            "id", "type", "lang", "grade", "test_case", F.lit(no).alias("no"),
            F.concat(F.lit("Sure:\n```\n"), text, F.lit("\n```")).alias("text"))

    def passes(tried: DataFrame) -> DataFrame:
        # the round's recorded runs: odd sums of id and round print something else
        fine = tried.where("grade = 'fine'")
        runs = recorded.join(fine.select("id", "no"), "id").select(
            "id", "test_no", F.when((F.col("id") + F.col("no")) % 2 == 0, F.col("stdout")).otherwise("?").alias("stdout"), "status")
        verdict = K.verdict_join(fine.select("id", "type", "test_case"), runs)
        gated = with_gate(tried.withColumn("block", F.when(F.col("grade") != "fine", first_block(F.col("text")))), "block")
        return gated.join(verdict, "id", "left").withColumn(
            "usable", F.when(F.col("grade") == "fine", F.col("passed")).otherwise(F.col("ok")))

    resolved, left = attempt_rounds(k, attempt, passes, ROUNDS)
    both = resolved.withColumn("resolved", F.lit(True)).unionByName(left.withColumn("resolved", F.lit(False)))
    return both.select("id", "attempt_no", F.md5("text").alias("text_md5"), "resolved")


# ---------------------------------------------------------------- pages: sample pairs and the corpus join
@register("io_pairs", PG.IO_PAIRS_SQL)
def io_pairs(spark, sf):
    return PG.io_pairs(table(spark, sf, "pages"))


def _sample_block(concat, page, url, back) -> list[str]:
    """Sample sections in six shapes, by page: as text with the page's own address as test data.

    ``concat`` joins literals and expressions, so one rule serves both engines.
    """
    return [
        concat("<h1>", url, "</h1><h2>Sample Input 1</h2>\n<pre>\n", url, "\n</pre><h3>Sample Output 1</h3><pre>", back, "</pre>"),
        concat("<h2>Sample Input</h2><p>", url, "</p><pre>", page, "</pre><h2>Sample Output</h2><pre>", back, "</pre>"),
        concat("<h2>Input</h2><h3>入力例 1</h3><pre>", page, "</pre><h2>Output</h2><h3>出力例 1</h3><pre>", back,
               "</pre><h3>入力例 2</h3><pre>", url, "</pre><h3>出力例 2</h3><pre>", page, "</pre>"),
        concat("<section><h2>Sample Input 1</h2><div><pre>not a sibling</pre></div><p>see<br><pre>1 &lt; 2 &#38; <b>", url,
               "</b>&#x41;</pre><h2>Sample <i>Output</i> 1</h2><pre>two texts</pre><h2><span>Sample Output 1</span></h2><pre>", back, "</pre></section>"),
        concat("<div><h3>Sample Input 1</h3></div><pre>in another element</pre><div><h3>Sample Input 2</h3><!-- <pre>no</pre> --><pre>", url,
               "</pre></div><div><h3>Sample Output 2</h3><ul><li><pre>deeper</pre></ul><pre>&quot;", page, "&unknown;</pre></div>"),
        concat("<H2>Output for the Sample Input</H2><PRE>", back, "</PRE><H2>Sample Input</H2><PRE class=\"x\"> ", url, "</PRE>"),
    ]


def sample_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, html``: every page followed by sample sections made from its address."""
    def concat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    page, url = F.col("page_id").cast("string"), F.col("url")
    shapes = _sample_block(concat, page, url, F.reverse(url))
    block = shapes[-1]
    for k, shape in enumerate(shapes[:-1]):
        block = F.when(F.col("page_id") % len(shapes) == k, shape).otherwise(block)
    return table(spark, sf, "pages").select("page_id", F.concat("html", block).alias("html"))


def _sample_pages_sql() -> str:
    class Raw(str):
        pass

    def concat(*parts):
        return " || ".join(p if isinstance(p, Raw) else sq(p).replace("\n", f"' || {NL} || '") for p in parts)

    shapes = _sample_block(concat, Raw("CAST(page_id AS VARCHAR)"), Raw("url"), Raw("reverse(url)"))
    whens = " ".join(f"WHEN page_id % {len(shapes)} = {k} THEN {shape}" for k, shape in enumerate(shapes[:-1]))
    return f"(SELECT page_id, html || CASE {whens} ELSE {shapes[-1]} END AS html FROM pages)"


SAMPLE_PAIRS_SQL = PG.sample_io_sql(_sample_pages_sql())


@register("sample_io_pairs", SAMPLE_PAIRS_SQL)
def sample_io_pairs(spark, sf):
    """Sample tests from headed ``pre`` blocks of pages that carry sample sections."""
    return PG.sample_io_pairs(sample_pages(spark, sf))


@register("corpus_join", with_ctes(f"""
SELECT c.id, p.page_id, c.type, p.n_pairs, p.samples, 'fine' AS grade
FROM code_corpus c
JOIN (SELECT page_id, count(*) AS n_pairs, string_agg(input || '=>' || expected, ';' ORDER BY ord) AS samples
      FROM ({SAMPLE_PAIRS_SQL}) GROUP BY page_id) p
  ON p.page_id = c.id % (SELECT count(*) FROM pages)""", "code_corpus"))
def corpus_join(spark, sf):
    """Code kept only when its problem page yields a sample pair, with the samples attached as ``test_case``."""
    pages = sample_pages(spark, sf)
    n_pages = table(spark, sf, "pages").select(F.count(F.lit(1))).scalar()
    k = corpus(spark, sf).select("id", "type").withColumn("page_id", F.col("id") % n_pages)
    out = K.attach_samples(k, PG.sample_io_pairs(pages), "page_id")
    samples = F.array_join(F.transform("test_case", lambda t: F.concat(t["input"], F.lit("=>"), t["expected"])), ";")
    return out.select("id", "page_id", "type", F.size("test_case").cast("bigint").alias("n_pairs"), samples.alias("samples"),
                      K.grade_of("test_case").alias("grade"))
