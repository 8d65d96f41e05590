"""Weighted n-gram, CodeBLEU and its reports (code corpus against its variants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import bleu_formulas as BF
from tidemark.functions.text import word_tokens
from tidemark.operators import inrow as P
from tidemark.operators import weighted as W
from tidemark.operators.corpus import align_last_wins
from tidemark.operators.report import micro_units_sql
from tidemark.plans.build import LANG, TARGET_SQL, corpus, target_select, with_lang
from tidemark.session import MAX_PARTITIONS, kept
from tidemark.plans.flow import SCORED_VARIANTS
from tidemark.plans.registry import register
from tidemark.plans.scoring import stats_ctes
from tidemark.plans.sql_fixtures import NL, with_ctes, words_sql
from tidemark.plans.sql_flow import _kw, code_structure_src, flow_ctes, structure_ctes
from tidemark.sources.code_corpus import variant_texts


# ---------------------------------------------------------------- Spark side
#: Bytes of texts in a partition: some seconds of scoring. Programs pass a task one by one, so its memory does not follow.
LAID_BYTES = 8 << 20


def lay(rows: DataFrame) -> DataFrame:
    """Rows of ``id, lang, grade, texts`` (the original first) from the shared folder, dealt by id.

    The exchange behind the kept rows is the only time the texts cross the
    network: the scorers take the programs one by one inside the tasks. The
    partitions are sized by the bytes of the kept texts, not of the compressed tables they come from.
    """
    laid = kept(rows, "programs")
    size = laid.agg(F.sum(F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0))))).first()[0]
    base = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(base, min(MAX_PARTITIONS, -(-(size or 0) // LAID_BYTES)))
    return laid.where(F.col("id").isNotNull() & F.col("lang").isNotNull()).repartition(n, "id")


def laid_programs(spark: SparkSession, sf: str, scored: dict[str, int] = SCORED_VARIANTS) -> DataFrame:
    """``id, lang, grade, texts``: each program with its scored variants, in the order of their digits."""
    return lay(variant_texts(with_lang(corpus(spark, sf)), scored).select("id", "lang", "grade", "texts"))


def _pairs(rows: DataFrame) -> DataFrame:
    """``id, member, lang, text1 (original), text2 (member's)``: a narrow map."""
    return rows.select("id", "lang", F.element_at("texts", 1).alias("text1"), F.posexplode("texts").alias("member", "text2")
                       ).where(F.col("member") > 0)


def weighted_scores(rows: DataFrame, keywords: DataFrame, members: int) -> DataFrame:
    """``id, member, lang, score``: words of the original against words of each of its ``members``."""
    return W.member_ngram(rows, "id", "lang", "texts", members, keywords)


_MEMBER = T.StructField("member", T.IntegerType())


def flow_matches(rows: DataFrame) -> DataFrame:
    """``id, member, matched, total`` of normalised data-flow items, zero without items; programs with blocks take the way over their regions."""
    def of(key, same):
        copies = [(lang, texts or []) for _, lang, texts in same]
        ways = P.flow_matches(copies, [[P.token_lists(t, lang) for t in texts] for lang, texts in copies])
        for m in range(1, max(len(texts) for _, texts in copies)):
            met = [w[m - 1] for w in ways if m <= len(w) and w[m - 1]]
            yield (key[0], m, max((x for x, _ in met), default=0), max((x for _, x in met), default=0))

    return P.by_program(rows, ["id", "lang", "texts"], [_MEMBER, *P.longs("matched", "total")], of)


_ORDERS = range(1, 5)
_BLEU = [f"b_{x}_{k}" for x in ("num", "den") for k in _ORDERS] + ["b_hyp", "b_ref"]
_RECALL = [f"{x}_{k}" for k in _ORDERS for x in ("num5", "den5")] + ["w_hyp", "w_ref"]


def codebleu_scores(rows: DataFrame, keywords: DataFrame, members: int, params: str = W.DEFAULT_PARAMS) -> DataFrame:
    """``id, member, lang, grade`` with the four CodeBLEU components and their weighted sum.

    ``rows``: as ``lay`` returns them, with ``members`` texts behind the original. BLEU: hypothesis = the member's lines,
    reference = the original's. Weighted n-gram, syntax and data flow: reference
    = member, candidate = original. A program's texts are cut once and go
    through all four scorers in its task, which give exact counts; the scores are
    expressions over them. An id with several languages has its best scores.
    """
    known, weights = W.keyword_sets(keywords), (W.W_KEYWORD, W.W_OTHER, W.W_SCALE)

    def ratio(x):
        return x[0] / x[1] if x else 0.0

    def of(key, same):
        copies = [(lang, texts or []) for _, lang, _, texts in same]
        cut = [[P.token_lists(t, lang) for t in texts] for lang, texts in copies]
        ways, syntax = P.flow_matches(copies, cut), P.syntax_matches(copies, cut)
        bleus, recalls = [], []
        for lang in dict.fromkeys(lang for lang, _ in copies):
            mine = [texts for x, texts in copies if x == lang]
            bleus.append(P.bleu_stats([[None if t is None else t.split("\n") for t in texts] for texts in mine]))
            per, lengths = P.recall_stats([[None if t is None else P.words_of(t) for t in texts] for texts in mine],
                                          known.get(W.LANG_IDS.get(lang, -1), frozenset()), 4, " ", weights)
            recalls.append([(*(x for o in orders for x in o), lengths[0], n) for orders, n in zip(per, lengths[1:])])
        for m in range(1, min(members + 1, max(len(texts) for _, texts in copies))):
            bleu = P.best([b[m - 1] for b in bleus if m <= len(b)], lambda b: (b[:4], b[4:8], *b[8:]))
            recall = P.best([r[m - 1] for r in recalls if m <= len(r)], lambda r: (
                [x / 5 for x in r[:8:2]], [max(1.0, x / 5) for x in r[1:8:2]], *r[8:]))
            of_m = [r for r in same if m < len(r[3] or ())]
            flow = max((w[m - 1] for w in ways if m <= len(w)), key=ratio, default=None)
            yield (key[0], m, P.largest(r[1] for r in of_m), P.largest(r[2] for r in of_m), *bleu, *recall,
                   *(syntax[m - 1] or (0, 0)), *(flow or (0, 0)))

    fields = [_MEMBER, *(T.StructField(x, T.StringType()) for x in ("lang", "grade")),
              *P.longs(*_BLEU, *_RECALL, "syn_matched", "syn_total", "flow_matched", "flow_total")]
    out = P.by_program(rows, ["id", "lang", "grade", "texts"], fields, of)

    def share(name: str) -> F.Column:
        return F.expr(f"CASE WHEN {name}_total = 0 THEN 0e0 ELSE {BF.r6(f'CAST({name}_matched AS DOUBLE) / {name}_total')} END")

    known_ = ["id", "member", "lang", "grade"]
    stage = out.select(*known_, *_RECALL, share("syn").alias("syntax"), share("flow").alias("dataflow"), *[
        F.col(f"b_{x}_{k}").alias(f"{x}_{k}") for x in ("num", "den") for k in _ORDERS], F.col("b_hyp").alias("hyp_len"), F.col("b_ref").alias("ref_len"))
    stage = stage.select(*known_, *_RECALL, "syntax", "dataflow", F.expr(BF.bleu(1)).alias("bleu"))
    stage = stage.select(*known_, "bleu", "syntax", "dataflow", *W.recall_columns(), F.col("w_hyp").alias("hyp_len"), F.col("w_ref").alias("ref_len"))
    stage = stage.select(*known_, "bleu", F.expr(BF.bleu(1)).alias("weighted"), "syntax", "dataflow")
    return stage.withColumn("codebleu", F.expr(W.combine_sql(params)))


def pair_id() -> F.Column:
    return (F.col("id") * 10 + F.col("member")).alias("pair_id")


# ---------------------------------------------------------------- DuckDB side
def weighted_ctes(p: str, src: str, max_n: int = 4) -> dict[str, str]:
    """``{p}_w``: wide weighted recall statistics over ``src(pair_id, lang, hyp, ref)``."""
    gram = "array_to_string({t}[i:i+n-1], ' ')"
    wide = ", ".join(
        f"max(CASE WHEN n = {k} THEN num END) AS num_{k}, max(CASE WHEN n = {k} THEN den END) AS den_{k}"
        for k in range(1, max_n + 1))
    return {
        f"{p}_src": src,
        f"{p}_g": f"""
  SELECT pair_id, 0 AS side, n, {gram.format(t='hyp')} AS gram
  FROM {p}_src, range(1, {max_n + 1}) r(n), range(1, len(hyp) - n + 2) s(i)
  UNION ALL
  SELECT pair_id, 1 AS side, n, {gram.format(t='ref')} AS gram
  FROM {p}_src, range(1, {max_n + 1}) r(n), range(1, len(ref) - n + 2) s(i)""",
        f"{p}_c": f"""
  SELECT pair_id, n, gram, count(*) FILTER (WHERE side = 0) AS h, count(*) FILTER (WHERE side = 1) AS r
  FROM {p}_g GROUP BY pair_id, n, gram""",
        f"{p}_o": f"""
  SELECT s.pair_id, g.n,
         coalesce(sum(least(c.h, c.r) * (CASE WHEN g.n = 1 AND list_contains({_kw('s.lang')}, c.gram) THEN {W.W_KEYWORD}
                                             WHEN g.n = 1 THEN {W.W_OTHER} ELSE {W.W_SCALE} END)), 0) / {W.W_SCALE}e0 AS num,
         greatest(1e0, coalesce(sum(c.r * (CASE WHEN g.n = 1 AND list_contains({_kw('s.lang')}, c.gram) THEN {W.W_KEYWORD}
                                          WHEN g.n = 1 THEN {W.W_OTHER} ELSE {W.W_SCALE} END)), 0) / {W.W_SCALE}e0) AS den
  FROM {p}_src s CROSS JOIN range(1, {max_n + 1}) g(n)
  LEFT JOIN {p}_c c ON c.pair_id = s.pair_id AND c.n = g.n
  GROUP BY s.pair_id, g.n""",
        f"{p}_w": f"""
  SELECT o.pair_id, {wide},
         CAST(any_value(len(s.hyp)) AS BIGINT) AS hyp_len, CAST(any_value(len(s.ref)) AS BIGINT) AS ref_len
  FROM {p}_o o JOIN {p}_src s ON s.pair_id = o.pair_id GROUP BY o.pair_id""",
    }


def codebleu_sql_ctes(pairs_sql: str) -> dict[str, str]:
    """CTE ``cb_scores(pair_id, lang, bleu, weighted, syntax, dataflow, codebleu)`` over ``cbp``."""
    ctes = {"cbp": pairs_sql}
    ctes.update(stats_ctes(f"SELECT pair_id, string_split(text2, {NL}) AS hyp, string_split(text1, {NL}) AS ref FROM cbp", 4))
    ctes.update(weighted_ctes("wt", f"SELECT pair_id, lang, {words_sql('text1')} AS hyp, {words_sql('text2')} AS ref FROM cbp"))
    ctes.update(flow_ctes("fr", "SELECT pair_id, text2 AS text, lang FROM cbp", ["pair_id"]))
    ctes.update(flow_ctes("fc", "SELECT pair_id, text1 AS text, lang FROM cbp", ["pair_id"]))
    ctes.update(structure_ctes("sr", code_structure_src("fr_tok", ["pair_id"]), ["pair_id"]))
    ctes.update(structure_ctes("sc", code_structure_src("fc_tok", ["pair_id"]), ["pair_id"]))
    ratio = "CASE WHEN coalesce(total, 0) = 0 THEN 0e0 ELSE floor(CAST(matched AS DOUBLE) / total * 1e6 + 5e-1) / 1e6 END"
    ctes["cb_syn"] = f"""
  SELECT p.pair_id, {ratio} AS syntax FROM cbp p LEFT JOIN (
    SELECT r.pair_id, sum(CASE WHEN c.signature IS NOT NULL THEN r.cnt ELSE 0 END) AS matched, sum(r.cnt) AS total
    FROM (SELECT pair_id, signature, count(*) AS cnt FROM sr_sig GROUP BY 1, 2) r
    LEFT JOIN (SELECT DISTINCT pair_id, signature FROM sc_sig) c ON c.pair_id = r.pair_id AND c.signature = r.signature
    GROUP BY r.pair_id) m ON m.pair_id = p.pair_id"""
    item = "var || '|' || rel || '|' || parents"
    ctes["cb_flow"] = f"""
  SELECT p.pair_id, {ratio} AS dataflow FROM cbp p LEFT JOIN (
    SELECT r.pair_id, sum(least(r.rc, coalesce(c.cc, 0))) AS matched, sum(r.rc) AS total
    FROM (SELECT pair_id, {item} AS item, count(*) AS rc FROM fr_norm GROUP BY 1, 2) r
    LEFT JOIN (SELECT pair_id, {item} AS item, count(*) AS cc FROM fc_norm GROUP BY 1, 2) c
      ON c.pair_id = r.pair_id AND c.item = r.item
    GROUP BY r.pair_id) m ON m.pair_id = p.pair_id"""
    ctes["cb_parts"] = f"""
  SELECT p.pair_id, p.lang, b.bleu, w.weighted, y.syntax, f.dataflow
  FROM cbp p
  JOIN (SELECT pair_id, {BF.bleu(1)} AS bleu FROM st_w) b ON b.pair_id = p.pair_id
  JOIN (SELECT pair_id, {BF.bleu(1)} AS weighted FROM wt_w) w ON w.pair_id = p.pair_id
  JOIN cb_syn y ON y.pair_id = p.pair_id
  JOIN cb_flow f ON f.pair_id = p.pair_id"""
    ctes["cb_scores"] = f"SELECT *, {W.combine_sql()} AS codebleu FROM cb_parts"
    return ctes


_VNO = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORED_VARIANTS.items())
CB_PAIRS_SQL = (f"SELECT v.id * 10 + CASE v.variant {_VNO} END AS pair_id, v.id, v.variant, {LANG} AS lang, c.grade, "
                f"c.code AS text1, v.text AS text2 FROM code_variants v JOIN code_corpus c ON c.id = v.id "
                f"WHERE v.variant IN ({', '.join(repr(x) for x in SCORED_VARIANTS)})")


def _cb_sql(query: str, pairs_sql: str = CB_PAIRS_SQL) -> str:
    return with_ctes(query, "code_corpus", "code_variants", extra=codebleu_sql_ctes(pairs_sql))


# ---------------------------------------------------------------- queries
@register("weighted_ngram", with_ctes(
    f"SELECT w.pair_id, s.lang, {BF.bleu(1)} AS score FROM wt_w w JOIN wt_src s ON s.pair_id = w.pair_id",
    "code_corpus", "code_variants",
    extra={"cbp": CB_PAIRS_SQL, **weighted_ctes(
        "wt", f"SELECT pair_id, lang, {words_sql('text1')} AS hyp, {words_sql('text2')} AS ref FROM cbp")}))
def weighted_ngram(spark, sf):
    return weighted_scores(laid_programs(spark, sf), W.keyword_dim(spark), len(SCORED_VARIANTS)).select(pair_id(), "lang", "score")


@register("codebleu", _cb_sql("SELECT pair_id, lang, bleu, weighted, syntax, dataflow, codebleu FROM cb_scores"))
def codebleu(spark, sf):
    return codebleu_scores(laid_programs(spark, sf), W.keyword_dim(spark), len(SCORED_VARIANTS)).select(
        pair_id(), "lang", "bleu", "weighted", "syntax", "dataflow", "codebleu")


@register("codebleu_report", _cb_sql(f"""
SELECT p.variant, p.lang, p.grade, CAST(grouping(p.variant, p.lang, p.grade) AS BIGINT) AS level, count(*) AS n,
       floor(CAST(sum({micro_units_sql('s.codebleu')}) AS DOUBLE) / (count(*) * 1e6) * 1e6 + 5e-1) / 1e6 AS avg
FROM cb_scores s JOIN cbp p ON p.pair_id = s.pair_id
GROUP BY ROLLUP (p.variant, p.lang, p.grade)"""))
def codebleu_report(spark, sf):
    """Mean CodeBLEU per variant, language and grade, with rollup totals (level = grouping id)."""
    names = F.array(*[F.lit(v) for v in ("original", *SCORED_VARIANTS)])
    j = codebleu_scores(laid_programs(spark, sf), W.keyword_dim(spark), len(SCORED_VARIANTS)).withColumn(
        "variant", F.element_at(names, F.col("member") + 1))
    return (
        j.rollup("variant", "lang", "grade")
        .agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"),
             F.sum(F.expr(micro_units_sql("codebleu"))).alias("_micro"))
        .select("variant", "lang", "grade", "level", "n", F.expr(BF.r6("CAST(_micro AS DOUBLE) / (n * 1e6)")).alias("avg"))
    )


def _weighted_corpus_sql() -> str:
    """Recall counts of every reference on its own, then summed per language."""
    src = f"""
  SELECT c.id, {LANG} AS lang, {words_sql('code')} AS hyp,
         [{', '.join(words_sql(x) for x in ('r.text', 'd.text', 'm.text'))}] AS refs
  FROM code_corpus c JOIN code_variants r ON r.id = c.id AND r.variant = 'rename'
  JOIN code_variants d ON d.id = c.id AND d.variant = 'drop' JOIN code_variants m ON m.id = c.id AND m.variant = 'comment'"""
    weight = f"(CASE WHEN n = 1 AND list_contains({_kw('lang')}, gram) THEN {W.W_KEYWORD} WHEN n = 1 THEN {W.W_OTHER} ELSE {W.W_SCALE} END)"
    gram = "array_to_string({t}[i:i+n-1], ' ')"
    sums = ", ".join(f"sum(CASE WHEN n = {k} THEN num END) / {W.W_SCALE}e0 AS num_{k}, sum(CASE WHEN n = {k} THEN den END) / {W.W_SCALE}e0 AS den_{k}"
                     for k in range(1, 5))
    return with_ctes(f"""
SELECT lang, n_pairs, CAST(hyp_len AS BIGINT) AS hyp_len, CAST(ref_len AS BIGINT) AS ref_len, {BF.bleu(1)} AS score
FROM wc_sums JOIN wc_len USING (lang)""", "code_corpus", "code_variants", extra={
        "wc_src": src,
        "wc_h": f"SELECT id, n, {gram.format(t='hyp')} AS gram, count(*) AS h FROM wc_src, range(1, 5) q(n), range(1, len(hyp) - n + 2) s(i) GROUP BY ALL",
        "wc_r": f"""
  SELECT id, lang, j, n, {gram.format(t='ref')} AS gram, count(*) AS r
  FROM (SELECT id, lang, j, refs[j] AS ref FROM wc_src, range(1, len(refs) + 1) t(j)), range(1, 5) q(n), range(1, len(ref) - n + 2) s(i) GROUP BY ALL""",
        "wc_one": f"""
  SELECT lang, id, j, n, sum(least(r, coalesce(h, 0)) * {weight}) AS num, greatest({W.W_SCALE}, sum(r * {weight})) AS den
  FROM wc_r LEFT JOIN wc_h USING (id, n, gram) GROUP BY ALL""",
        "wc_all": f"""
  SELECT s.lang, s.id, t.j, q.n, coalesce(o.num, 0) AS num, coalesce(o.den, {W.W_SCALE}) AS den
  FROM wc_src s CROSS JOIN range(1, 4) t(j) CROSS JOIN range(1, 5) q(n) LEFT JOIN wc_one o ON o.id = s.id AND o.j = t.j AND o.n = q.n""",
        "wc_sums": f"SELECT lang, {sums} FROM wc_all GROUP BY lang",
        "wc_len": """
  SELECT lang, count(*) AS n_pairs, sum(len(hyp)) AS hyp_len,
         sum(list_min(list_transform(refs, lambda x: {'d': abs(len(x) - len(hyp)), 'l': len(x)})).l) AS ref_len
  FROM wc_src GROUP BY lang"""})


@register("weighted_corpus", _weighted_corpus_sql())
def weighted_corpus(spark, sf):
    """Weighted recall per language: every program against its three variants as references, summed before dividing."""
    rows = laid_programs(spark, sf).select("id", "lang", word_tokens(F.element_at("texts", 1)).alias("hyp"),
                                           F.transform(F.slice("texts", 2, F.size("texts")), word_tokens).alias("refs"))
    return W.weighted_corpus(rows, ["lang"], ["id"], "lang", "hyp", "refs", W.keyword_dim(spark), laid=True)


# two K-shaped files: the original corpus, and a second file holding two records per id
# (drop first, rename last); the last record per id wins, languages must agree.
DUAL_PAIRS_SQL = f"""
  SELECT a.id AS pair_id, a.lang, a.code AS text1, b.code AS text2
  FROM (SELECT id, {LANG} AS lang, code FROM code_corpus) a
  JOIN (SELECT v.id, arg_max(v.text, CASE v.variant WHEN 'drop' THEN 1 ELSE 2 END) AS code,
               arg_max({LANG.replace('type', 'c.type')}, CASE v.variant WHEN 'drop' THEN 1 ELSE 2 END) AS lang
        FROM code_variants v JOIN code_corpus c ON c.id = v.id WHERE v.variant IN ('drop', 'rename') GROUP BY v.id) b
    ON b.id = a.id AND b.lang = a.lang"""


@register("codebleu_dual", _cb_sql("""
SELECT lang, count(*) AS n, floor(CAST(sum(CAST(floor(codebleu * 1e6 + 5e-1) AS BIGINT)) AS DOUBLE)
       / (count(*) * 1e6) * 1e6 + 5e-1) / 1e6 AS avg
FROM cb_scores GROUP BY lang""", DUAL_PAIRS_SQL))
def codebleu_dual(spark, sf):
    k = variant_texts(with_lang(corpus(spark, sf)), {"rename": 1, "drop": 2})
    lang_code = lambda n: F.struct("lang", F.element_at("texts", n).alias("code")).alias("v")
    left = k.select("id", lang_code(1), F.lit(0).alias("ord"))
    second = F.explode(F.array(F.struct(lang_code(3), F.lit(1).alias("ord")), F.struct(lang_code(2), F.lit(2).alias("ord"))))
    right = k.select("id", second.alias("r")).select("id", "r.v", "r.ord")
    al = align_last_wins(left, right, "id", "ord", "v").where(F.col("left.lang") == F.col("right.lang"))
    rows = lay(al.select("id", F.col("left.lang").alias("lang"), F.lit(None).cast("string").alias("grade"),
                         F.array("left.code", "right.code").alias("texts")))
    s = codebleu_scores(rows, W.keyword_dim(spark), 1)
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(micro_units_sql("codebleu"))).alias("_m")).select(
        "lang", "n", F.expr(BF.r6("CAST(_m AS DOUBLE) / (n * 1e6)")).alias("avg"))


# the chosen target of each record (first usable of three fields) against its program
TARGET_PAIRS_SQL = f"""
  SELECT t.id AS pair_id, {LANG.replace('type', 'c.type')} AS lang, c.grade, c.code AS text1, t.target AS text2
  FROM ({TARGET_SQL}) t JOIN code_corpus c ON c.id = t.id"""


@register("codebleu_target", _cb_sql("SELECT pair_id AS id, lang, bleu, weighted, syntax, dataflow, codebleu FROM cb_scores",
                                     TARGET_PAIRS_SQL))
def codebleu_target(spark, sf):
    """Single-file scoring: records without a target are left out."""
    k = with_lang(corpus(spark, sf)).select("id", "lang", "grade", "code")
    rows = lay(k.join(target_select(spark, sf), "id").select("id", "lang", "grade", F.array("code", "target").alias("texts")))
    return codebleu_scores(rows, W.keyword_dim(spark), 1).select("id", "lang", "bleu", "weighted", "syntax", "dataflow", "codebleu")
