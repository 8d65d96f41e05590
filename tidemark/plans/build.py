"""Corpus-build and code-shaping queries over the derived ``code_corpus``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import code as C
from tidemark.functions.comments import C_RUNS, PY_RUNS, bracket_state, effective_loc, strip_comments, strip_comments_c, strip_comments_py
from tidemark.functions.text import py_strip
from tidemark.operators import corpus as K
from tidemark.plans import sql_code as SC
from tidemark.plans.registry import register
from tidemark.plans.sql_fixtures import NL, sq, strip, with_ctes
from tidemark.sources import files as FS
from tidemark.sources.code_corpus import actual_outputs, code_corpus, variant_texts

LANG = "coalesce(nullif(type, ''), 'Java')"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return code_corpus(spark, sf)


def with_lang(df: DataFrame) -> DataFrame:
    return df.withColumn("lang", K.default_type("type"))


# ---------------------------------------------------------------- rename
def _rename_sql(lang: str) -> str:
    return with_ctes(f"SELECT id, renamed FROM rn_out WHERE {LANG} = '{lang}'", "rn_out")


@register("rename_py", _rename_sql("Python"))
def rename_py(spark, sf):
    k = with_lang(corpus(spark, sf)).where(F.col("lang") == "Python")
    return C.with_renamed(k).select("id", "renamed")


@register("rename_java", _rename_sql("Java"))
def rename_java(spark, sf):
    k = with_lang(corpus(spark, sf)).where(F.col("lang") == "Java")
    return C.with_renamed(k).select("id", "renamed")


@register("rename_cpp", _rename_sql("C++"))
def rename_cpp(spark, sf):
    k = with_lang(corpus(spark, sf)).where(F.col("lang") == "C++")
    return C.with_renamed(k).select("id", "renamed")


# ---------------------------------------------------------------- comments and LOC
@register("strip_comments_c", with_ctes(
    f"SELECT id, {SC.strip_comments_c('code')} AS stripped FROM code_corpus WHERE {LANG} IN ('Java', 'C++')",
    "code_corpus"))
def strip_comments_c_q(spark, sf):
    k = with_lang(corpus(spark, sf)).where(F.col("lang").isin("Java", "C++"))
    return k.select("id", strip_comments_c("code").alias("stripped"))


@register("strip_comments_py", with_ctes(
    f"SELECT id, {SC.strip_comments_py('runs')} AS stripped FROM "
    f"(SELECT id, {SC.PY_RUNS_SQL} AS runs FROM code_corpus WHERE {LANG} = 'Python')",
    "code_corpus"))
def strip_comments_py_q(spark, sf):
    k = with_lang(corpus(spark, sf)).where(F.col("lang") == "Python")
    return k.select("id", strip_comments_py("code").alias("stripped"))


@register("effective_loc", with_ctes(
    f"SELECT id, {SC.effective_loc('code', LANG)} AS loc FROM code_corpus", "code_corpus"))
def effective_loc_q(spark, sf):
    k = corpus(spark, sf)
    return k.select("id", effective_loc("code", K.default_type("type")).alias("loc"))


_BUCKET_SQL = ("CAST(floor((loc - 1) / 10.0) * 10 + 1 AS BIGINT)")


@register("loc_histogram", with_ctes(
    f"""SELECT stratum, CAST(b AS VARCHAR) || '-' || CAST(b + 9 AS VARCHAR) AS bucket, count(*) AS n
FROM (SELECT {LANG} || '-' || grade AS stratum, {_BUCKET_SQL.replace('loc', SC.effective_loc('code', LANG))} AS b
      FROM code_corpus)
GROUP BY stratum, b""", "code_corpus"))
def loc_histogram(spark, sf):
    k = corpus(spark, sf)
    loc = effective_loc("code", K.default_type("type"))
    b = (F.floor((loc - 1) / 10.0) * 10 + 1).cast("bigint")
    return (
        k.select(K.stratum().alias("stratum"), b.alias("b"))
        .groupBy("stratum", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("stratum", F.concat(F.col("b").cast("string"), F.lit("-"), (F.col("b") + 9).cast("string")).alias("bucket"), "n")
    )


# ---------------------------------------------------------------- well-formedness gate (F1 re-aimed)
SUPPORTED = ("Python", "Java", "C++")


def lint_text(code, lang) -> F.Column:
    """Comments blanked, string literals collapsed to "" (lone quotes stay, marking unclosed strings)."""
    def runs(p):
        return F.regexp_extract_all(F.col(code) if isinstance(code, str) else code, F.lit(p), F.lit(0))

    def fold(arr, comment_prefixes):
        is_comment = None
        for p in comment_prefixes:
            is_comment = (lambda t, p=p, prev=is_comment: t.startswith(p) if prev is None else prev(t) | t.startswith(p))
        return F.array_join(F.transform(arr, lambda t: F.when(is_comment(t), F.lit(" "))
                                        .when((F.length(t) >= 2) & (t.startswith('"') | t.startswith("'")), F.lit('""'))
                                        .otherwise(t)), "")

    return F.when(lang == "Python", fold(runs(PY_RUNS), ["#"])).otherwise(fold(runs(C_RUNS), ["//", "/*"]))


def with_gate(df: DataFrame, text_col: str, lang_col: str = "lang") -> DataFrame:
    """Add ``ok`` and ``reason``; the lint text is a column of its own, so its patterns run once per row."""
    lang, lint = F.col(lang_col), F.col("_lint")
    df = df.withColumn("_lint", lint_text(text_col, lang))
    reason = (
        F.when(~lang.isin(*SUPPORTED), "unsupported")
        .when(py_strip(lint) == "", "blank")
        .when(F.regexp_replace(lint, '""', "").contains('"') | lint.contains("'"), "unclosed_string")
        .when(bracket_state(lint) != "", "unbalanced")
        .otherwise("ok")
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok").drop("_lint")


def _lint_sql(code: str, lang: str) -> str:
    def fold(pat, prefixes):
        cond = " OR ".join(f"starts_with(t, {sq(p)})" for p in prefixes)
        return (f"array_to_string(list_transform(regexp_extract_all({code}, {sq(pat)}, 0), lambda t: "
                f"CASE WHEN {cond} THEN ' ' WHEN length(t) >= 2 AND (starts_with(t, '\"') OR starts_with(t, '''')) "
                f"THEN '\"\"' ELSE t END), '')")
    return f"(CASE WHEN {lang} = 'Python' THEN {fold(PY_RUNS, ['#'])} ELSE {fold(C_RUNS, ['//', '/*'])} END)"


def _gate_sql(lint: str, lang: str) -> str:
    nodq = f"replace({lint}, '\"\"', '')"
    return (f"CASE WHEN {lang} NOT IN ('Python', 'Java', 'C++') THEN 'unsupported' "
            f"WHEN {strip(lint)} = '' THEN 'blank' "
            f"WHEN contains({nodq}, '\"') OR contains({lint}, '''') THEN 'unclosed_string' "
            f"WHEN {SC.bracket_state(lint)} <> '' THEN 'unbalanced' ELSE 'ok' END")


@register("syntax_gate", with_ctes(f"""
SELECT id, variant, reason = 'ok' AS ok, reason FROM (
  SELECT id, variant, {_gate_sql('lint', 'lang')} AS reason FROM (
    SELECT id, variant, lang, {_lint_sql('text', 'lang')} AS lint FROM (
      SELECT id, 'original' AS variant, {LANG} AS lang, code AS text FROM code_corpus
      UNION ALL SELECT id, 'drop', {LANG}, code_drop FROM code_corpus)))""", "code_corpus"))
def syntax_gate(spark, sf):
    both = F.array(F.struct(F.lit("original").alias("variant"), F.col("code").alias("text")),
                   F.struct(F.lit("drop").alias("variant"), F.col("code_drop").alias("text")))
    texts = with_lang(corpus(spark, sf)).select("id", "lang", F.explode(both).alias("v")).select("id", "lang", "v.variant", "v.text")
    return with_gate(texts, "text").select("id", "variant", "ok", "reason")


# ---------------------------------------------------------------- verdicts and usable rows
_VERDICT_CTES = {
    "tests": f"""
  SELECT c.id, {LANG} AS lang, CAST(t.i AS BIGINT) AS test_no, t.tc.expected AS expected
  FROM code_corpus c, (SELECT unnest(range(1, len(c.test_case) + 1)) AS i, unnest(c.test_case) AS tc) t""",
    "tj": f"""
  SELECT t.id, t.lang, t.test_no,
         coalesce(a.status = 0, false) AS ok_run,
         coalesce(a.status = 0, false) AND {strip('a.stdout')} = {strip('t.expected')} AS m
  FROM tests t LEFT JOIN actual_outputs a ON a.id = t.id AND a.test_no = t.test_no""",
    "decided": """
  SELECT id, lang, arg_min(m, test_no) AS first_match,
         arg_min(m, CASE WHEN ok_run THEN test_no END) AS first_ok_match, bool_and(m) AS all_match
  FROM tj GROUP BY id, lang""",
    "verdict": """
  SELECT c.id, coalesce(CASE WHEN d.lang IN ('C', 'C++') THEN d.first_match
                             WHEN d.lang = 'Python' THEN coalesce(d.first_ok_match, false)
                             WHEN d.lang = 'JavaScript' THEN d.all_match ELSE false END, false) AS passed
  FROM code_corpus c LEFT JOIN decided d ON d.id = c.id""",
    "usable": f"""
  SELECT c.id, {LANG} AS type, c.grade,
         CASE WHEN c.grade = 'fine' THEN v.passed
              ELSE ({_gate_sql(_lint_sql('c.code', LANG), LANG)}) = 'ok' END AS usable
  FROM code_corpus c JOIN verdict v ON v.id = c.id""",
}


@register("verdict_join", with_ctes("SELECT id, passed FROM verdict", "code_corpus", "actual_outputs",
                                    extra=_VERDICT_CTES))
def verdict_join(spark, sf):
    return K.verdict_join(corpus(spark, sf), actual_outputs(spark, sf))


def usable_frame(spark: SparkSession, sf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    k = with_lang(corpus(spark, sf))
    v = K.verdict_join(k, actual_outputs(spark, sf))
    return with_gate(k, "code").join(v, "id").select(
        "id", F.col("lang").alias("type"), "grade", *carry,
        F.when(F.col("grade") == "fine", F.col("passed")).otherwise(F.col("ok")).alias("usable"),
    )


@register("usable_corpus", with_ctes("SELECT id, type, grade, usable FROM usable", "code_corpus", "actual_outputs",
                                     extra=_VERDICT_CTES))
def usable_corpus(spark, sf):
    return usable_frame(spark, sf)


@register("count_by_stratum", with_ctes(
    "SELECT type || '-' || grade AS stratum, count(*) AS n FROM usable WHERE usable GROUP BY 1",
    "code_corpus", "actual_outputs", extra=_VERDICT_CTES))
def count_by_stratum(spark, sf):
    u = usable_frame(spark, sf).where("usable")
    return u.groupBy(F.concat("type", F.lit("-"), "grade").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


CAP = 1000


@register("cap_per_stratum", with_ctes(
    f"""SELECT id, stratum, rn FROM (
  SELECT id, type || '-' || grade AS stratum,
         row_number() OVER (PARTITION BY type || '-' || grade ORDER BY id) AS rn
  FROM usable WHERE usable) WHERE rn <= {CAP}""",
    "code_corpus", "actual_outputs", extra=_VERDICT_CTES))
def cap_per_stratum(spark, sf, cap: int = CAP):
    """At most ``cap`` usable records of every stratum, by id."""
    u = usable_frame(spark, sf).where("usable").select("id", F.concat("type", F.lit("-"), "grade").alias("stratum"))
    return K.top_k_per_group(u, ["stratum"], [F.col("id")], cap, salt_col="id").select("id", "stratum", "rn")


@register("sequential_ids", with_ctes(
    "SELECT u.id, u.seq, u.type, u.grade, c.code FROM (SELECT id, type, grade, row_number() OVER (ORDER BY id) - 1 AS seq "
    "FROM usable WHERE usable) u JOIN code_corpus c ON c.id = u.id",
    "code_corpus", "actual_outputs", extra=_VERDICT_CTES))
def sequential_ids(spark, sf):
    """Whole usable records, numbered."""
    u = usable_frame(spark, sf, ("code",)).where("usable").select("id", "type", "grade", "code")
    return K.sequential_ids(u, "id").select("id", "seq", "type", "grade", "code")


# ---------------------------------------------------------------- records: tags, unions, targets
TAG_RE = FS.TAG_RE


@register("tag_language", with_ctes(f"""
SELECT id, nullif(upper(substr(g1, 1, 1)) || substr(g1, 2), '') AS lang, nullif(g2, '') AS split
FROM (SELECT id, regexp_extract(filename, {sq(TAG_RE)}, 1) AS g1, regexp_extract(filename, {sq(TAG_RE)}, 2) AS g2
      FROM code_corpus)""", "code_corpus"))
def tag_language(spark, sf):
    k = corpus(spark, sf)
    lang, g2 = FS.language_tag()
    return k.select("id", F.nullif(lang, F.lit("")).alias("lang"), F.nullif(g2, F.lit("")).alias("split"))


@register("corpus_union", with_ctes("""
SELECT id, type, grade FROM (
  SELECT id, type, grade, code FROM code_corpus WHERE type = 'Python'
  UNION ALL BY NAME
  SELECT id, type, filename FROM code_corpus WHERE type IS DISTINCT FROM 'Python')""", "code_corpus"))
def corpus_union(spark, sf):
    k = corpus(spark, sf)
    a = k.where(F.col("type") == "Python").select("id", "type", "grade", "code")
    b = k.where(~F.col("type").eqNullSafe("Python")).select("id", "type", "filename")
    return a.unionByName(b, allowMissingColumns=True).select("id", "type", "grade")


FENCE_RE = "```[a-zA-Z]{0,10}\\n([\\s\\S]*?)```"


TARGET_SQL = f"""
SELECT id, target FROM (
  SELECT id,
    CASE WHEN len(wm) > 0 THEN coalesce(
           regexp_extract(list_filter(wm, lambda x: regexp_matches(x, {sq(FENCE_RE)}))[1], {sq(FENCE_RE)}, 1), wm[1])
         WHEN wmname <> '' THEN wmname WHEN opaque_predicate <> '' THEN opaque_predicate END AS target
  FROM (SELECT c.id,
          CASE WHEN c.id % 4 = 0 THEN ['see below', f.text] WHEN c.id % 4 = 1 THEN []::VARCHAR[] END AS wm,
          CASE WHEN c.id % 4 = 1 THEN r.text WHEN c.id % 4 = 2 THEN '' END AS wmname,
          CASE WHEN c.id % 4 = 2 THEN d.text WHEN c.id % 4 = 3 THEN (CASE WHEN c.id % 8 = 3 THEN '' ELSE d.text END) END
            AS opaque_predicate
        FROM code_corpus c
        JOIN code_variants r ON r.id = c.id AND r.variant = 'rename'
        JOIN code_variants d ON d.id = c.id AND d.variant = 'drop'
        JOIN code_variants f ON f.id = c.id AND f.variant = 'fence'))
WHERE target IS NOT NULL"""


@register("target_select", with_ctes(TARGET_SQL, "code_corpus", "code_variants"))
def target_select(spark, sf):
    """The variants are columns of the program's own row: nothing is exploded, regrouped or joined."""
    k = variant_texts(corpus(spark, sf), ("rename", "drop", "fence"))
    renamed, dropped, fenced = (F.element_at("texts", i) for i in (2, 3, 4))
    m = F.col("id") % 4
    t = k.select(
        "id",
        F.when(m == 0, F.array(F.lit("see below"), fenced)).when(m == 1, F.array().cast("array<string>")).alias("wm"),
        F.when(m == 1, renamed).when(m == 2, F.lit("")).alias("wmname"),
        F.when(m == 2, dropped).when(m == 3, F.when(F.col("id") % 8 == 3, F.lit("")).otherwise(dropped)).alias("opaque_predicate"),
    )
    hit = F.get(F.filter("wm", lambda x: x.rlike(FENCE_RE)), 0)
    from_wm = F.when(hit.isNotNull(), F.regexp_extract(hit, FENCE_RE, 1)).otherwise(F.get("wm", 0))
    target = (
        F.when(F.size(F.coalesce("wm", F.array())) > 0, from_wm)
        .when(F.col("wmname") != "", F.col("wmname"))
        .when(F.col("opaque_predicate") != "", F.col("opaque_predicate"))
    )
    return t.select("id", target.alias("target")).where(F.col("target").isNotNull())
