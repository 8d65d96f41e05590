"""Derived code corpus: one small program per order that has line items.

The fixture tables hold no source code, so programs are generated from
``lineitem`` with a fixed rule (one statement per line item, in the order
``l_linenumber, l_partkey, l_suppkey``). The rule is also written in SQL for
the DuckDB oracle (``tidemark.plans.sql_fixtures``); both must stay equal.

Plan: lineitem is hash partitioned by order key once; the ``lag`` window and
the per-order aggregation reuse that partitioning, and the join to ``orders``
shuffles only the small orders projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.code import with_renamed
from tidemark.sources.tables import table

VARIANTS = ("rename", "drop", "comment", "fence")


def _lang(key) -> F.Column:
    return F.when(key % 3 == 0, "Python").when(key % 3 == 1, "Java").otherwise("C++")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax"
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    target = F.concat(F.lit("q"), (F.col("l_partkey") % 7).cast("string"))
    factor = F.col("l_quantity").cast("bigint").cast("string")
    operand = F.coalesce(F.lag(target).over(w), F.lit("base"))
    py = F.col("l_orderkey") % 3 == 0
    stmt = F.when(py, F.concat(target, F.lit(" = "), factor, F.lit(" * "), operand)).otherwise(
        F.concat(F.lit("  int "), target, F.lit(" = "), factor, F.lit(" * "), operand, F.lit(";"))
    )
    comment = F.when(
        F.col("l_returnflag") == "R",
        F.concat(F.when(py, F.lit("# sup ")).otherwise(F.lit("  // sup ")), F.col("l_suppkey").cast("string")),
    )
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.row_number().over(w).alias("ord"),
        stmt.alias("stmt"),
        F.when(comment.isNull(), stmt).otherwise(F.concat(comment, F.lit("\n"), stmt)).alias("line"),
        F.col("l_suppkey").cast("string").alias("t_input"),
        factor.alias("t_expected"),
        "l_discount", "l_tax",
    )


def actual_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded program runs, one per sample test: ``id, test_no, stdout, status``.

    Derived from the line items: the run prints the expected value padded with
    whitespace, one more when the discount exceeds 0.08, and fails (status 1)
    when the tax is zero.
    """
    lines = code_lines(spark, sf_dir)
    value = F.when(F.col("l_discount") > 0.08, F.col("t_expected").cast("bigint") + 1).otherwise(F.col("t_expected").cast("bigint"))
    return lines.select(
        "id", F.col("ord").cast("bigint").alias("test_no"),
        F.concat(F.lit("  "), value.cast("string"), F.lit("\n")).alias("stdout"),
        F.when(F.col("l_tax") == 0, 1).otherwise(0).alias("status"),
    )


def _wrap(key, body) -> F.Column:
    py = F.concat(F.lit('"""order '), key.cast("string"), F.lit('"""\n'), body)
    java = F.concat(F.lit("int f(int base) {\n"), body, F.lit("\n}"))
    cpp = F.concat(F.lit("int main() {\n  int base = 1;\n"), body, F.lit("\n}"))
    return F.when(key % 3 == 0, py).when(key % 3 == 1, java).otherwise(cpp)


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, filename, type, grade, code, test_case`` plus the variant bodies ``code_drop``, ``code_nocomment``."""
    lines = code_lines(spark, sf_dir)
    parts = F.array_sort(F.collect_list(F.struct("ord", "line", "stmt", "t_input", "t_expected")))
    per = lines.groupBy("id").agg(parts.alias("p"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = per.join(orders, per.id == orders.o_orderkey)
    key = F.col("id")
    body = F.array_join(F.transform("p", lambda x: x["line"]), "\n")
    body_drop = F.array_join(F.transform(F.filter("p", lambda x: x["ord"] % 3 != 0), lambda x: x["line"]), "\n")
    body_plain = F.array_join(F.transform("p", lambda x: x["stmt"]), "\n")
    lang_lower = F.when(key % 3 == 0, "python").when(key % 3 == 1, "java").otherwise("cpp")
    split = F.when(key % 5 == 3, "test").when(key % 5 == 4, "valid").otherwise("train")
    fine = F.col("o_orderstatus") == "F"
    tests = F.transform("p", lambda x: F.struct(x["t_input"].alias("input"), x["t_expected"].alias("expected")))
    return j.select(
        key.alias("id"),
        F.concat(lang_lower, F.lit("_"), split, F.lit("_"), (key % 4).cast("string"), F.lit(".jsonl")).alias("filename"),
        F.when((key % 3 == 1) & (key % 9 == 4), F.lit(None).cast("string")).otherwise(_lang(key)).alias("type"),
        F.when(fine, "fine").otherwise("coarse").alias("grade"),
        _wrap(key, body).alias("code"),
        F.when(fine, tests).alias("test_case"),
        _wrap(key, body_drop).alias("code_drop"),
        _wrap(key, body_plain).alias("code_nocomment"),
    )


def _variant_columns(corpus: DataFrame, variants) -> tuple[DataFrame, dict]:
    """(corpus with what the variants need, one text expression per variant): narrow, one row per program."""
    staged = corpus.withColumn("_lang", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Java")))
    if "rename" in variants:
        staged = with_renamed(staged, "code", "id", "_lang", "_renamed")
    lang = F.col("_lang")
    tag = F.when(lang == "Python", "python").when(lang == "Java", "java").otherwise("cpp")
    return staged, {
        "rename": F.col("_renamed"),
        "drop": F.col("code_drop"),
        "comment": F.col("code_nocomment"),
        "fence": F.concat(F.lit("### Response:\n```"), tag, F.lit("\n"), F.col("code"), F.lit("\n```")),
    }


def variant_texts(corpus: DataFrame, variants) -> DataFrame:
    """The corpus with ``texts``: the program first, then the named variants in order; one row per program.

    The array comes out of an explode of one element: a later filter on it
    would otherwise be pushed below and re-run the renaming in every condition.
    """
    staged, build = _variant_columns(corpus, variants)
    return staged.withColumn("texts", F.explode(F.array(F.array("code", *[build[v] for v in variants]))))


def code_variants(corpus: DataFrame, variants=VARIANTS, carry=()) -> DataFrame:
    """Long form ``id, variant, text`` (and the ``carry`` columns): one row per perturbation.

    Only the requested ``variants`` are built (Catalyst cannot prune elements
    of the exploded array, so an unused rename would still be computed).
    """
    staged, build = _variant_columns(corpus, variants)
    arr = F.array(*[F.struct(F.lit(v).alias("variant"), build[v].alias("text")) for v in VARIANTS if v in variants])
    return staged.select("id", *carry, F.explode(arr).alias("v")).select("id", *carry, "v.variant", "v.text")
