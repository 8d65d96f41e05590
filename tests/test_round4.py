"""Scale fixes: partitions follow what tasks make of their rows, grams are counted once, one pass over reaching definitions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions.text import word_tokens
from tidemark.operators import bleu as B
from tidemark.operators import dataflow as D
from tidemark.operators import reaching as R
from tidemark.operators import weighted as W
from tidemark.plans import codebleu as C
from tidemark.plans.flow import reaching_definitions

SF001 = "/root/testdata/sf0.001"

TEXTS = [
    (1, "Java", ["int a = b ; int a", "int a = c ; int a", "int", ""]),
    (2, "Python", ["", "for x in y", "x", "for for for x"]),
    (3, "Ruby", ["a b c d e", "a b c d e", None, "e d c b a a"]),
    (4, None, ["a b a b", "a b", "b", "a b a b a"]),
    (5, "Java", [None, "int a", "b", "c"]),
    (6, "Java", ["int a int a", "int a", "b", "c"]),
    (6, "Java", ["int a", "int a int b", "b b", "c"]),  # an id that comes twice
    (None, "Java", ["int a", "int a", "b", "c"]),
]


def _rows(spark):
    return spark.createDataFrame(TEXTS, "id long, lang string, texts array<string>")


def test_members_score_as_pairs_do(spark):
    rows, keywords = _rows(spark).repartition(3, "id"), W.keyword_dim(spark)
    pairs = C._pairs(rows).select("id", "member", "lang", word_tokens("text1").alias("hyp"), word_tokens("text2").alias("ref"))
    want = W.weighted_ngram(pairs, ["id", "member"], "lang", "hyp", "ref", keywords)
    got = C.weighted_scores(rows, keywords, 3).select("id", "member", "lang", "score")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(map(tuple, want.select("id", "member", "lang", "score").collect()), key=key)
    assert len(want) == 18
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_laid_partitions_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "LAID_BYTES", 10)
    rows = spark.range(200).select("id", F.lit("Java").alias("lang"), F.array(F.lit("x" * 30), F.lit(None), F.lit("y" * 20)).alias("texts"))
    assert C.lay(rows).rdd.getNumPartitions() == 1000


def test_gram_partitions_follow_the_grams(spark, monkeypatch):
    monkeypatch.setattr(B, "fanout_partitions", lambda df, factor: 37 if factor >= 64 else 1)
    docs = spark.createDataFrame([(1, ["a", "b"]), (None, ["a"])], "id long, toks array<string>")
    out = B.ngram_counts(docs, "id", "toks", 2)
    assert "hashpartitioning(id#" in (plan := out._jdf.queryExecution().toString()) and ", 37)" in plan
    assert sorted((r.id or 0, r.n, r.cnt) for r in out.collect()) == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 2, 1)]


def test_branch_words_are_found_as_by_the_pattern_alone(spark):
    texts = [None, "", "if", "x if y", "elif", "a.do(b)", "done", "whiles", "while(x)", "foreach x", "fors", "x\nfor\ny", "IF"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(D.branches("t").alias("a"), F.coalesce(F.col("t").rlike(R.BRANCH_PATTERN), F.lit(False)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a for r in rows) == 6


def test_reaching_definitions_joins_nothing(spark):
    plan = reaching_definitions(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_steps_over_levels_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 1)
    code = "int f(int base) {\nint a = 1;\nif (base > 0) {\nint a = 2;\n}\nint b = a;\n}"
    programs = spark.createDataFrame([(k, "Java", code) for k in range(4)], "id long, lang string, text string")
    out = D.merged_uses(D.token_table(programs, ["id"], "text", "lang", layout=True), ["id"])
    n = spark.conf.get("spark.sql.shuffle.partitions")
    counts = [int(x) for x in re.findall(r"RepartitionByExpression \[id#\d+L?\], (\d+)", out._jdf.queryExecution().toString())]
    assert max(counts) > int(n)
    assert {r.line: len(r.defs) for r in out.where("token = 'a' and is_use").collect()} == {5: 2}
