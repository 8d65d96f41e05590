"""Cheaper expressions with the same results: fenced blocks, renaming, the round trip and the rounds of attempts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidemark.functions.code import WORD_RUNS, with_renamed
from tidemark.functions.text import py_strip
from tidemark.operators import perturb as P
from tidemark.plans import records
from tidemark.plans.perturb import roundtrip_resolve

SF001 = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _by_pattern(text):
    """All fenced blocks by the pattern itself."""
    groups = [F.regexp_extract_all(text, F.lit(P.FENCED), F.lit(k)) for k in (1, 2)]
    picked = F.zip_with(*groups, lambda a, b: py_strip(F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.coalesce(b, F.lit("")))))
    return F.filter(picked, lambda x: x != "")


def test_blocks_between_fences_are_those_of_the_pattern(spark):
    rng = random.Random(7)
    bits = ["```", "``", "`", "\n", "a", "py\n", "B", "1", " ", "\t", "x = 1", "é", "\x00", "\r"]
    texts = [None, "", "```", "``````", "```a\n```", "````a````", "```\n\n```b```"] + [
        "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", P.fenced_blocks("t").alias("a"), _by_pattern(F.col("t")).alias("b"))
    assert [r.t for r in out.collect() if r.a != r.b] == []
    assert "[\\s\\S]" not in _plan(df.select(P.fenced_blocks("t")))  # the lazy groups cost more than all else


def test_round_trip_makes_blocks_and_names_once(spark):
    plan = _plan(roundtrip_resolve(spark, SF001))
    assert "[\\s\\S]" not in plan
    assert plan.count(", 1, 5), 0123456789abcdef") == 1  # the short new names
    assert WORD_RUNS not in plan


def test_renamed_texts_keep_gaps_at_both_ends(spark):
    rows = [(1, " x=1 "), (2, "x=1"), (3, "\n=="), (4, ""), (5, None), (None, "x=1"), (6, "é x = x\x00é")]
    out = with_renamed(spark.createDataFrame([(i, c, "Python") for i, c in rows], "id long, code string, lang string"))
    got = {r.code: r.renamed for r in out.where("id is not null").collect()}
    assert out.where("id is null").first().renamed is None or "=1" in out.where("id is null").first().renamed
    assert got["\n=="] == "\n==" and got[""] == "" and got[None] is None
    assert re.fullmatch(r" [a-p]{5}=1 ", got[" x=1 "]) and re.fullmatch(r"[a-p]{5}=1", got["x=1"])
    assert re.fullmatch(r"é ([a-p]{5}) = \1\x00é", got["é x = x\x00é"])


def test_rounds_read_the_recorded_runs_once(spark, monkeypatch):
    calls = []
    made = records.actual_outputs
    monkeypatch.setattr(records, "actual_outputs", lambda *a: calls.append(a) or made(*a))
    gated = []
    gate = records.with_gate
    monkeypatch.setattr(records, "with_gate", lambda df, col: gated.append((df, col)) or gate(df, col))
    out = records.attempts_by_rounds(spark, SF001)
    assert len(calls) == 1 and out.select("id").distinct().count() == out.count() > 0
    assert len(gated) == records.ROUNDS
    for df, col in gated:  # records with tests pass by their tests, so the gate sees nothing of them
        assert df.where(F.col("grade") == "fine").where(F.col(col).isNotNull()).isEmpty()
        assert not df.where(F.col("grade") != "fine").where(F.col(col).isNotNull()).isEmpty()
