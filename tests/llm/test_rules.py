import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def got(df):
    return sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
                  for r in df.collect())


def test_odd_rows_and_empty_table(odd, none_left):
    out = rules.apply_rules(odd)
    assert got(out) == sorted(str((r.doc_id, *brute(r.text))) for r in odd.collect())
    assert all(r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed) for r in out.collect())
    assert rules.apply_rules(none_left).count() == 0


def test_repeats_that_overlap(spark):
    texts = ["a " * n for n in range(0, 30)] + ["a b c d e f g h " * 3, "x a b c d e f g h y a b c d e f g h z",
                                                 " ".join(str(i) for i in range(100)) + " 5 6 7 8 9 10 11 12 13"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(rules.apply_rules(docs)) == sorted(str((i, *brute(t))) for i, t in enumerate(texts))


def test_order_changes_the_reason_but_not_the_verdict(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    based = rules.with_base(docs)
    verdicts = []
    for order in (rules.RULES, rules.RULES[::-1]):
        rows = based.select("doc_id", (F.col("base_failed") | rules.cascade(order).isNotNull()).alias("bad")).collect()
        verdicts.append(sorted((r.doc_id, r.bad) for r in rows))
    assert verdicts[0] == verdicts[1]
    assert any(b for _, b in verdicts[0]) and not all(b for _, b in verdicts[0])


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    never = rules.Rule("never", "length(whole) < 0")
    often = rules.Rule("often", "n_words >= 0")
    ordered = rules.order_rules(docs, (never, often), sample_rows=200)
    assert [r.name for r in ordered] == ["often", "never"]


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_are_ordered_by_what_is_left():
    # rule 0 rejects most, rule 1 hardly anything that rule 0 leaves, rule 2 little but cheaply
    outcomes = {(True, True, False): 50, (True, False, False): 10, (False, True, False): 1, (False, False, True): 5, (False, False, False): 100}
    assert rules.greedy_order([1.0, 1.0, 1.0], outcomes) == [0, 2, 1]
    assert rules.greedy_order([1.0, 1.0, 0.01], outcomes) == [2, 0, 1]
    assert rules.greedy_order([2.0, 1.0, 1.0], {}) == [1, 2, 0]
    assert rules.greedy_order([], {}) == []


def test_letterless_megabyte_token_is_linear(spark):
    text = "word " * 30 + "-" * 1_000_000
    df = rules.with_base(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rule = next(r for r in rules.RULES if r.name == "letters")
    assert df.select(F.expr(rule.rejects).alias("r")).first()["r"] is False
    began = time.perf_counter()
    df.select(F.expr(rule.rejects).alias("r")).first()
    assert time.perf_counter() - began < 5


def test_repeated_lines_fail_long_texts_only(spark):
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(words[i:i + 5]) for i in range(0, 60, 5)]
    twice = [x for k in range(0, 6) for x in (lines[k], "a b c")]  # short lines repeat, no window of 8 words does
    docs = [(1, "\n".join(lines + ["a b c", lines[0], "a b c"])), (2, "\n".join(twice)), (3, "\n".join(lines + lines[:1]))]
    out = {r["doc_id"]: r["rejected_by"] for r in rules.apply_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: None, 2: "duplicate_lines", 3: None}
