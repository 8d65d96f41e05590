"""Numbering, samples, attempts, several references, null groups, rejects and appending runs against brute force and by hand."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators import bleu as B
from tidemark.operators import weighted as W
from tidemark.operators.attempts import attempt_rounds
from tidemark.operators.corpus import sequential_ids, uniform_sample
from tidemark.operators.report import score_histogram, score_report
from tidemark.sources import files as FS
from tidemark.streaming import append as A


# ------------------------------------------------------------ numbering (L3)
def test_rows_with_equal_and_null_keys_are_numbered_once(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(20)]), f"v{i}") for i in range(500)] + [(7, f"hot{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(7)
    out = sequential_ids(df, "k", ties=["v"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["k"], r["v"]) for r in sorted(out, key=lambda r: r["seq"])] == want
    assert sorted(r["seq"] for r in out) == list(range(len(rows)))


def test_numbering_keeps_clashing_columns_and_empty_frames(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "b", "y")], "k long, _key string, n string")
    assert {r["k"]: (r["seq"], r["_key"]) for r in sequential_ids(df, "k").collect()} == {1: (0, "b"), 2: (1, "a")}
    assert sequential_ids(df.where("k > 9"), "k").count() == 0


# ------------------------------------------------------------ samples
@pytest.mark.parametrize("n", [0, 1, 57, 999, 1500, 2999, 3000, 5000])
def test_sample_is_the_first_n_by_hash(spark, n):
    ids = random.Random(1).sample(range(10**9), 3000)
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, b string").repartition(5)
    got = [r["id"] for r in uniform_sample(df, n, "7", "id").collect()]
    assert sorted(got) == sorted(sorted(ids, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:n])


def test_sample_of_repeated_and_null_ids(spark):
    ids = [5] * 1000 + [None] * 300 + list(range(100, 140))
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    key = lambda i: hashlib.md5(f"7:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(ids, key=key)
    for n in (1, 20, 350, 800, 1339):
        got = Counter(r["id"] for r in uniform_sample(df, n, "7", "id").collect())
        assert got == Counter(order[:n])


# ------------------------------------------------------------ attempts
def test_attempts_go_on_until_the_gate_passes(spark):
    need = {1: 1, 2: 3, 3: 9, 4: 2, 5: None}  # the round in which a record's text passes; 5 is never attempted
    records = spark.createDataFrame([(k, v) for k, v in need.items()] + [(None, 1)], "id long, need int")
    asked = []

    def attempt(open_, k):
        asked.append({r["id"] for r in open_.collect()})
        return open_.where("need is not null").select("id", F.concat(F.lit(f"round {k} of "), F.col("need").cast("string")).alias("text"))

    def passes(tried):
        return tried.withColumn("usable", F.regexp_extract("text", "round ([0-9]+)", 1) == F.regexp_extract("text", "of ([0-9]+)", 1))

    done, left = attempt_rounds(records, attempt, passes, 4)
    assert {r["id"]: (r["attempt_no"], r["text"]) for r in done.collect()} == {
        1: (1, "round 1 of 1"), 2: (3, "round 3 of 3"), 4: (2, "round 2 of 2")}
    assert {r["id"]: (r["attempt_no"], r["text"]) for r in left.collect()} == {3: (4, "round 4 of 9"), 5: (None, None)}
    assert asked == [{1, 2, 3, 4, 5}, {2, 3, 4, 5}, {2, 3, 5}, {3, 5}]
    done, left = attempt_rounds(records.where("id > 99"), attempt, passes, 4)
    assert done.count() == left.count() == 0


# ------------------------------------------------------------ recall against several references
def brute_recall(hyp, refs, words, n):
    grams = lambda t: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    num = den = 0
    h = grams(hyp)
    for ref in refs:
        weight = (lambda g: 5 if g[0] in words else 1) if n == 1 else (lambda g: 5)
        r = grams(ref)
        num += sum(min(c, h[g]) * weight(g) for g, c in r.items())
        den += max(5, sum(c * weight(g) for g, c in r.items()))
    return num, den


def recall_pairs(seed):
    rng = random.Random(seed)
    words = ["for", "if", "return", "a", "b", "c", "d"]
    text = lambda lo, hi: [rng.choice(words) for _ in range(rng.randint(lo, hi))]
    return [(i, rng.choice(["Python", "Java", None]), text(0, 9), [text(0, 9) for _ in range(rng.randint(1, 4))]) for i in range(60)]


def test_recall_counts_of_references_add_up(spark):
    rows = recall_pairs(1)
    df = spark.createDataFrame(rows, "id long, lang string, hyp array<string>, refs array<array<string>>")
    kw = W.keyword_dim(spark)
    words = {"Python": {"for", "if", "return"}, "Java": {"for", "if", "return"}, None: set()}
    got = {(r["id"], r["n"]): (r["num5"], r["den5"]) for r in W.recall_counts(df, ["id"], "lang", "hyp", "refs", kw).collect()}
    assert got == {(i, n): brute_recall(h, rs, words[lang], n) for i, lang, h, rs in rows for n in range(1, 5)}


def test_weighted_corpus_sums_before_dividing_and_keeps_the_null_group(spark):
    rows = recall_pairs(2) + [(None, "Java", ["a"], [["a"]])]
    df = spark.createDataFrame(rows, "id long, lang string, hyp array<string>, refs array<array<string>>")
    out = {r["lang"]: r for r in W.weighted_corpus(df, ["lang"], ["id"], "lang", "hyp", "refs", W.keyword_dim(spark)).collect()}
    words = {"for", "if", "return"}
    for lang in ("Python", "Java", None):
        part = [r for r in rows if r[1] == lang and r[0] is not None]
        sums = [tuple(map(sum, zip(*(brute_recall(h, rs, words if lang else set(), n) for _, _, h, rs in part), strict=True))) for n in range(1, 5)]
        hyp = sum(len(h) for _, _, h, _ in part)
        ref = sum(min((abs(len(r) - len(h)), len(r)) for r in rs)[1] for _, _, h, rs in part)
        p = [((a if a else 0.1 * 5), d) for a, d in sums]  # method 1: 0.1 in place of no match
        score = math.exp(sum(0.25 * math.log(a / d) for a, d in p)) * (1 if hyp > ref else math.exp(1 - ref / hyp))
        assert (out[lang]["n_pairs"], out[lang]["hyp_len"], out[lang]["ref_len"]) == (len(part), hyp, ref)
        assert abs(out[lang]["score"] - score) < 1e-5


# ------------------------------------------------------------ null groups
def test_null_groups_are_groups_and_null_ids_no_pairs(spark):
    rows = [(1, None, ["a", "b"], [["a", "b"]]), (2, "en", ["a"], [["a", "c"]]), (3, None, ["x"], [["y"]]), (None, "en", ["a"], [["a"]])]
    df = spark.createDataFrame(rows, "pair_id long, lang string, hyp array<string>, refs array<array<string>>")
    corpus = {r["lang"]: (r["hyp_len"], r["ref_len"]) for r in B.corpus_bleu(df, ["lang"]).collect()}
    assert corpus == {None: (3, 3), "en": (1, 2)}
    scores = B.sentence_bleu(df, ["pair_id", "lang"])
    assert sorted((r["pair_id"], r["lang"]) for r in scores.collect()) == [(1, None), (2, "en"), (3, None)]
    assert {(r["lang"], r["grade_level"]): r["n"] for r in score_report(scores, ["lang"]).collect()} == {
        (None, 0): 2, ("en", 0): 1, (None, 1): 3}
    assert sum(r["n"] for r in score_histogram(scores, ["lang"]).collect() if r["lang"] is None) == 2


# ------------------------------------------------------------ rejects
def test_corpus_is_split_into_two_sinks(spark, tmp_path):
    lines = ['{"id": 1, "filename": "java_train_0.jsonl", "code": "x"}', '{"id": 2, "filename": "java_train_0.txt", "code": "x"}',
             '{"id": 3, "filename": "python_test_12.jsonl", "code": " "}', '{"id": 4, "filename": ', "", "null", "[1]",
             '{"id": 5, "code": "y"}', '{"id": "six", "filename": "java_valid_1.jsonl", "code": "z"}', '{"id": 7, "filename": "python_valid_1.jsonl", "code": "w"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    good, bad = f"{tmp_path}/out/good", f"{tmp_path}/out/bad"
    for _ in range(2):  # the sinks append
        FS.split_corpus(spark, f"{tmp_path}/in", good, bad)
    got = Counter((r["id"], r["lang"], r["split"]) for r in FS.read_sink(spark, good).collect())
    assert got == {(1, "Java", "train"): 2, (7, "Python", "valid"): 2}
    left = Counter((r["reason"], r["id"], r["raw"]) for r in FS.read_sink(spark, bad).collect())
    assert left[("no_language", 2, None)] == left[("no_code", 3, None)] == left[("no_language", 5, None)] == 2
    assert left[("malformed", None, lines[3])] == 2 and sum(left.values()) // 2 + 2 >= len(lines) - 1
    with pytest.raises(ValueError):
        FS.split_corpus(spark, f"{tmp_path}/in", good, f"{tmp_path}/elsewhere/bad")


# ------------------------------------------------------------ appending runs
def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    inbox, sink = f"{tmp_path}/in", f"{tmp_path}/sink"
    keep = lambda df: df
    failures = []

    def fail(batch_id):
        failures.append(batch_id)
        raise RuntimeError("lost")

    spark.range(10).coalesce(1).write.mode("append").parquet(inbox)
    A.append_available(spark, inbox, "id long", keep, sink)
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(inbox)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            A.append_available(spark, inbox, "id long", keep, sink, after_write=fail)
        assert sorted(r["id"] for r in A.committed(spark, sink).collect()) == list(range(10))
    A.append_available(spark, inbox, "id long", keep, sink)
    A.append_available(spark, inbox, "id long", keep, sink)
    assert sorted(r["id"] for r in A.committed(spark, sink).collect()) == list(range(15))
    assert {(r["batch_id"], r["n_rows"]) for r in A.manifest(spark, sink).collect()} == {(0, 10), (1, 5)} and failures == [1, 1]


def test_histogram_keys_are_sorted(spark):
    rows = [(g, x / 10) for g in ("b", None, "a") for x in (9, 1, 5, 1)]
    df = spark.createDataFrame(rows, "g string, bleu double").repartition(5)
    got = [(r["g"], r["bucket"]) for r in score_histogram(df, ["g"]).collect()]
    assert got == [(g, b) for g in (None, "a", "b") for b in (0.1, 0.5, 0.9)]
