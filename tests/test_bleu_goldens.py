"""Published BLEU examples (sentence, corpus, precision, brevity, smoothing) as goldens."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bleu_formulas as BF
from tidemark.operators import bleu as B

H1 = "It is a guide to action which ensures that the military always obeys the commands of the party".split()
H2 = "It is to insure the troops forever hearing the activity guidebook that party direct".split()
R1 = "It is a guide to action that ensures that the military will forever heed Party commands".split()
R2 = "It is the guiding principle which guarantees the military forces always being under the command of the Party".split()
R3 = "It is the practical guide for the army always to heed the directions of the party".split()
H3 = "he read the book because he was interested in world history".split()
R3A = "he was interested in world history because he read the book".split()

SCHEMA = "pair_id long, hyp array<string>, refs array<array<string>>"


def starts(x, published):
    """Published doctest values end in an ellipsis: compare the printed prefix."""
    digits = len(published.split(".")[1])
    return abs(int(x * 10**digits) - int(round(float(published) * 10**digits))) == 0


def pairs(spark, rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], SCHEMA)


def one(df, col="bleu"):
    return df.orderBy("pair_id").collect()[0][col] if "pair_id" in df.columns else df.collect()[0][col]


def test_sentence_bleu_three_refs(spark):
    df = B.sentence_bleu(pairs(spark, [(H1, [R1, R2, R3])]), sep=" ")
    assert starts(one(df), "0.5045")


def test_sentence_bleu_weak_method1(spark):
    df = B.sentence_bleu(pairs(spark, [(H2, [R1, R2, R3])]), sep=" ")
    assert starts(one(df), "0.0370")


def test_bleu5(spark):
    df = B.sentence_bleu(pairs(spark, [(H1, [R1, R2, R3])]), weights=(0.2,) * 5, sep=" ")
    assert starts(one(df), "0.3920")


def test_corpus_bleu(spark):
    df = B.corpus_bleu(pairs(spark, [(H1, [R1, R2, R3]), (H3, [R3A])]), sep=" ")
    assert starts(df.collect()[0]["bleu"], "0.5920")


def test_mean_of_sentences(spark):
    df = B.sentence_bleu(pairs(spark, [(H1, [R1, R2, R3]), (H3, [R3A])]), sep=" ")
    assert starts(df.agg(F.avg("bleu")).collect()[0][0], "0.6223")


def test_modified_precision(spark):
    the = pairs(spark, [("the the the the the the the".split(),
                         ["the cat is on the mat".split(), "there is a cat on the mat".split()])])
    st = B.order_stats(the, max_n=1, sep=" ").collect()[0]
    assert starts(st["num"] / st["den"], "0.2857")
    df = pairs(spark, [(H1, [R1, R2, R3]), (H2, [R1, R2, R3])])
    got = {(r["pair_id"], r["n"]): r["num"] / r["den"] for r in B.order_stats(df, max_n=2, sep=" ").collect()}
    assert starts(got[(0, 1)], "0.9444")
    assert starts(got[(1, 1)], "0.5714")
    assert got[(0, 2)] == 0.5882352941176471
    assert starts(got[(1, 2)], "0.07692")


@pytest.mark.parametrize("hyp,refs,expected", [
    (12, [12, 15, 17], "1.0"), (12, [28, 28], "0.263597"), (12, [13, 2], "0.9200"),
    (12, [13, 11], "1.0"), (12, [11, 13], "1.0"), (7, [11, 8], "0.8668"), (7, [11, 8, 6, 7], "1.0"),
])
def test_brevity(spark, hyp, refs, expected):
    df = pairs(spark, [(["a"] * hyp, [["a"] * r for r in refs])])
    assert starts(B.brevity(df).collect()[0]["bp"], expected)


@pytest.mark.parametrize("method,expected", [
    (0, "0.4118"), (1, "0.4118"), (2, "0.4489"), (3, "0.4118"), (4, "0.4118"), (5, "0.4905"), (6, "0.4135"),
    (7, "0.4905"),
])
def test_smoothing(spark, method, expected):
    df = pairs(spark, [(H1, [R1])])
    got = {r["method"]: r["bleu"] for r in B.smoothing_table(df, sep=" ").collect()}
    assert starts(got[method], expected)


def test_one_line_against_itself(spark):
    df = pairs(spark, [(["only line"], [["only line"]])])
    assert one(B.sentence_bleu(df)) == pytest.approx(0.177828, abs=1e-6)


def test_short_pair_full_grid(spark):
    df = pairs(spark, [(["a", "b"], [["a", "b"]])])
    rows = B.order_stats(df, max_n=4).orderBy("n").collect()
    assert [(r["num"], r["den"]) for r in rows] == [(2, 2), (1, 1), (0, 1), (0, 1)]
