import math

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import langid
from tidemark.llm.common import documents
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF01 = "/root/testdata/sf0.01"


def every_segmentation(word, vocab, logp, lang):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), langid.MAX_PIECE) + 1):
        at = vocab.get(word[:k], -1)
        p = math.exp(logp[at, lang]) if at >= 0 else (math.exp(langid.UNKNOWN) if k == 1 else 0.0)
        if p:
            total += p * every_segmentation(word[k:], vocab, logp, lang)
    return total


def test_forward_sums_all_segmentations():
    vocab = langid.vocabulary(PATH)
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(vocab)), 2).T)
    words = ["▁the", "▁a", "▁cats", "▁été", "▁日本", "▁tionend"]
    got = langid.forward(words, vocab, logp)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(math.log(every_segmentation(w, vocab, logp, k)), rel=1e-9)


def test_expected_counts_are_the_gradient_of_the_forward_sum():
    vocab = langid.vocabulary(PATH)
    logp = np.log(np.random.default_rng(2).dirichlet(np.ones(len(vocab)), 1).T)
    words, times = ["▁the", "▁cats", "▁onion"], np.array([2.0, 1.0, 3.0])
    got = langid.expected_counts(words, times, vocab, logp)
    for piece in ("▁the", "on", "c", "at"):
        step = np.zeros_like(logp)
        step[vocab[piece]] = 1e-4
        rise = (langid.forward(words, vocab, logp + step) - langid.forward(words, vocab, logp - step))[:, 0] @ times
        assert got[vocab[piece]] == pytest.approx(rise / 2e-4, abs=1e-6)


def test_held_out_accuracy(spark):
    out = QUERIES["op2_language_id"](spark, SF01).where("held_out").join(
        documents(spark, SF01).where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in out)
    assert len(out) > 150 and right / len(out) > 0.97
    assert all(0.0 <= r.score <= 1.0 for r in out)


def test_odd_rows_and_empty_table(odd, none_left):
    out = langid.identify(odd, PATH).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    for i in (3, 4, 5):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[6].lang_pred in ("en", "fr", "de")
    assert langid.identify(none_left, PATH).count() == 0


def test_a_language_without_spaces_is_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        syllables = ("ka", "to", "mi", "ru") if i % 2 else ("sch", "ein", "und", "lich")
        rows.append((i, "".join(rng.choice(syllables, 200)), "xx" if i % 2 else "yy"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "yy") for r in out)


def test_training_spans_hold_every_letter():
    words = ["▁" + "a" * n for n in (1, 63, 64, 65, 200)]
    spans = list(langid.training_spans(words))
    assert "".join(spans) == "".join(words) and max(map(len, spans)) == langid.TRAIN_LETTERS
