import pytest
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tidemark.llm import cutting, packing
from tidemark.llm.common import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
ALPHABET = st.sampled_from(["a", "B", " ", "\n", " ", "'", "'ll", "It's", "1", "é", "É", "é", "日", "<|endoftext|>",
                            "<|ENDOFTEXT|>", "<|", ".", ",;", "_", "\x1c", "\x85", "Σ", "ΑΣ", "İ", "²", "ß", "word.", "x.y"])


def library(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_word_by_word_ids_equal_the_library(text):
    assert np.frombuffer(packing.encode_words(PATH, [text])[0], "<u4").tolist() == library(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 200), min_size=1, max_size=12))
def test_patterns_fit_and_never_take_too_much(histogram):
    size = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in size.tolist()])
    patterns, amount = cutting.solve(size, demand, 30)
    assert (patterns @ size <= 30).all()
    assert np.allclose(patterns.T @ amount, demand, atol=1e-4)
    lower = (size @ demand) / 30
    assert lower - 1e-6 <= amount.sum() <= demand.sum() + 1e-6
    patterns, times = cutting.whole_patterns(size, demand, 30)
    assert ((patterns * times[:, None]).sum(axis=0) <= demand).all()


def test_linear_program_reaches_the_known_optimum():
    # a textbook instance: width 100, 45/36/31/14 wanted 97/610/395/211 times; optimum 452.25
    size, demand = np.array([14, 31, 36, 45]), np.array([211, 395, 610, 97])
    _, amount = cutting.solve(size, demand, 100, gap=1e-9)
    assert abs(amount.sum() - 452.25) < 1e-6


def check(docs, out, capacity, most_padding):
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(library(r.text) + [2])
    rows = out.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc_id, texts in ids.items():
        want = defaultdict(int)
        for t in texts:
            for i in range(len(t)):
                want[(len(t), i)] += 1
        for r in pieces[doc_id]:
            for i in range(r.start, r.start + r.length):
                want[(r.doc_tokens, i)] -= 1
            crcs = {zlib.crc32(np.array(t[r.start:r.start + r.length], "<u4").tobytes()) for t in texts
                    if len(t) == r.doc_tokens}
            assert r.ids_crc32 in crcs
        assert not any(want.values())
    used = [sum(n for _, n in p) for p in sequences.values()]
    padded = sum(0 if n & (n - 1) == 0 else capacity - n for n in used)
    assert padded <= most_padding * max(sum(used), 1)


def test_whole_fixture_with_little_padding(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    check(docs, packing.pack(docs, PATH), 4096, 0.01)


def test_odd_rows_and_empty_table(odd, none_left):
    check(odd, packing.pack(odd, PATH, capacity=64, exact=16), 64, 0.2)
    check(odd.unionByName(odd), packing.pack(odd.unionByName(odd), PATH, capacity=4096), 4096, 0.05)
    assert packing.pack(none_left, PATH).count() == 0


@pytest.mark.parametrize("words,most", [(2, 0.05), (8, 0.05), (16, 0.05), (300, 0.05)])
def test_little_padding_for_texts_of_one_length(spark, words, most):
    docs = spark.range(6000 if words < 100 else 2000).select(F.col("id").alias("doc_id"), F.lit(" ".join(["the"] * words)).alias("text"))
    rows = packing.pack(docs, PATH).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    used, padded = sum(r["n"] for r in rows), sum(4096 for r in rows if r["n"] & (r["n"] - 1))
    full = sum(r["n"] for r in rows if not r["n"] & (r["n"] - 1))
    assert used == docs.count() * (words + 1)
    assert (padded + full - used) / used < most


def test_length_classes(spark):
    rows = spark.range(1, 4097).select("id", packing.length_class(F.col("id"), 4096).alias("c")).collect()
    assert all(r["c"] == r["id"] for r in rows if r["id"] <= 128)
    assert all(r["id"] <= r["c"] <= r["id"] * (1 + 1 / 64) + 1 for r in rows)
    assert len({r["c"] for r in rows}) == 128 + 5 * 64


def test_knapsack_prices_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = np.unique(rng.integers(1, 12, 5))
        value = np.round(rng.random(len(size)), 3)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(size.tolist(), value.tolist(), strict=True) if s <= c])
        got, pattern = cutting.price(value, size, 30)
        assert abs(got - best[30]) < 1e-9 and pattern @ size <= 30 and abs(pattern @ value - got) < 1e-9


def test_small_and_odd_histograms_are_solved():
    rng = np.random.default_rng(8)
    for k in range(60):
        size = np.unique(rng.integers(1, 4097, int(rng.integers(1, 250))))
        demand = rng.integers(1, int(rng.choice([2, 5, 2000])), len(size))
        patterns, times = cutting.whole_patterns(size, demand, 4096)
        assert (patterns @ size <= 4096).all() and ((patterns * times[:, None]).sum(axis=0) <= demand).all()
        left = demand - (patterns * times[:, None]).sum(axis=0) if len(patterns) else demand
        assert left @ size <= 4096 * (len(size) + 1)
