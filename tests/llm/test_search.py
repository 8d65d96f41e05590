import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, top=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for q, want in asked.items():
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in want.items() if t in c)
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, k + 1, i, s) for k, (s, i) in enumerate(scored[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(500)] + ["Été", "日本", "A1b2"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(n)]
    docs += [(n + i, docs[7][1] + " rare passage here") for i in range(60)]  # more equal scores than ranks
    items = [(k, " ".join(rng.choices(vocab, k=12)) + (" rare passage" if k % 5 == 0 else "")) for k in range(15)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert got(search.ranked_search(d, q)) == brute(docs, items)


def test_query_blocks_and_few_first_documents(spark):
    docs, items = corpus(3, 200)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(search.ranked_search(d, q, top=5, first=2, block=6)) == brute(docs, items, 5)


def test_bounds_are_never_below_scores(spark):
    rng = random.Random(5)
    vocab = [b"t%d" % i for i in range(80)]
    counts = [Counter(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(37)]
    block = search._Block(6)
    for i, c in enumerate(counts):
        block.ids.append(i)
        block.digests.append(i)
        block.lengths.append(sum(c.values()))
        block.entries.append(search.signature_entries(c))
    import pyarrow as pa
    row = block.row(pa.int64())
    (_, _, lengths, rows), = search._blocks([row])
    df = Counter(t for c in counts for t in c)
    queries = search.Queries([0, 1], [{t: 1 for t in vocab[:30]}, {vocab[3]: 2, b"unknown": 1}], dict(df), 37, int(lengths.sum()))
    bounds = queries.bounds(rows, lengths)
    exact = np.array([queries.scores(b" ".join(c.elements()), [0, 1]) for c in counts]).T
    assert (bounds >= exact).all()
    assert ((bounds > 0) & (exact == 0)).mean() < 0.2


def test_odd_rows_and_empty_tables(spark, odd, none_left):
    items = [(1, "the cat mat"), (1, "time"), (2, None), (3, ""), (None, "abc x"), (4, "日本語テキスト ÉTÉ"), (5, "nowhere")]
    q = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(search.ranked_search(odd, q)) == brute(rows, items)
    assert got(search.ranked_search(none_left, q)) == []
    assert got(search.ranked_search(odd, q.where("item_id = 99"))) == []


def test_widest_signature_still_exact(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_CLASS", 3)
    docs, items = corpus(6, 100)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(search.ranked_search(d, q)) == brute(docs, items)
