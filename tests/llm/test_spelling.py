import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, modulus=97, least=3):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= least}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))

    out = {}
    for w in n:
        found = [v for v in n if v != w and near(v, w)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, n[w], len(found), n[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def got(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in rows}
    assert len(found) == len(rows)
    return found


def words_docs(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀéz") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base += ["x" * k for k in range(5, 9)] + ["hello", "hallo", "helloo", "ello", "hellow", "hello" * 8, "hello" * 8 + "h", "Hello" * 8 + "hi",
                                               "jello" + "hello" * 8, "hellp" + "hello" * 7, "q" * 500, "q" * 501, "q" * 250 + "r" + "q" * 250]
    return [(i if i % 7 else None, " ".join(rng.choices(base, weights=range(1, len(base) + 1), k=60)) + "1;_é.") for i in range(40)]


@pytest.mark.parametrize("seed,modulus", [(1, 97), (2, 3), (3, 1)])
def test_whole_result_equals_brute_force(spark, seed, modulus):
    rows = words_docs(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(spelling.spelling_groups(docs, modulus=modulus)) == brute(rows, modulus)


@pytest.mark.parametrize("long", [5, 8, 12])
def test_long_words_join_on_halves(spark, long):
    rows = words_docs(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_groups(docs, long=long)) == brute(rows)


def test_odd_rows_and_empty_table(odd, none_left):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(spelling.spelling_groups(odd)) == brute(rows)
    assert got(spelling.spelling_groups(none_left)) == {}


def test_chain_of_forms(spark):
    words = {"aaaaa": 2, "aaaab": 4, "aaabb": 8, "aabbb": 16, "abbbb": 32, "bbbbb": 64, "ccccc": 64}
    rows = [(1, " ".join(" ".join([w] * n) for w, n in words.items()))]
    found = got(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), modulus=10**12, min_count=2))
    assert {w: r[-1] for w, r in found.items()} == {**{w: "bbbbb" for w in words}, "ccccc": "ccccc"}
