import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def naive(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_equals_the_definition():
    for t in (None, "", " ", "one", "One two", "a b c", "a b c d e", "A\x0bB\x1cC é É d", "x " * 5000 + "y"):
        assert int(simhash.fingerprint(t)) == naive(t)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_pairs_equal_brute_force(budget):
    rng = np.random.default_rng(budget)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    bits = [int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for c in centres for _ in range(40)]
    rows = sorted({(int(rng.integers(0, 3)), b) for b in bits})
    group, bits = np.array([g for g, _ in rows]), np.array([b for _, b in rows], np.uint64)
    got = sorted((int(min(a, b)), int(max(a, b))) for i, j in simhash.trie_pairs(group, bits, budget)
                 for a, b in zip(i, j, strict=True))
    want = [(i, j) for i, j in combinations(range(len(rows)), 2)
            if rows[i][0] == rows[j][0] and (rows[i][1] ^ rows[j][1]).bit_count() <= budget]
    assert got == want


@pytest.mark.parametrize("max_node", [4, 20_000])
def test_links_lose_none(spark, max_node):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 3))) for c in centres
                  for _ in range(20)} | {0, 1, 2**63, 2**64 - 1})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in
           simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, max_node).collect()}
    assert got == {(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2}


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert {n: got.get(n, n) for n in want} == want


def test_query_equals_brute_force(spark):
    from tidemark.llm.common import documents
    docs = documents(spark, "/root/testdata/sf0.01")
    check(docs, simhash.near_duplicates(docs).collect())


def check(docs, rows):
    fps = {}
    for r in docs.collect():
        fps.setdefault(naive(r.text), []).append(r.doc_id)
    every = sorted(fps)
    root = union_find(every, [(a, b) for a, b in combinations(every, 2) if (a ^ b).bit_count() <= 2])
    first = {}
    for f in every:
        ids = [i for i in fps[f] if i is not None] + ([first[root[f]]] if first.get(root[f]) is not None else [])
        first[root[f]] = min(ids, default=None)
    want = sorted(str((i, f"{f:016x}", first[root[f]])) for f in every for i in fps[f])
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in rows) == want


def test_odd_rows_and_empty_table(odd, none_left):
    check(odd, simhash.near_duplicates(odd, max_node=2).collect())
    assert simhash.near_duplicates(none_left).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r.component_id for r in simhash.near_duplicates(odd).collect()})


def test_keep_one_takes_one_row_of_every_component(spark):
    a = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(None, "null id and a first text of its own"), (None, "another text that has no id either"),
            (None, "a third one, unlike both of the others"), (None, "a third one, unlike both of the others"),
            (1, a), (7, a.upper()), (7, "id seven comes again with a text that no other row has"),
            (None, a), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(str(tuple(r)) for r in simhash.keep_one(docs).collect())
    assert kept == sorted(str(r) for r in [*rows[:3], rows[4], rows[6], rows[8]])
