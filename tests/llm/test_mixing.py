import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing
from tidemark.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Share, cap, reshare the excess by weight, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = float(sum(sizes.values())), list(names)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.remove(s)
    return target


def check(docs, rows):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(dict(sizes))
    taken, longest, counts = Counter(), Counter(), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert r.size == 0 or r.taken % r.size == 0
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        counts[r.source] += 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s]


def test_whole_fixture_near_targets(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mix_sources(docs).collect()
    check(docs, rows)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_odd_rows_and_empty_table(odd, none_left):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count()
    check(odd, rows)
    assert mixing.mix_sources(none_left).count() == 0
    assert mixing.apply_mix(none_left).count() == 0


def test_apply_emits_every_copy(odd):
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in mixing.mix_sources(odd).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert got == +want
