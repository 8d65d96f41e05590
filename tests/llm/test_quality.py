import numpy as np

from tidemark.llm import knn_quality
from tidemark.llm.common import labels
from tidemark.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def test_lookup_counts_what_terms_says(monkeypatch):
    monkeypatch.setattr(knn_quality.Lookup, "MEMO", 3)
    texts = ["The cat, the CAT! don't 12% été É\n\nthe cat", "", None, "x", "  \n ", "a%% a%% (b) --- _x_ AbC a\tb"]
    names = sorted({t for x in texts for t in knn_quality.terms(x)})[::2]
    lookup = knn_quality.Lookup(names)
    for x in texts * 2:
        at, n = lookup.counts(x)
        assert {names[i]: c for i, c in zip(at, n, strict=True)} == {t: c for t, c in knn_quality.terms(x).items() if t in names}


def test_vote_equals_brute_force():
    rng = np.random.default_rng(1)
    space = knn_quality.Space(["wa", "sA", "ru9"], np.ones(3))
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    space.examples = unit(rng.normal(size=(200, 5)))
    space.labels = rng.integers(0, 2, 200).astype(np.float32)
    y = unit(rng.normal(size=(40, 5)))
    got = space.vote(y, 0.5, k=7)
    for i in range(len(y)):
        cosine = [round(float(c), 6) for c in (y[i:i + 1] @ space.examples.T)[0].astype(np.float64)]
        near = sorted(range(200), key=lambda j: (-cosine[j], j))[:7]
        w = [max(cosine[j], 0.0) ** knn_quality.SHARPNESS for j in near]
        assert abs(got[i] - sum(a * float(space.labels[j]) for a, j in zip(w, near, strict=True)) / sum(w)) < 1e-5


def test_held_out_accuracy(spark):
    out = QUERIES["op5_knn_quality"](spark, SF01)
    held = out.where("held_out").join(labels(spark, SF01), "doc_id").collect()
    right = sum(r.predicted == r.quality for r in held)
    assert len(held) > 50 and right / len(held) > 0.93
    caught = [r.predicted == 0 for r in held if r.quality == 0]
    assert sum(caught) / len(caught) > 0.7


def test_odd_rows_and_empty_table(odd, none_left, odd_labels):
    out = knn_quality.score_quality(odd, odd_labels).collect()
    assert len(out) == odd.count() and all(0.0 <= r.score <= 1.0 for r in out)
    assert knn_quality.score_quality(none_left, odd_labels).count() == 0
    nothing = knn_quality.score_quality(odd, odd_labels.where("doc_id < 0")).collect()
    assert {r.score for r in nothing} == {0.0}
