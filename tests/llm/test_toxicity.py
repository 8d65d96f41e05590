import pickle
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity
from tidemark.llm.common import labels
from tidemark.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.1"
COUNTS = st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.lists(COUNTS, min_size=1, max_size=40), COUNTS, st.integers(1, 6), st.integers(1, 8))
def test_block_max_search_is_exact(examples, query, k, block):
    idf = np.linspace(1.0, 3.0, 10)
    vectors = [toxicity.unit(c, idf) for c in examples]
    index = toxicity.BlockMaxIndex(vectors, [0] * len(vectors), list(range(len(vectors))), 10, block)
    q = toxicity.unit(query, idf)
    at, cosine = index.nearest(q, k)
    brute = sorted((-round(sum(w * vectors[i].get(t, 0.0) for t, w in q.items()), 9), n)
                   for n, i in enumerate(index.ids))
    want = [(n, -c) for c, n in brute if c < 0][:k]
    assert [c for _, c in want] == [round(float(c), 9) for c in cosine] or np.allclose([c for _, c in want], cosine, atol=2e-9)
    assert len(at) == len(want)


def test_held_out_recall_and_clean_documents(spark):
    out = QUERIES["op6_toxicity"](spark, SF1)
    held = out.where("held_out").join(labels(spark, SF1), "doc_id").collect()
    toxic = [r for r in held if r.toxic == 1]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    assert sum(r.predicted for r in clean) / len(clean) < 0.05
    assert any(r.evidence for r in toxic)


def test_odd_rows_and_empty_table(odd, none_left, odd_labels):
    out = toxicity.score_toxicity(odd, odd_labels).collect()
    assert len(out) == odd.count() and all(0.0 <= r.score <= 1.0 for r in out)
    assert toxicity.score_toxicity(none_left, odd_labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, odd_labels.where("doc_id < 0")).collect()} == {0.0}
    kept = toxicity.reject_toxic(odd, odd_labels.where("doc_id < 0"))
    assert kept.columns == odd.columns and kept.count() == odd.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(COUNTS, min_size=1, max_size=40), st.lists(COUNTS, min_size=1, max_size=5), st.integers(1, 6),
       st.integers(1, 8), st.integers(0, 10))
def test_blocks_and_postings_together_are_exact(examples, queries, k, block, head):
    weight = np.linspace(0.1, 3.0, 10)
    vectors = [toxicity.unit(c, weight) for c in examples]
    index = toxicity.BlockMaxIndex(vectors, [0] * len(vectors), list(range(len(vectors))), 10, block, head, 1)
    for q, (_, cosine) in zip(queries, index.search([toxicity.unit(q, weight) for q in queries], k), strict=True):
        q = toxicity.unit(q, weight)
        want = sorted((sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors), reverse=True)[:k]
        assert np.allclose([c for c in want if c > 1e-9], cosine[cosine > 1e-9], atol=2e-9)


def test_rare_toxic_wording_and_copies_of_labelled_texts_are_found(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]

    def prose(*more):
        return " ".join(rng.permutation([*rng.choice(words, 40), *more]).tolist())

    # toxic: 400 texts with a common mark, 8 with a rare one (under 3%), 4 whose words are all plain
    texts = [prose("qqcommon") for _ in range(400)] + [prose("zzrare") for _ in range(8)] + [prose() for _ in range(4)]
    clean = [prose() for _ in range(800)]
    rows = [(i, t, int(i < len(texts))) for i, t in enumerate(texts + clean)]
    new = [(5000, prose("zzrare")), (5001, texts[-1]), (5002, texts[-1].upper()), (5003, prose())]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + new, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, folds=2, held_out=9).collect()}
    assert [out[i].predicted for i in (5000, 5001, 5002, 5003)] == [1, 1, 1, 0]
    assert out[5001].evidence[0] == len(texts) - 1
    assert all(out[i].predicted for i in range(len(texts)))


def test_openings_that_words_share_are_looked_up_once(monkeypatch):
    digest, asked = toxicity.xxhash.xxh64_intdigest, []
    words = [b"running", b"runner", b"runnable", "rünning".encode(), "rünner".encode(), b"run", b"other"]
    hashes = sorted({h for w in words[:-1] for h in toxicity.term_hashes(w)})
    lookup = toxicity.Lookup(np.array(hashes), {w[:4] for w in words})
    want = [sorted(hashes.index(h) for h in toxicity.term_hashes(w) if h in hashes) for w in words]
    monkeypatch.setattr(toxicity.xxhash, "xxh64_intdigest", lambda b: asked.append(b) or digest(b))
    text, term, n = lookup.counts([w.decode() for w in words])
    assert [term[text == i].tolist() for i in range(len(words))] == want and set(n.tolist()) == {1}
    assert len(asked) == len(set(asked))


def test_lookup_keeps_no_words_between_calls():
    words = [f"{a}{b}word" for a in map(chr, range(97, 123)) for b in ("ab", "cd", "ef", "gh")]
    words = [a + b for a in words for b in words]
    lookup = toxicity.Lookup(np.array(sorted(h for w in words[:5000] for h in toxicity.term_hashes(w.encode())[:1])), set())
    lookup.counts(words[:10])
    tracemalloc.start()
    try:
        n = sum(len(lookup.counts(words[at:at + 500])[0]) for at in range(0, len(words), 500))
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert n == 5000 and kept < 100_000 and most < 1_000_000


def test_postings_stay_small_after_blocks_are_made():
    rng = np.random.default_rng(1)
    vectors = [(t, np.full(len(t), 0.2)) for t in (np.unique(rng.integers(0, 2000, 50)) for _ in range(1500))]
    index = toxicity.BlockMaxIndex(vectors, [0] * len(vectors), list(range(len(vectors))), 2000)
    sent = pickle.loads(pickle.dumps(index))
    assert [c.tolist() for _, c in sent.search(vectors[:70])] == [c.tolist() for _, c in index.search(vectors[:70])]
    assert sent.example.itemsize == 2


def test_scores_do_not_depend_on_how_texts_are_portioned(spark, monkeypatch):
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{'xy'[i % 2]}abc" for k in range(1, 30))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, ""), (62, "12 34")], "doc_id long, text string")
    marked = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marked, 2, 9)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "PORTION", 200)
    assert model.scores(texts) == whole
    out = toxicity.score_toxicity(docs, marked, 2, 9).orderBy("doc_id").collect()
    assert [(r.score, r.evidence) for r in out] == whole
