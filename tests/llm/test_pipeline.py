import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import documents, labels

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_run_equals_brute_force_stage_by_stage(spark):
    from test_mixing import brute_targets
    from test_simhash import naive, union_find

    raw = documents(spark, SF)
    docs = {r.doc_id: r for r in raw.collect()}
    bad = {r.doc_id for r in toxicity.score_toxicity(raw, labels(spark, SF)).where("predicted = 1").collect()}
    docs = {i: r for i, r in docs.items() if i not in bad}
    last = {}
    for i in sorted(docs):
        last[(docs[i].text or "").encode().lower()] = i
    docs = {i: docs[i] for i in last.values()}
    fps = {i: naive(docs[i].text) for i in docs}
    every = sorted(docs)
    root = union_find(every, [(a, b) for n, a in enumerate(every) for b in every[n + 1:] if (fps[a] ^ fps[b]).bit_count() <= 2])
    docs = {i: docs[i] for i in every if root[i] == i}
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    total = Counter()
    for i, r in docs.items():
        total[r.source] += size[i]
    target = brute_targets(dict(total))

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {i: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in docs.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    times, words = Counter(), Counter()
    for r in out:
        assert r.doc_id in docs and r.doc_tokens == length[r.doc_id]
        times[r.doc_id] += r.length
    for i, n in times.items():
        assert n % length[i] == 0 and 1 <= n // length[i] <= 3
        words[docs[i].source] += size[i] * (n // length[i])
    for s, t in target.items():
        assert abs(words[s] - t) <= 2 * max(size[i] for i in docs if docs[i].source == s)


def test_stages_return_the_columns_of_documents(spark):
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents(spark, SF).columns
        docs = spark.createDataFrame(out.toPandas(), out.schema) if out.count() else docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def test_stages_take_odd_rows(spark, odd, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_run_on_empty_tables(spark, odd, odd_labels, tmp_path):
    odd_labels.where("doc_id < -5").write.parquet(str(tmp_path / "labels.parquet"))
    odd.where("doc_id < -5").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
