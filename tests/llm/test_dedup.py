import hashlib
from collections import defaultdict

import numpy as np

from tidemark.llm import dedup_fuse, fuse


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 10, 1000, 30000):
        keys = rng.integers(-2**63, 2**63 - 1, n)
        built = fuse.build(keys)
        assert fuse.contains(keys, *built).all()
        other = rng.integers(-2**63, 2**63 - 1, 20000)
        assert fuse.contains(other, *built).mean() < 0.02 or n < 10


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: (t or "").encode().lower()
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t)).hexdigest()))
    return sorted(map(str, out))


def test_odd_rows_and_empty_table(odd, none_left):
    out = dedup_fuse.dedup_table(odd, shard_keys=3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()]
    assert sorted(map(str, got)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert dedup_fuse.dedup_table(none_left).count() == 0


def test_hot_group_of_copies(spark):
    from pyspark.sql import functions as F
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same Text").otherwise(
        F.concat(F.lit("text "), (F.col("id") % 500).cast("string"))).alias("text"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup_fuse.dedup_table(docs, 50).collect()]
    assert sorted(map(str, got)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_apply_keeps_columns_and_one_row_a_text(odd):
    out = dedup_fuse.apply_dedup(odd)
    assert out.columns == odd.columns
    texts = [(r.text or "").encode().lower() for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").encode().lower() for r in odd.collect()})
