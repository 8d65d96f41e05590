"""Skew-safe operators against brute force: one group holds a third of all rows."""

import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators.corpus import align_last_wins, sequential_ids, top_k_per_group


def _rows(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        grp = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"
        rows.append((i, grp, rnd.random()))
    return rows


def test_top_k_per_group_matches_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, grp string, score double").repartition(16)
    got = {(r["grp"], r["rn"], r["id"]) for r in
           top_k_per_group(df, ["grp"], [F.col("score"), F.col("id")], 7, salt_col="id", salts=8).collect()}
    want = set()
    for g in {r[1] for r in rows}:
        ranked = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))[:7]
        want |= {(g, k + 1, r[0]) for k, r in enumerate(ranked)}
    assert got == want


def test_sequential_ids_over_many_partitions(spark):
    ids = random.Random(3).sample(range(10**9), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(23)
    got = {r["id"]: r["seq"] for r in sequential_ids(df, "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_align_last_wins_with_hot_key(spark):
    rows = [(1 if i % 3 == 0 else i, i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, turn long, text string").repartition(8)
    got = {r["k"]: (r["left"], r["right"]) for r in align_last_wins(df, df, "k", "turn", "text").collect()}
    last = {}
    for k, turn, text in rows:
        if k not in last or turn > last[k][0]:
            last[k] = (turn, text)
    assert got == {k: (v[1], v[1]) for k, v in last.items()}


def test_checkpoint_dir_requires_shared_folder_off_local(monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    calls = []
    conf = {"spark.master": "spark://host:7077"}
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__),
        sparkContext=SimpleNamespace(master="spark://host:7077", setCheckpointDir=calls.append))
    with pytest.raises(ValueError):
        session.checkpoint_dir(fake)
    conf["spark.checkpoint.dir"] = "hdfs://shared/ckpt"
    assert session.checkpoint_dir(fake) == "hdfs://shared/ckpt" and calls == ["hdfs://shared/ckpt"]


def test_fanout_partitions_follow_the_input(spark):
    from tidemark.session import fanout_partitions, input_bytes

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = input_bytes(df)
    assert size > 1_000_000
    assert fanout_partitions(df, 4, task_bytes=size // 50) in range(200, 206)
    assert fanout_partitions(df, 4) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    unknown = spark.createDataFrame([(1,)], "id long")
    assert fanout_partitions(unknown, 4) == int(spark.conf.get("spark.sql.shuffle.partitions"))
