"""Corpus build operators: strata, samples, caps, sequential ids, verdicts, gates.

Skew notes. One stratum or group may hold a third of all rows, so no operator
ranks a whole group inside one task: per-group top-k runs in two phases
(top-k inside (group, salt) sub-groups in parallel, then top-k over the at most
k * salts survivors), which returns exactly the same rows. Sequential ids use
per-partition offsets over a range-partitioned sort instead of an
un-partitioned ``row_number``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import col_, py_strip
from tidemark.session import checkpoint_dir, fanout_partitions

DEFAULT_SALTS = 32


def default_type(c="type") -> Column:
    """Missing or empty language -> Java."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit("Java"))


def grade_of(test_case="test_case") -> Column:
    return F.when(F.size(F.coalesce(col_(test_case), F.array())) > 0, "fine").otherwise("coarse")


def stratum(type_col="type", grade_col="grade") -> Column:
    return F.concat(default_type(type_col), F.lit("-"), col_(grade_col))


def sample_key(seed: str, id_col: str) -> Column:
    """Deterministic pseudo-random order: md5(seed:id)."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k: int,
                    salt_col: str, salts: int = DEFAULT_SALTS, rank_col: str = "rn") -> DataFrame:
    """Rows ranked 1..k inside each group by ``order_cols`` (unique order), skew-safe.

    Phase 1 keeps the top k of every (group, salt) sub-group, so a hot group is
    spread over ``salts`` tasks; phase 2 ranks the survivors of each group.
    """
    g = list(group_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order_cols)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*g).orderBy(*order_cols)
    return pre.withColumn(rank_col, F.row_number().over(w2).cast("bigint")).where(F.col(rank_col) <= k)


#: Bytes of one range partition when rows are numbered.
RANGE_BYTES = 128 << 20


def sequential_ids(df: DataFrame, order_col: str, seq_col: str = "seq", ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the 0-based position of every row in ``order_col`` order, without a single-task window.

    Whole rows are range partitioned and checkpointed together with their
    partition number: that one layout gives the counts per partition (the
    offsets, one small row each) and the positions within, so nothing is joined
    back by key. Null keys come first. Rows with equal keys are numbered one
    after another, in the order of ``ties`` as far as that tells them apart.
    """
    checkpoint_dir(df.sparkSession)
    once = df.checkpoint(eager=True)  # the bounds of the ranges are drawn from a first reading
    n = fanout_partitions(df, 1, RANGE_BYTES)
    laid = once.repartitionByRange(n, order_col, *ties).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt")).select(
        "_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order_col, *ties)) - 1
    numbered = laid.withColumn("_local", local).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(seq_col, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_part", "_local", "_off")


#: Bits of the sample key that one reading of the keys refines, and its bits in all.
REFINE_BITS, KEY_BITS = 12, 60


def uniform_sample(df: DataFrame, n: int, seed: str, id_col: str) -> DataFrame:
    """The ``n`` rows first in the order of md5(seed:id), then id: a uniform sample that depends on the ids only.

    No task holds the sample: a histogram of the keys' leading bits finds the
    bucket in which the n-th key lies, a further one refines that bucket, and so
    on until it is exhausted or holds just the rows still wanted. Keys below the bucket are taken by a
    filter; of the rows within it (they differ in the last bits at most) the first
    are taken by number. Rows with equal ids are taken in any order; null ids count as an id of their own.
    """
    text = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    key = F.conv(F.substring(text, 1, KEY_BITS // 4), 16, 10).cast("long")
    low, bits, wanted = 0, 0, n
    keys = df.select(key.alias("_key"))
    if n <= 0:
        return df.where(F.lit(False))
    while bits < KEY_BITS:
        width = KEY_BITS - bits
        inside = keys if bits == 0 else keys.where(F.col("_key").between(low, low + (1 << width) - 1))
        step = width - REFINE_BITS
        counts = inside.groupBy(F.expr(f"shiftright(_key - {low}L, {step})").alias("b")).count().orderBy("b").collect()
        bits += REFINE_BITS
        for r in counts:
            if r["count"] > wanted or (r["count"] == wanted and r is not counts[-1]):
                low += r["b"] << step
                bucket = r["count"]
                break
            wanted -= r["count"]
        else:  # fewer rows than wanted: all of them, or all of this bucket
            return df if bits == REFINE_BITS else df.where(key < low + (1 << width))
        if bucket == wanted:
            return df.where(key < low + (1 << step))
    edge = sequential_ids(df.where(key == low).withColumn("_md5", text), "_md5", "_nth", [id_col])
    return df.where(key < low).unionByName(edge.where(F.col("_nth") < wanted).drop("_md5", "_nth"))


def verdict_join(corpus: DataFrame, actual: DataFrame) -> DataFrame:
    """Sample-test verdict from recorded outputs: ``id, passed``.

    ``corpus``: id, type, test_case; ``actual``: id, test_no (1-based), stdout, status.
    C/C++: the first test decides (its run must succeed); Python: the first test
    whose run succeeded decides; JavaScript: every test must match; other
    languages are unsupported (not passed). Comparison is whitespace-trimmed.
    """
    tests = corpus.select("id", default_type("type").alias("lang"), F.posexplode("test_case").alias("pos", "tc"))
    tests = tests.select("id", "lang", (F.col("pos") + 1).alias("test_no"), F.col("tc.expected").alias("expected"))
    j = tests.join(actual, ["id", "test_no"], "left")
    ok_run = F.coalesce(F.col("status") == 0, F.lit(False))
    match = ok_run & (py_strip(F.col("stdout")) == py_strip(F.col("expected")))
    decided = j.groupBy("id", "lang").agg(
        F.min_by(match, F.col("test_no")).alias("first_match"),
        F.min_by(match, F.when(ok_run, F.col("test_no"))).alias("first_ok_match"),
        F.bool_and(match).alias("all_match"),
    )
    passed = (
        F.when(F.col("lang").isin("C", "C++"), F.col("first_match"))
        .when(F.col("lang") == "Python", F.coalesce(F.col("first_ok_match"), F.lit(False)))
        .when(F.col("lang") == "JavaScript", F.col("all_match"))
        .otherwise(F.lit(False))
    )
    ids = corpus.select("id")
    return ids.join(decided.select("id", F.coalesce(passed, F.lit(False)).alias("passed")), "id", "left").select(
        "id", F.coalesce(F.col("passed"), F.lit(False)).alias("passed")
    )


def attach_samples(code: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Code rows whose ``key`` has samples, with all of them as ``test_case`` in order; others are left out.

    ``samples``: key, ord, input, expected. The list is bounded by one page.
    """
    one = F.struct("ord", F.struct("input", "expected").alias("t"))
    per = samples.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("test_case"))
    return code.join(per, key)


def align_last_wins(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Align two record sets by id, last record per id winning on each side: ``key, left, right``.

    ``max_by`` is a partial aggregate, so a hot id is pre-reduced map-side.
    """
    lw = left.groupBy(key).agg(F.max_by(value, order).alias("left"))
    rw = right.groupBy(key).agg(F.max_by(value, order).alias("right"))
    return lw.join(rw, key)
