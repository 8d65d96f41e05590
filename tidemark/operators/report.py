"""Score reports: means per category with rollup totals, and rounded-score histograms.

Both are plain aggregations; Spark's partial (map-side) aggregation keeps a hot
category (a third of all rows) from landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bleu_formulas import r6


def tenth_bucket_sql(score: str) -> str:
    """Round a 6-place score to one decimal, half to even, with integer arithmetic
    (identical in Spark and DuckDB)."""
    m = f"CAST(floor(({score}) * 1e6 + 5e-1) AS BIGINT)"
    t = f"CAST(floor({m} / 1e5) AS BIGINT)"
    rem = f"({m} - {t} * 100000)"
    return f"(CAST({t} + (CASE WHEN {rem} > 50000 OR ({rem} = 50000 AND {t} % 2 = 1) THEN 1 ELSE 0 END) AS DOUBLE) / 1e1)"


def micro_units_sql(score: str) -> str:
    """A 6-place score as an exact integer count of millionths (sums become order-free)."""
    return f"CAST(floor(({score}) * 1e6 + 5e-1) AS BIGINT)"


def score_histogram(scores: DataFrame, group_cols: Sequence[str], score: str = "bleu") -> DataFrame:
    """``group_cols, bucket, n``: count of scores per one-decimal bucket (half-even), sorted by group and bucket, nulls first."""
    return (
        scores.where(F.col(score).isNotNull())
        .select(*group_cols, F.expr(tenth_bucket_sql(score)).alias("bucket"))
        .groupBy(*group_cols, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*group_cols, "bucket")
    )


def score_report(scores: DataFrame, levels: Sequence[str], score: str = "bleu", level_col: str = "grade_level") -> DataFrame:
    """Mean and count per category with rollup totals in one job.

    ``level_col`` is ``grouping_id()``: 0 for the finest level, all bits set for the
    overall (micro) mean over all scores. Empty categories do not appear.
    """
    return (
        scores.where(F.col(score).isNotNull())
        .rollup(*levels)
        .agg(
            F.grouping_id().cast("bigint").alias(level_col),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.expr(micro_units_sql(score))).alias("_micro"),
        )
        .select(*levels, level_col, "n", F.expr(r6("CAST(_micro AS DOUBLE) / (n * 1e6)")).alias("avg"))
    )
