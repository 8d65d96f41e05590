"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's cost (seconds) and selectivity (documents rejected of those that
the base and earlier rules leave) are measured on a bounded sample; the rules
are then tried in order of rejections per second. A document leaves at the first rule that rejects it: the rules are the
branches of one CASE expression, and later branches are not evaluated. The
order changes the time, never the verdict, so a sample is enough for it.

Defined cases: null text has no words (and fails the base rule); the empty
text likewise; texts of any length are read whole; an empty table gives an
empty result and any order; repeated rows are judged alike; other columns are
kept by ``keep_good`` and ignored by ``apply_rules``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, WORD, materialise

MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30
#: So few repeated lines are no fault of a short text.
MIN_DUP_LINES = 3
SAMPLE_ROWS, TIMES = 1000, 3
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over text, words, lines and the base columns."""

    name: str
    rejects: str


RULES = (
    Rule("word_length", "word_chars < 1.5D * n_words OR word_chars > 30D * n_words"),
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("duplicate_lines", f"n_dup_lines >= {MIN_DUP_LINES} AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", r"2 * regexp_count(whole, '\\p{Lu}') > regexp_count(whole, '\\p{L}')"),
    Rule("letters", r"2 * size(filter(words, w -> regexp_like(w, '\\p{L}'))) < n_words"),
    Rule("broken_lines", r"10 * regexp_count(whole, '(?m)(\\.\\.\\.|…)$') > 9 * n_lines"),
)


def _head(a: str) -> Column:
    return F.slice(F.col(a), F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def _joined(a: str, step: int) -> Column:
    """The hash of two neighbours, ``step`` places apart, for every place that has both."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(a), F.lit(1 + step), n),
                      lambda x, y: F.xxhash64(x, y))


def with_base(docs: DataFrame) -> DataFrame:
    """Add words, lines, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed.

    Every 8-word window is one 64-bit hash, made by joining neighbours 1, 2 and
    4 places apart, so a text of n words costs a few passes of n steps. Only
    texts in which some window occurs again sort their windows to find where.
    """
    df = docs.withColumn("whole", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("words", F.regexp_extract_all("whole", F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("whole", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.regexp_replace("whole", GAP, "")).cast("long"),
        "n_symbols": F.regexp_count("whole", F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "_h1": F.transform("words", lambda x: F.xxhash64(x)),
    })
    df = df.withColumn("_h2", _joined("_h1", 1))
    df = df.withColumn("_h4", _joined("_h2", 2))
    df = df.withColumn("_h8", _joined("_h4", 4))
    again = F.size(F.array_distinct("_h8")) < F.size("_h8")
    placed = F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(again, placed))
    n = F.greatest(F.size("_sorted") - 1, F.lit(0))
    both = F.zip_with(F.slice("_sorted", F.lit(1), n), F.slice("_sorted", F.lit(2), n),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.array_distinct(
        F.flatten(F.filter(both, lambda x: x.isNotNull()))))))
    gaps = F.zip_with(_head("_at"), F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0))),
                      lambda a, b: F.least(F.lit(WINDOW_WORDS), b - a))
    covered = F.aggregate(gaps, F.lit(WINDOW_WORDS).cast("long"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("_at").isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                       | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.drop("_h1", "_h2", "_h4", "_h8", "_sorted", "_at")


def greedy_order(costs: Sequence[float], outcomes: dict[tuple[bool, ...], int]) -> list[int]:
    """Rule numbers, each next the one with most rejections per cost among the documents that are left.

    ``outcomes`` counts documents by what each rule says. Ties go to the cheaper, then to the earlier rule.
    """
    left, order = dict(outcomes), []
    rest = set(range(len(costs)))
    while rest:
        rejects = {j: sum(n for said, n in left.items() if said[j]) for j in rest}
        best = min(rest, key=lambda j: (-rejects[j] / costs[j], costs[j], j))
        order.append(best)
        rest.remove(best)
        left = {said: n for said, n in left.items() if not said[best]}
    return order


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS,
                seed: int = 11) -> list[Rule]:
    """The rules by rejections per cost, measured on about ``sample_rows`` documents that pass the base.

    The base columns of the sample are checkpointed, so a rule's job evaluates
    the rule only; the time of a job without a rule is taken off, and the least of ``TIMES`` runs
    counts. Selectivity is conditional: a rule is worth what it rejects of the documents that the rules before it leave.
    What comes back to the driver is a time a rule and a count for each combination of verdicts.
    """
    total = docs.count()
    fraction = min(1.0, sample_rows / max(total, 1))
    based = materialise(with_base(docs.select("text").sample(False, fraction, seed)).where("not base_failed"))
    says = [F.coalesce(F.expr(rule.rejects), F.lit(False)).alias(f"r{j}") for j, rule in enumerate(rules)]

    def seconds(test: Column) -> float:
        job = based.agg(F.sum(F.when(test, 1).otherwise(0)))
        spent = []
        for _ in range(TIMES):
            began = time.perf_counter()
            job.first()
            spent.append(time.perf_counter() - began)
        return min(spent)

    idle = seconds(F.col("n_words") < 0)
    costs = [max(seconds(says_j) - idle, 1e-4) for says_j in says]
    seen = based.select(*says).groupBy(*[f"r{j}" for j in range(len(rules))]).count().collect() if rules else []
    return [rules[j] for j in greedy_order(costs, {tuple(r)[:-1]: r["count"] for r in seen})]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later branches are not evaluated."""
    out = None
    for rule in rules:
        test = F.expr(rule.rejects)
        out = F.when(test, F.lit(rule.name)) if out is None else out.when(test, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, kept and rejected_by (which depends on the order)."""
    docs = docs.select("doc_id", "text")
    ordered = order_rules(docs, rules, sample_rows)
    first = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered))
    return with_base(docs).withColumn("rejected_by", first).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"), "rejected_by")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
win AS (
  SELECT rid, p, w8, count(*) OVER (PARTITION BY rid, w8) AS c FROM (
    SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS w8
    FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM b))),
rep AS (
  SELECT rid, count(DISTINCT q)::BIGINT AS n_repeat_words
  FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM win WHERE c > 1) GROUP BY rid),
f AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
         OR word_chars < 1.5e0 * n_words OR word_chars > 30e0 * n_words
         OR 10 * n_symbols > word_chars
         OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
         OR 2 * len(regexp_extract_all(t, '\p{Lu}')) > len(regexp_extract_all(t, '\p{L}'))
         OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < n_words
         OR 10 * len(regexp_extract_all(t, '(?m)(\.\.\.|…)$')) > 9 * n_lines) AS kept
FROM g
"""
