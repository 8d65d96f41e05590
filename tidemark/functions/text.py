"""Column expressions for text: whitespace, token sequences, n-grams.

All are built-in Spark functions (JVM side); nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() whitespace, spelled out so Java regex and RE2 agree.
WS = "[ \\t\\n\\r\\f\\x0B]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip leading and trailing whitespace like Python ``str.strip()``."""
    return F.regexp_replace(col_(c), f"^{WS}+|{WS}+$", "")


def line_tokens(c) -> Column:
    """Split on newlines; trailing empty strings are kept."""
    return F.split(col_(c), "\n", -1)


def word_tokens(c) -> Column:
    """Whitespace tokens like Python ``str.split()``; empty text gives an empty array."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+", -1))


def ngram_arrays(tokens, max_n: int, sep: str = "\n") -> list[Column]:
    """n-gram arrays for n = 1..max_n, built incrementally: the (n)-grams are the
    (n-1)-grams zipped with the token n-1 places ahead (no per-gram slice arrays)."""
    toks = col_(tokens)
    out = [toks]
    prev = toks
    for n in range(2, max_n + 1):
        keep = F.greatest(F.size(toks) - n + 1, F.lit(0))
        prev = F.zip_with(F.slice(prev, 1, keep), F.slice(toks, n, keep), lambda a, b: F.concat(a, F.lit(sep), b))
        out.append(F.when(F.size(toks) >= n, prev).otherwise(F.array().cast("array<string>")))
    return out


def drop_every_third(tokens) -> Column:
    """Remove items 3, 6, 9, ... (1-based) from an array."""
    return F.filter(col_(tokens), lambda x, i: (i + 1) % 3 != 0)
