"""Prompt building and response parsing as column expressions.

FIXED VALUES below (patterns, marker, pivot languages) define the parsing
rules; prompt wording is our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import col_, py_strip

# --- fixed values: fenced code (tagged or untagged), response marker, docstring segments
FENCED = "```[a-z]*\\n([\\s\\S]*?)```|```([\\s\\S]*?)```"
RESPONSE_MARKER = "### Response:"
DOCSTRING = '"""[\\s\\S]*?"""'
SENTENCE_END = "[.!?] "
BLOCK_SEP = "\n-----\n"

# --- fixed values: pivot language of the round trip
PIVOT = {"C++": "Rust", "Java": "Csharp", "Python": "Golang"}

TEMPLATES = {
    "rewrite": (
        "Below is a {lang} program. Rewrite it so that it behaves the same but reads differently.\n"
        "### Input:\n{code}\n### Response:\n"
    ),
    "summary": "Below is a {lang} program. Describe what it computes in one paragraph.\n### Input:\n{code}\n### Response:\n",
    "forward": "Translate the following {lang} program into {pivot}.\n### Input:\n{code}\n### Response:\n",
    "back": "Translate the following {pivot} program back into {lang}.\n### Input:\n{code}\n### Response:\n",
}


def fill_template(template: str, **fields: str) -> Column:
    """Nested literal replaces; ``code`` is filled last so code text is never rewritten."""
    out: Column = F.lit(template)
    for name in [k for k in fields if k != "code"] + (["code"] if "code" in fields else []):
        out = F.replace(out, F.lit("{" + name + "}"), col_(fields[name]))
    return out


def pivot_of(lang) -> Column:
    out = None
    for a, b in PIVOT.items():
        out = F.when(col_(lang) == a, b) if out is None else out.when(col_(lang) == a, b)
    return out


def fenced_blocks(text) -> Column:
    """All fenced blocks (group 1, else group 2), stripped, blanks dropped.

    The pieces between fences are what ``FENCED`` matches: a block ends at the first fence
    after the one that opens it. Cutting at the fences costs a fraction of the pattern's lazy groups.
    """
    parts = F.split(col_(text), "```", -1)
    closed = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: i % 2 == 1)
    return F.filter(F.transform(closed, lambda x: py_strip(F.regexp_replace(x, "^[a-z]*\\n", ""))), lambda x: x != "")


def first_block(text) -> Column:
    """The first fenced block, or the whole text without one."""
    return F.coalesce(F.get(fenced_blocks(text), 0), col_(text))


def response_after_marker(text, marker: str = RESPONSE_MARKER) -> Column:
    """Text between the first and second marker, stripped; the whole text (stripped) without a marker."""
    t = col_(text)
    return F.when(t.contains(marker), py_strip(F.split_part(t, F.lit(marker), F.lit(2)))).otherwise(py_strip(t))


def back_answer(id_col, text) -> Column:
    """Recorded answer of the return trip: fenced for even ids, bare for odd ids."""
    fenced = F.concat(F.lit(RESPONSE_MARKER + "\n```\n"), col_(text), F.lit("\n```"))
    bare = F.concat(F.lit(RESPONSE_MARKER + "\n"), col_(text))
    return F.when(col_(id_col) % 2 == 0, fenced).otherwise(bare)


def back_answer_sql(id_sql: str, text_sql: str) -> str:
    return (f"(CASE WHEN {id_sql} % 2 = 0 THEN '{RESPONSE_MARKER}' || chr(10) || '```' || chr(10) || {text_sql} "
            f"|| chr(10) || '```' ELSE '{RESPONSE_MARKER}' || chr(10) || {text_sql} END)")


def roundtrip_resolve(df: DataFrame, forward: str, back: str) -> DataFrame:
    """Final code of a round trip: first block of the return answer, else the forward answer.

    The fallback keeps the forward answer even though it is in the pivot
    language (as the benchmark does); ``fallback`` marks those rows.
    """
    staged = df.withColumn("_answer", response_after_marker(back)).withColumn("_blocks", fenced_blocks("_answer"))
    return staged.select(
        *df.columns,
        F.when(F.size("_blocks") > 0, F.get("_blocks", 0)).otherwise(response_after_marker(forward)).alias("final"),
        (F.size("_blocks") == 0).alias("fallback"),
    )


def segment_map(code, fn) -> Column:
    """Apply ``fn`` to the parts after each triple-quoted string and rebuild by position."""
    c = col_(code)
    parts = F.split(c, DOCSTRING, -1)
    docs = F.regexp_extract_all(c, F.lit(DOCSTRING), F.lit(0))
    tail = F.zip_with(docs, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda d, p: F.concat(d, fn(p)))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def map_leaves(nested: Column, fn) -> Column:
    return F.transform(nested, lambda inner: F.transform(inner, fn))


def rebuild_nested(nested: Column) -> Column:
    """Serialise a list of lists in order: ``[a | b] [c]`` (blank leaves dropped)."""
    return F.array_join(
        F.transform(nested, lambda inner: F.concat(F.lit("["), F.array_join(F.filter(inner, lambda x: x != ""), " | "), F.lit("]"))),
        " ",
    )
