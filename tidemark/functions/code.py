"""Column expressions over source code: identifiers and deterministic renaming.

Renaming (``with_renamed``) is one simultaneous pass: the text is cut into words and the gaps between them,
each word found in the record's name list is swapped for its new name, and
all is joined back. New names are derived from ``md5(id:name)`` (first
five hex digits mapped to a-p), so the job is deterministic and needs no
shared state. If two new names of one record are equal, or one is a word of the
record or a reserved word, that record uses twelve digits, then all 32; a
record for which even those clash keeps its names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keywords import RENAME_EXCLUDE_CPP, RENAME_EXCLUDE_JAVA, rename_exclude_py
from tidemark.functions.text import col_

NAME_DIGITS = (5, 12, 32)  # hex digits of a new name, the first length without a clash
NAME_LETTERS = "abcdefghijklmnop"
WORD = "\\w+"  # the word runs alone
WORD_RUNS = "[A-Za-z0-9_]+|[^A-Za-z0-9_]+"

# --- fixed values: identifier patterns per language
PY_ASSIGNED = "\\b([a-zA-Z_][A-Za-z0-9_]*)\\b\\s*="
CPP_DECLARED = "\\b(?:int|float|double|char|bool|void|auto|std::[A-Za-z0-9_]+)[&*]*\\s+([a-zA-Z_][A-Za-z0-9_]*)\\b"
JAVA_PARAM = "\\b[a-zA-Z_][A-Za-z0-9_<>?]*\\s+([a-zA-Z_][A-Za-z0-9_]*)\\b"
JAVA_FOREACH = "for\\s*\\(\\s*[a-zA-Z_][A-Za-z0-9_<>?]*\\s+([a-zA-Z_][A-Za-z0-9_]*)\\s*:"


def _lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def extract_all(c, pattern: str, group: int) -> Column:
    """Java finds ``\\w`` several times faster than the same class spelled out, as the SQL has it."""
    return F.regexp_extract_all(col_(c), F.lit(pattern.replace("[A-Za-z0-9_]", "\\w")), F.lit(group))


def hashed_name(id_col, name: Column, digits: int) -> Column:
    h = F.substring(F.md5(F.concat(col_(id_col).cast("string"), F.lit(":"), name)), 1, digits)
    return F.translate(h, "0123456789abcdef", NAME_LETTERS)


def _hashed_names(names: Column, id_col, digits: int) -> Column:
    return F.transform(names, lambda n: hashed_name(id_col, n, digits))


def _distinct_but(found: Column, excluded) -> Column:
    """The distinct names that are not excluded; the excluded ones are one set for all rows."""
    return F.filter(F.array_distinct(found), lambda n: ~n.isin(list(excluded)))


def names_py(code) -> Column:
    return _distinct_but(extract_all(code, PY_ASSIGNED, 1), rename_exclude_py())


def names_cpp(code) -> Column:
    return _distinct_but(extract_all(code, CPP_DECLARED, 1), RENAME_EXCLUDE_CPP)


def java_parts(code) -> tuple[Column, Column, Column]:
    """(start through the first '(', header up to the next ')', body)."""
    c = col_(code)
    start = F.regexp_extract(c, "^([^(]*\\()", 1)
    rest = F.substr(c, F.length(start) + 1)
    header = F.regexp_extract(rest, "^([^)]*\\))", 1)
    body = F.substr(rest, F.length(header) + 1)
    return start, header, body


def names_java(code) -> Column:
    start, header, body = java_parts(code)
    found = F.concat(extract_all(header, JAVA_PARAM, 1), extract_all(body, JAVA_FOREACH, 1))
    return _distinct_but(found, RENAME_EXCLUDE_JAVA)


def with_renamed(df: DataFrame, code: str = "code", id_col: str = "id", lang: str = "lang",
                 out: str = "renamed") -> DataFrame:
    """Add ``out``: ``code`` with its identifiers renamed by language (NULL for other languages).

    Python: names assigned with ``=``; C++: declared names; Java: parameter and
    for-each names, renamed after the first ``(`` only. The name lists are
    materialised as columns before the per-token lambda runs, so each token is
    a lookup in a small array instead of a re-run of the extraction regexes.
    """
    lg = F.col(lang)
    start, header, body = java_parts(code)
    names = (F.when(lg == "Python", names_py(code)).when(lg == "Java", names_java(code))
             .when(lg == "C++", names_cpp(code)))
    staged = df.select(
        "*", names.alias("_names"),
        F.when(lg == "Java", start).otherwise(F.lit("")).alias("_jstart"),
        F.when(lg == "Java", header).otherwise(F.lit("")).alias("_jheader"),
        F.when(lg == "Java", F.concat(header, body)).otherwise(F.col(code)).alias("_scope"),
    )
    nm = F.col("_names")
    staged = staged.withColumn("_words", extract_all("_scope", WORD, 0)).withColumn("_gaps", F.split("_scope", WORD, -1))
    reserved = {w for words in (rename_exclude_py(), RENAME_EXCLUDE_CPP, RENAME_EXCLUDE_JAVA) for w in words}
    staged = staged.withColumn("_short", _hashed_names(nm, id_col, NAME_DIGITS[0]))
    chosen = nm
    for digits in NAME_DIGITS[::-1]:
        new = F.col("_short") if digits == NAME_DIGITS[0] else _hashed_names(nm, id_col, digits)
        free = (F.size(F.array_distinct(new)) == F.size(nm)) & ~F.arrays_overlap(new, F.col("_words"))
        if alike := sorted(w for w in reserved if len(w) == digits and set(w) <= set(NAME_LETTERS)):
            free &= ~F.arrays_overlap(new, _lit_array(alike))
        chosen = F.when(free, new).otherwise(chosen)
    staged = staged.withColumn("_new", chosen)
    new = F.col("_new")
    # a word and the gap behind it; the gap before the first word stands alone
    swapped = F.zip_with("_words", F.slice("_gaps", 2, F.size("_words")), lambda t, gap: F.concat(
        F.when(F.array_contains(nm, t), F.element_at(new, F.array_position(nm, t).cast("int"))).otherwise(t), gap))
    result = (
        F.when((lg == "Java") & ((F.col("_jstart") == "") | (F.col("_jheader") == "")), F.col(code))
        # naming _new a second time keeps it a column: named once, it would be inlined and re-run for every word
        .when(lg.isin("Python", "Java", "C++") & (F.size("_new") >= 0), F.concat(F.col("_jstart"), F.get("_gaps", 0), F.array_join(swapped, "")))
    )
    return staged.withColumn(out, result).drop("_names", "_jstart", "_jheader", "_scope", "_words", "_gaps", "_short", "_new")
