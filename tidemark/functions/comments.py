"""Comment and docstring removal, effective lines of code, bracket lint — column expressions.

Texts are cut into token runs with one regular expression (comments, string
literals, everything else), comment runs are blanked with a higher-order
``transform``, and the runs are joined back; blank lines are then dropped.
No Python runs per row. String literal patterns use the unrolled form
``"[^"\\]*(?:\\.[^"\\]*)*"`` so long literals do not recurse in the regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import col_, py_strip

# --- fixed values: token-run patterns (same text is used by the DuckDB oracle)
C_RUNS = (
    "//[^\\n]*|/\\*[\\s\\S]*?\\*/"
    "|'[^'\\\\]*(?:\\\\[\\s\\S][^'\\\\]*)*'"
    '|"[^"\\\\]*(?:\\\\[\\s\\S][^"\\\\]*)*"'
    "|[^/'\"]+|[\\s\\S]"
)
PY_RUNS = (
    '"""[\\s\\S]*?"""' "|'''[\\s\\S]*?'''"
    '|"[^"\\\\\\n]*(?:\\\\[\\s\\S][^"\\\\\\n]*)*"'
    "|'[^'\\\\\\n]*(?:\\\\[\\s\\S][^'\\\\\\n]*)*'"
    "|#[^\\n]*|[^\"'#]+|[\\s\\S]"
)
LINE_START = "\\n[ \\t]*$"
BLANK = "^[ \\t]*$"
#: Stands for a line feed inside a string while a text is cut into lines; Unicode reserves it for internal use.
STRING_NL = "\ufdd0"


def _runs(code, pattern: str) -> Column:
    return F.regexp_extract_all(col_(code), F.lit(pattern), F.lit(0))


def drop_blank_lines(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x: py_strip(x) != ""), "\n")


def _one_line(string: Column) -> Column:
    """A string literal without its blank lines and with ``STRING_NL`` for line feeds."""
    lines = F.filter(F.split(string, "\n", -1), lambda x: py_strip(x) != "")
    return F.when(string.contains("\n"), F.array_join(lines, STRING_NL)).otherwise(string)


def strip_comments_c(code, one_line: bool = False) -> Column:
    """C-family: ``//`` and ``/* */`` comments become one space, literals stay, blank lines go.

    With ``one_line`` the line feeds of string literals become ``STRING_NL``.
    """
    runs = _runs(code, C_RUNS)
    kept = F.transform(runs, lambda t: F.when(t.startswith("//") | t.startswith("/*"), F.lit(" ")).otherwise(
        F.when(t.startswith('"'), _one_line(t)).otherwise(t) if one_line else t))
    return drop_blank_lines(F.array_join(kept, ""))


def strip_comments_py(code, one_line: bool = False) -> Column:
    """Python: drop ``#`` comments and strings that start a line (docstrings), then blank lines.

    Each run is zipped with its predecessor (and the predecessor's index), so the
    lambda never re-evaluates the run array per element.
    """
    runs = _runs(code, PY_RUNS)
    prevs = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit(-1).alias("i"))),
        F.transform(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("t"), i.alias("i"))),
    )

    def keep(t, p):
        is_str = t.startswith('"') | t.startswith("'")
        at_line_start = p["t"].isNull() | p["t"].rlike(LINE_START) | ((p["i"] == 0) & p["t"].rlike(BLANK))
        return F.when(t.startswith("#"), F.lit("")).when(is_str & at_line_start, F.lit("")).otherwise(
            F.when(is_str, _one_line(t)).otherwise(t) if one_line else t)

    return drop_blank_lines(F.array_join(F.zip_with(runs, prevs, keep), ""))


def strip_comments(code, lang, one_line: bool = False) -> Column:
    lg = col_(lang)
    return F.when(lg == "Python", strip_comments_py(code, one_line)).when(lg == "Ruby", col_(code)).otherwise(
        strip_comments_c(code, one_line))


def _count(s: Column, sub: str) -> Column:
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub))


def effective_loc(code, lang) -> Column:
    """Lines that are neither blank, comment nor docstring, by a line state machine (``aggregate``).

    Python: triple-quoted blocks are skipped. Java and C++ (both spellings):
    block comments are skipped; a line that closes a block and continues with
    code counts, a line that only opens one counts.
    """
    lg = col_(lang)
    is_py = lg == "Python"
    is_c = lg.isin("Java", "C++", "Cpp")
    init = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("blk"), F.lit(False).alias("tri"))

    def step(acc, line):
        s = py_strip(line)
        n, blk, tri = acc["n"], acc["blk"], acc["tri"]
        tq_end = s.endswith('"""') | s.endswith("'''")
        tq_start = s.startswith('"""') | s.startswith("'''")
        tq_single = (_count(s, '"""') == 2) | (_count(s, "'''") == 2)
        has_close = s.contains("*/")
        has_open = s.contains("/*")
        comment_line = (is_py & s.startswith("#")) | (is_c & s.startswith("//")) | (s == "")
        counted = F.struct((n + F.when(comment_line, 0).otherwise(1)).alias("n"), F.lit(False).alias("blk"), tri.alias("tri"))
        opened_counted = F.struct((n + F.when(comment_line, 0).otherwise(1)).alias("n"), F.lit(True).alias("blk"), tri.alias("tri"))
        same = F.struct(n.alias("n"), blk.alias("blk"), tri.alias("tri"))
        return (
            F.when(is_py & tri, F.struct(n.alias("n"), blk.alias("blk"), (~tq_end).alias("tri")))
            .when(is_py & tq_start, F.struct(n.alias("n"), blk.alias("blk"), (~tq_single).alias("tri")))
            .when(is_c & blk & has_close & s.endswith("*/"), F.struct(n.alias("n"), F.lit(False).alias("blk"), tri.alias("tri")))
            .when(is_c & blk & has_close, counted)
            .when(is_c & blk, same)
            .when(is_c & has_open & has_close, F.struct(n.alias("n"), F.lit(False).alias("blk"), tri.alias("tri")))
            .when(is_c & has_open, opened_counted)
            .otherwise(F.struct((n + F.when(comment_line, 0).otherwise(1)).alias("n"), blk.alias("blk"), tri.alias("tri")))
        )

    return F.aggregate(F.split(col_(code), "\n", -1), init, step, lambda acc: acc["n"])


BRACKETS_ONLY = "[^()\\[\\]{}]"


def bracket_state(text) -> Column:
    """Stack lint over the brackets of ``text``: '' when balanced, '!' on a mismatch,
    else the unclosed openers."""
    chars = F.split(F.regexp_replace(col_(text), BRACKETS_ONLY + "+", ""), "", -1)
    chars = F.filter(chars, lambda c: c != "")

    def step(acc, c):
        top = F.substring(acc, -1, 1)
        pair = F.when(c == ")", "(").when(c == "]", "[").when(c == "}", "{")
        return (
            F.when(acc == "!", acc)
            .when(c.isin("(", "[", "{"), F.concat(acc, c))
            .when(top == pair, F.substring(acc, F.lit(1), F.length(acc) - 1))
            .otherwise(F.lit("!"))
        )

    return F.aggregate(chars, F.lit(""), step)
