"""DuckDB SQL forms of the code column functions (oracle side)."""

from __future__ import annotations

from tidemark.functions.comments import BLANK, BRACKETS_ONLY, C_RUNS, LINE_START, PY_RUNS
from tidemark.plans.sql_fixtures import NL, sq, strip


def drop_blank_lines(e: str) -> str:
    return f"array_to_string(list_filter(string_split({e}, {NL}), lambda x: {strip('x')} <> ''), {NL})"


def strip_comments_c(code: str) -> str:
    kept = (f"list_transform(regexp_extract_all({code}, {sq(C_RUNS)}, 0), "
            f"lambda t: CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN ' ' ELSE t END)")
    return drop_blank_lines(f"array_to_string({kept}, '')")


def strip_comments_py(runs: str) -> str:
    """``runs`` must be a column holding ``regexp_extract_all(code, PY_RUNS, 0)``."""
    kept = (f"list_transform({runs}, lambda t, i: CASE WHEN starts_with(t, '#') THEN '' "
            f"WHEN (starts_with(t, '\"') OR starts_with(t, '''')) AND (i = 1 OR regexp_matches({runs}[i - 1], {sq(LINE_START)}) "
            f"OR (i = 2 AND regexp_matches({runs}[1], {sq(BLANK)}))) THEN '' ELSE t END)")
    return drop_blank_lines(f"array_to_string({kept}, '')")


PY_RUNS_SQL = f"regexp_extract_all(code, {sq(PY_RUNS)}, 0)"


def strip_comments(code: str, lang: str, runs: str) -> str:
    return (f"(CASE WHEN {lang} = 'Python' THEN {strip_comments_py(runs)} WHEN {lang} = 'Ruby' THEN {code} "
            f"ELSE {strip_comments_c(code)} END)")


def _count(s: str, sub: str) -> str:
    return f"floor((length({s}) - length(replace({s}, {sq(sub)}, ''))) / {len(sub)})"


def effective_loc(code: str, lang: str) -> str:
    s = strip("x")
    is_py = f"({lang} = 'Python')"
    is_c = f"({lang} IN ('Java', 'C++', 'Cpp'))"
    tq_end = f"(ends_with({s}, '\"\"\"') OR ends_with({s}, ''''''''))"
    tq_start = f"(starts_with({s}, '\"\"\"') OR starts_with({s}, ''''''''))"
    tq_single = f"({_count(s, chr(34) * 3)} = 2 OR {_count(s, chr(39) * 3)} = 2)"
    has_close = f"contains({s}, '*/')"
    has_open = f"contains({s}, '/*')"
    comment = f"(({is_py} AND starts_with({s}, '#')) OR ({is_c} AND starts_with({s}, '//')) OR {s} = '')"
    inc = f"(acc.n + CASE WHEN {comment} THEN 0 ELSE 1 END)"

    def st(n, blk, tri):
        return f"{{'n': {n}, 'blk': {blk}, 'tri': {tri}}}"

    step = (
        f"CASE WHEN {is_py} AND acc.tri THEN {st('acc.n', 'acc.blk', f'NOT {tq_end}')} "
        f"WHEN {is_py} AND {tq_start} THEN {st('acc.n', 'acc.blk', f'NOT {tq_single}')} "
        f"WHEN {is_c} AND acc.blk AND {has_close} AND ends_with({s}, '*/') THEN {st('acc.n', 'false', 'acc.tri')} "
        f"WHEN {is_c} AND acc.blk AND {has_close} THEN {st(inc, 'false', 'acc.tri')} "
        f"WHEN {is_c} AND acc.blk THEN {st('acc.n', 'acc.blk', 'acc.tri')} "
        f"WHEN {is_c} AND {has_open} AND {has_close} THEN {st('acc.n', 'false', 'acc.tri')} "
        f"WHEN {is_c} AND {has_open} THEN {st(inc, 'true', 'acc.tri')} "
        f"ELSE {st(inc, 'acc.blk', 'acc.tri')} END"
    )
    init = "{'n': CAST(0 AS BIGINT), 'blk': false, 'tri': false}"
    return f"list_reduce(string_split({code}, {NL}), lambda acc, x: {step}, {init}).n"


def bracket_state(text: str) -> str:
    chars = f"list_filter(string_split(regexp_replace({text}, {sq(BRACKETS_ONLY)}, '', 'g'), ''), lambda c: c <> '')"
    step = ("CASE WHEN acc = '!' THEN acc WHEN c IN ('(', '[', '{') THEN acc || c "
            "WHEN right(acc, 1) = (CASE c WHEN ')' THEN '(' WHEN ']' THEN '[' WHEN '}' THEN '{' END) "
            "THEN left(acc, length(acc) - 1) ELSE '!' END")
    return f"list_reduce({chars}, lambda acc, c: {step}, '')"
