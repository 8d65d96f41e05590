"""The operators on programs, one program at a time inside a task.

The same steps as ``dataflow``, ``reaching``, ``structure``, ``bleu`` and
``weighted`` take over frames of tokens and grams, for jobs that need their
result per program only: tokens, regions, reaching definitions, nodes,
normalised items, subtree signatures and gram counts of a program are plain
Python values and never become rows, so nothing is exploded, sorted by windows
or aggregated by key. A record costs its own length; a task holds one batch of
records and the copies of one id. Patterns and word lists are those of the
frame operators, read as Java reads them (``.`` and ``$`` know five line ends).

Rows of one id that come several times are one program, as they are for windows
and aggregations keyed by the id: counts add up, lengths are the largest, token
rows merge by position.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.comments import C_RUNS, PY_RUNS, STRING_NL
from tidemark.functions.keywords import KEYWORDS, LANG_CODE
from tidemark.operators.dataflow import ASSIGN_OPS, LOOP_OPENERS, NOT_TYPES, TOKEN, TYPE_WORDS
from tidemark.operators.reaching import BRANCH_PATTERN, CONDITIONAL, DEDENT, INDENT, LOOPS, PYTHON_WORDS

# --- Java's reading of the shared patterns
_ENDS = "\\n\\r\\x85\\u2028\\u2029"
_DOLLAR = "(?=\\Z|\\r\\n\\Z|(?<!\\r)\\n\\Z|[\\r\\x85\\u2028\\u2029]\\Z)"
_WS = " \t\n\r\f\x0b"
_c_runs = re.compile(C_RUNS, re.ASCII).findall
_py_runs = re.compile(PY_RUNS, re.ASCII).findall
_tokens = re.compile(TOKEN.replace("(?:\\\\.", f"(?:\\\\[^{_ENDS}]"), re.ASCII).findall
_line_start = re.compile(f"\\n[ \\t]*{_DOLLAR}").search
_blank = re.compile(f"^[ \\t]*{_DOLLAR}").search
_branch = re.compile(BRANCH_PATTERN.replace("$", "\\Z")).search
_words = re.compile(f"[^{_WS}]+").findall
_edges = re.compile(f"^[{_WS}]+|[{_WS}]+{_DOLLAR}").sub
_indent = re.compile("[ \t\f]*").match

_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_KEYWORDS = {name: frozenset(KEYWORDS[code]) for name, code in LANG_CODE.items()}
_ASSIGN, _TYPES, _OPENERS, _NOT_TYPES = map(frozenset, (ASSIGN_OPS, TYPE_WORDS, LOOP_OPENERS, NOT_TYPES))
_HEADS, _LOOPS, _PY_WORDS = frozenset(CONDITIONAL), frozenset(LOOPS), frozenset(PYTHON_WORDS)
_SAYS = _HEADS | {"else", "do"}


# ---------------------------------------------------------------- tokens
def _kept(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(_WS)]


def _one_line(string: str) -> str:
    return STRING_NL.join(_kept(string)) if "\n" in string else string


def code_lines(text: str, lang: str | None) -> list[str]:
    """The lines of a text without comments, counted by all its line feeds (``comments.strip_comments``, ``dataflow._lines``)."""
    if lang == "Ruby":
        lines = text.split("\n")
    else:
        out = []
        if lang == "Python":
            runs, before = _py_runs(text), None
            for i, t in enumerate(runs):
                c = t[0]
                if c == '"' or c == "'":
                    at_start = before is None or _line_start(before) or (i == 1 and _blank(before))
                    out.append("" if at_start else _one_line(t))
                elif c != "#":
                    out.append(t)
                before = t
        else:
            for t in _c_runs(text):
                c = t[0]
                out.append(" " if c == "/" and t[1:2] in ("/", "*") and len(t) > 1 else _one_line(t) if c == '"' else t)
        lines = _kept("".join(out)) or [""]
    if any(STRING_NL in x for x in lines):
        lines = [y for x in lines for y in [x, *[""] * x.count(STRING_NL)]]
    return lines


def _layout_events(lines: list[str], found: list[list[str]]) -> list[tuple[int, int]]:
    """Per line (suites that end, suites that begin before it), one more for the end (``dataflow._layout_events``)."""
    stack, par, wraps, out = [0], 0, False, []
    for line, toks in zip(lines, found):
        closes = opens = 0
        if toks:
            if par <= 0 and not wraps:
                depth = len(_indent(line)[0].replace("\t", "        "))
                before = len(stack)
                stack = [d for d in stack if d <= depth]
                closes = before - len(stack)
                if stack[-1] < depth:
                    stack.append(depth)
                    opens = 1
            for t in toks:
                if t in ("(", "[", "{"):
                    par += 1
                elif t in (")", "]", "}"):
                    par -= 1
            wraps = toks[-1] == "\\"
        out.append((closes, opens))
    out.append((len(stack) - 1, 0))
    return out


def _flat(found: list[list[str]]) -> tuple[list[str], list[int]]:
    toks, lines = [], []
    for i, ts in enumerate(found):
        toks += ts
        if any(STRING_NL in t for t in ts):
            for t in ts:
                lines.append(i)
                i += t.count(STRING_NL)
        else:
            lines += [i] * len(ts)
    return toks, lines


def token_lists(text: str | None, lang: str | None, layout: bool = True) -> tuple[list[str], list[int], list[str], list[int]]:
    """(tokens, their lines, tokens with layout, their lines); strings over lines hold ``STRING_NL`` for line feeds."""
    if text is None:
        return [], [], [], []
    lines = code_lines(text, lang)
    found = [_tokens(x) for x in lines]
    plain = _flat(found)
    if layout and lang == "Python" and any(x[:1] in (" ", "\t", "\f") and x for x in lines):
        marked = [[DEDENT] * c + [INDENT] * o + ts for (c, o), ts in zip(_layout_events(lines, found), [*found, []])]
        return *plain, *_flat(marked)
    return *plain, *plain


def has_blocks(text: str | None) -> bool:
    """``dataflow.branches``."""
    # a plain search leaves the pattern, which is tried at every character, to the few texts that may match
    return text is not None and ("if" in text or "for" in text or "while" in text or "do" in text) and _branch(text) is not None


#: (position, line, token, previous, next) of a token.
Row = tuple[int, int, str, str | None, str | None]


def _rows(toks: list[str], lines: list[int]) -> list[Row]:
    return list(zip(range(len(toks)), lines, toks, [None, *toks[:-1]], [*toks[1:], None])) if toks else []


def _merged(copies: list[list[Row]]) -> list[Row]:
    return copies[0] if len(copies) == 1 else sorted((r for rows in copies for r in rows), key=lambda r: r[0])


def _role(tok: str, prev: str | None, nxt: str | None, keywords: frozenset) -> int:
    """0: neither, 1: a use, 2: a definition, 3: a declaration."""
    if tok[0] not in _LETTERS or tok in keywords or nxt == "(":
        return 0
    if prev in _TYPES:
        return 3
    if nxt in _ASSIGN:
        return 2
    if nxt == "in" or nxt == ":":
        declared = prev is not None and prev[0] in _LETTERS and prev not in _NOT_TYPES
        if declared or (nxt == "in" and prev in _OPENERS):
            return 2
    return 1


#: (position, line, name, role) of a definition or use.
Occurrence = tuple[int, int, str, int]


def occurrences(rows: Iterable[Row], lang: str | None) -> list[Occurrence]:
    keywords, out = _KEYWORDS.get(lang, frozenset()), []
    for pos, line, tok, prev, nxt in rows:
        if tok[0] in _LETTERS and (role := _role(tok, prev, nxt, keywords)):
            out.append((pos, line, tok, role))
    return out


def straight_defs(occurs: list[Occurrence], by_line_too: bool = True) -> list[Sequence[int]]:
    """Per occurrence the definition that reaches it: the last one on an earlier line (``dataflow.straight_uses``).

    ``by_line_too``: lines follow positions, as they do in one text.
    """
    if not by_line_too:
        by_line: dict[str, dict[int, int]] = {}
        for pos, line, name, role in occurs:
            if role > 1:
                d = by_line.setdefault(name, {})
                d[line] = max(pos, d.get(line, -1))
        return [() if role > 1 else [max(x)] if (x := [p for at, p in by_line.get(name, {}).items() if at < line]) else ()
                for _, line, name, role in occurs]
    seen, fresh, at, out = {}, {}, -1, []
    for pos, line, name, role in occurs:
        if line != at:
            seen.update(fresh)
            fresh.clear()
            at = line
        if role > 1:
            fresh[name] = pos
            out.append(())
        else:
            out.append((seen[name],) if name in seen else ())
    return out


# ---------------------------------------------------------------- regions and reaching definitions
def _regions(rows: list[Row], lang: str | None) -> dict[int, tuple]:
    """Index of a row -> (number, kind, start, end, first line, last line) of the region that begins there (``reaching.with_regions``)."""
    python = lang == "Python"
    n = len(rows)
    opens, closes, pars, deeps = [False] * n, [False] * n, [0] * n, [0] * n
    par = deep = 0
    body: list = [None] * n
    before: dict[int, tuple | None] = {}
    ended = None
    last_line = None
    for i, (pos, line, tok, prev, nxt) in enumerate(rows):
        o = tok == INDENT or (not python and tok == "{")
        c = tok == DEDENT or (not python and tok == "}")
        if tok in ("(", "[") or (python and tok == "{"):
            par += 1
        elif tok in (")", "]") or (python and tok == "}"):
            par -= 1
        deep += 1 if o else -1 if c else 0
        opens[i], closes[i], pars[i], deeps[i] = o, c, par, deep + 1 if c else deep
        word = None
        if python:
            if tok in _PY_WORDS and (prev is None or prev in (INDENT, DEDENT) or (last_line is not None and last_line < line)):
                word = (pos, "loop" if tok in _LOOPS else tok, line)
        elif tok in _SAYS and not (tok == "else" and nxt == "if"):
            joined = tok == "if" and prev == "else"
            word = (pos - 1 if joined else pos, "loop" if tok in _LOOPS else "elif" if joined else tok, line)
        last_line = line
        body[i] = ended
        ender = tok == (":" if python else ")")
        headed = word is not None and (python or tok in _HEADS)
        open_ = before.get(par)
        ended = open_ if ender and open_ is not None else word if word is not None and not headed else None
        if headed:
            before[par] = word
        elif ender:
            before[par] = None
    if not any(body):
        return {}
    line_end: dict[int, tuple[int, int]] = {}
    for pos, line, tok, _, _ in rows:
        if tok != INDENT and tok != DEDENT:
            line_end[line] = max((pos, line), line_end.get(line, (-1, -1)))
    out, closer, statement, last_pos = {}, {}, {}, rows[-1][0]
    for i in range(n - 1, -1, -1):
        pos, line, tok, _, _ = rows[i]
        spot = (pos, line - 1 if tok == DEDENT else line)
        if closes[i]:
            closer[deeps[i]] = spot
        if tok == ";":
            statement[deeps[i], pars[i]] = spot
        if body[i] is not None:
            end = closer.get(deeps[i]) if opens[i] else line_end.get(line) if python else statement.get((deeps[i], pars[i]))
            end = end or (last_pos, line)
            number, kind, first = body[i]
            out[i] = (number, kind, number if kind == "loop" else pos, end[0], first, end[1])
    return out


class _Path:
    """A region on the way out: its statement, whether it is a loop, its arms, whether one of them is always taken, its ends."""

    __slots__ = ("number", "statement", "loop", "arms", "sure", "l0", "l1", "end")


def _paths(rows: list[Row], regions: dict[int, tuple], occurs: dict[int, tuple]) -> list[tuple[int, list[_Path]]]:
    """(index of the row, regions around it, outermost first) of every occurrence (``reaching.with_paths``)."""
    events = []
    for i, (pos, *_) in enumerate(rows):
        if r := regions.get(i):
            events.append((r[2], 0, -r[3], r[0], i))
            events.append((r[3], 2, 0, r[0], i))
        if i in occurs:
            events.append((pos, 1, 0, 0, i))
    events.sort()
    depth, at_depth, out, starts = 0, {}, [], []
    for _, turn, _, number, i in events:
        depth += 1 if turn == 0 else -1 if turn == 2 else 0
        if turn == 0:
            around = [at_depth[k] for k in range(1, depth) if k in at_depth]
            info = _Path()
            info.number = number
            starts.append((around[-1].number if around else -1, number, regions[i], info))
            at_depth[depth] = info
        elif turn == 1:
            out.append((i, [at_depth[k] for k in range(1, depth + 1) if k in at_depth]))
    starts.sort(key=lambda s: s[:2])
    for _, siblings in groupby(starts, key=lambda s: s[0]):
        last, statements = None, {}
        at = None
        for _, number, r, info in siblings:
            goes_on = r[1] in ("elif", "else") and last is not None and last[1] in ("if", "elif") and last[3] + 1 == number
            if not goes_on:
                at = number
            statements.setdefault(at, []).append((r, info))
            last = r
        for number, arms in statements.items():
            sure = any(r[1] not in ("if", "elif") for r, _ in arms)
            l0, l1, end = min(r[4] for r, _ in arms), max(r[5] for r, _ in arms), max(r[3] for r, _ in arms)
            for r, info in arms:
                info.statement, info.loop, info.arms, info.sure, info.l0, info.l1, info.end = number, r[1] == "loop", len(arms), sure, l0, l1, end
    return out


def reaching(rows: list[Row], lang: str | None) -> tuple[list[Occurrence], list[Sequence[int]]]:
    """(occurrences, the definitions that reach each), by positions without layout tokens (``reaching.reaching``)."""
    rpos, n = [], 0
    for r in rows:
        rpos.append(n)
        n += r[2] != INDENT and r[2] != DEDENT
    keywords = _KEYWORDS.get(lang, frozenset())
    found = {}
    for i, (_, _, tok, prev, nxt) in enumerate(rows):
        if tok[0] in _LETTERS and (role := _role(tok, prev, nxt, keywords)):
            found[i] = role
    regions = _regions(rows, lang)
    places = _paths(rows, regions, found) if regions else [(i, []) for i in found]
    # per occurrence: name, is a definition, position reported, line and position it stands for, whether it covers, its definitions
    states = [[rows[i][2], found[i] > 1, rpos[i], rows[i][1], rows[i][0] if found[i] > 1 else -1, found[i] > 1, {}, path] for i, path in places]
    levels: list[list] = [[] for _ in range(1 + max((len(s[7]) for s in states), default=0))]
    for s in states:
        levels[len(s[7])].append(s)
    for level in range(len(levels) - 1, -1, -1):
        inside: dict[tuple, list] = {}
        for s in levels[level]:
            inside.setdefault((s[0], s[7][level - 1].number if level else -1), []).append(s)
        leaves, covers = [], {}
        for group in inside.values():
            group.sort(key=lambda s: (s[3], s[4]))
            stretch, held, numbers = 0, [], []
            for _, peers in groupby(group, key=lambda s: (s[3], s[4])):
                peers = list(peers)
                new = sum(s[5] for s in peers)
                if new:
                    stretch += new
                    held = []
                held = held + [s[2] for s in peers if s[1]]
                for s in peers:
                    if not s[1]:
                        s[6].update(dict.fromkeys(held))
                    numbers.append(stretch)
            if not level:
                continue
            out = [s for s, k in zip(group, numbers) if (k == stretch if s[1] else k == 0)]
            top = group[0][7][level - 1]
            if top.loop:
                round_ = dict.fromkeys(s[2] for s in out if s[1])
                for s in out:
                    if not s[1]:
                        s[6].update(round_)
            if any(s[5] for s in group):
                covers.setdefault((group[0][0], top.statement), set()).add(top.number)
            leaves += out
        for s in leaves:
            top = s[7][level - 1]
            s[7] = s[7][:level - 1]
            if s[1]:
                s[3], s[4], s[5] = top.l1, top.end, top.sure and len(covers.get((s[0], top.statement), ())) == top.arms
            else:
                s[3] = top.l0
            levels[level - 1].append(s)
    order = sorted(range(len(places)), key=lambda k: places[k][0])
    return ([(rpos[i], rows[i][1], rows[i][2], found[i]) for i, _ in (places[k] for k in order)],
            [sorted(states[k][6]) for k in order])


# ---------------------------------------------------------------- nodes, items, signatures
def flow_items(occurs: list[Occurrence], defs: list[Sequence[int]]) -> Counter:
    """Normalised data-flow items with their counts (``dataflow.merged_nodes``, ``normalized``)."""
    heads: dict[int, tuple[str, str]] = {}
    parents: dict[int, list] = {}
    marked = set()
    statement: dict[int, int] = {}
    for (pos, line, name, role), reached in zip(occurs, defs):
        rel = "computedFrom" if role == 2 else "comesFrom"
        if pos in heads:
            var, other = heads[pos]
            heads[pos] = max(var, name), max(other, rel)
        else:
            heads[pos] = name, rel
        if role > 1:
            statement[line] = pos
            continue
        for d in reached:
            parents.setdefault(pos, []).append((d, name))
            marked.add(d)
        if line in statement:
            parents.setdefault(statement[line], []).append((pos, name))
            marked.add(pos)
    numbers: dict[str, int] = {}
    items = []
    for pos, (var, rel) in heads.items():  # by position
        of = parents.get(pos)
        if of is None:
            if pos not in marked:
                continue
            names = []
        else:
            of.sort()
            names = [name for _, name in of]
            if rel == "comesFrom" and all(name == var for name in names):
                names = names[:1]
        ranks = [numbers.setdefault(name, len(numbers)) for name in names]
        items.append((numbers.setdefault(var, len(numbers)), rel, *ranks))
    return Counter(items)


_SYMBOL = {"(": "(paren", ")": ")", "[": "(index", "]": ")", "{": "(block", "}": ")", INDENT: "(suite", DEDENT: ")"}


def signatures(toks: list[str], lang: str | None, positions: list[int] | None = None) -> list[str]:
    """The s-expressions of the root and of every node with children (``structure.subtree_signatures`` takes their md5).

    Tokens come in the order of ``positions`` (their own order by default).
    """
    if not toks:
        return []
    keywords = _KEYWORDS.get(lang, frozenset())
    pieces = []
    for t in toks:
        p = _SYMBOL.get(t)
        if p is None:
            c = t[0]
            if c in _LETTERS:
                p = " " + t if t in keywords else " n"
            elif c == '"' or c == "'":
                p = " s"
            else:
                p = " 1" if "0" <= c <= "9" else " " + t
        pieces.append(p)
    whole, spans = "".join(pieces), []
    off = depth = 0
    openers: dict[int, list[tuple[int, int]]] = {}
    closed: dict[int, int] = {}
    for i, p in enumerate(pieces):
        if p[0] == "(":
            openers.setdefault(depth, []).append((i if positions is None else positions[i], off))
            depth += 1
        elif p == ")":
            depth -= 1
            k = closed[depth] = closed.get(depth, -1) + 1
            mates = openers.get(depth, ())
            if k < len(mates) and (i if positions is None else positions[i]) > mates[k][0] + 1:
                spans.append((mates[k][1], off + 1))
        off += len(p)
    if positions is not None:  # equal positions: pieces in order, as the sorted list of pieces has them
        whole = "".join(p for _, p in sorted(zip(positions, pieces)))
    return [whole, *[whole[a:b] for a, b in spans]]


def matched(counts: list[Counter], hit_only: bool = False) -> list[tuple[int, int] | None]:
    """(matched, total) of every member above 0 against member 0; a member without items has none.

    ``hit_only``: an item counts as often as the member has it if member 0 has it at all.
    """
    base = counts[0]
    out = []
    for c in counts[1:]:
        if not c:
            out.append(None)
            continue
        out.append((sum([n for x, n in c.items() if x in base]) if hit_only else _common(c, base), sum(c.values())))
    return out


# ---------------------------------------------------------------- grams
def words_of(text: str) -> list[str]:
    """``text.word_tokens``."""
    if text[-1:] in ("\x85", "\u2028", "\u2029"):  # white space before such an end is taken off
        text = _edges("", text)
    return _words(text)


def gram_counts(tokens: list[str], index: dict[str, int], base: int, max_n: int) -> list[Counter]:
    """Counts of the n-grams for n = 1..max_n; a gram is a number in base ``base`` over the numbers of its tokens."""
    first = grams = [index[t] for t in tokens]
    out = [Counter(grams)]
    for n in range(2, max_n + 1):
        grams = [a * base + b for a, b in zip(grams, first[n - 1:])]
        out.append(Counter(grams))
    return out


def _common(a: Counter, b: Counter) -> int:
    n = 0
    for g, c in a.items():
        if g in b:
            d = b[g]
            n += c if c < d else d
    return n


def largest(values: Iterable) -> object:
    return max((v for v in values if v is not None), default=None)


def member_counts(copies: list[list[list[str] | None]], max_n: int, sep: str) -> tuple[list[list[Counter]], list[str]]:
    """(per member the counts of its grams over all copies, the tokens by number)."""
    index: dict[str, int] = {}
    for texts in copies:
        for toks in texts:
            for t in toks or ():
                if t not in index:
                    index[t] = len(index)
    base = max(1, len(index))
    if any(sep in t for t in index):  # grams are texts then: two lists of tokens may give the same one
        def counts_of(toks):
            return [Counter(sep.join(toks[i:i + n]) for i in range(len(toks) - n + 1)) if n > 1 else Counter(index[t] for t in toks)
                    for n in range(1, max_n + 1)]
    else:
        def counts_of(toks):
            return gram_counts(toks, index, base, max_n)
    members = max(map(len, copies), default=0)
    out = []
    for m in range(members):
        per = [counts_of(texts[m]) for texts in copies if m < len(texts) and texts[m] is not None]
        out.append(per[0] if len(per) == 1 else [sum((p[k] for p in per), Counter()) for k in range(max_n)])
    return out, list(index)


def bleu_stats(copies: list[list[list[str] | None]], max_n: int = 4) -> list[tuple]:
    """Per member above 0: ``num_1.., den_1.., hyp_len, ref_len`` of its lines against those of member 0 (``bleu.order_stats``)."""
    counts, _ = member_counts(copies, max_n, "\n")
    out = []
    for m in range(1, len(counts)):
        has = [texts for texts in copies if m < len(texts)]
        base = counts[0] if len(has) == len(copies) else member_counts([t[:1] for t in has], max_n, "\n")[0][0]
        own = counts[m]
        if base is not counts[0]:  # numbers of one table
            (base, own), _ = member_counts([[t[0], t[m]] for t in has], max_n, "\n")
        nums = [_common(a, b) for a, b in zip(own, base)]
        dens = [max(1, sum(c.values())) for c in own]
        lengths = (largest(None if t[k] is None else len(t[k]) for t in has) for k in (m, 0))
        out.append((*nums, *dens, *lengths))
    return out


def recall_stats(copies: list[list[list[str] | None]], keywords: frozenset, max_n: int = 4, sep: str = " ",
                 weights: tuple[int, int, int] = (5, 1, 5)) -> tuple[list[list[tuple[int, int]]], list]:
    """(per member above 0 the weighted (matched, total) of every order against member 0, the largest lengths of all members)."""
    counts, tokens = member_counts(copies, max_n, sep)
    word, other, gram = weights
    single = [word if t in keywords else other for t in tokens]
    out = []
    for own in counts[1:]:
        base, num, den = counts[0][0], 0, 0
        for g, c in own[0].items():
            den += c * single[g]
            if g in base:
                d = base[g]
                num += single[g] * (c if c < d else d)
        per = [(num, den)]
        for a, b in zip(own[1:], counts[0][1:]):
            per.append((gram * _common(a, b), gram * sum(a.values())))
        out.append(per)
    lengths = [largest(len(t[m]) for t in copies if m < len(t) and t[m] is not None) for m in range(len(counts))]
    return out, lengths


def closest_length(hyp: list | None, refs: list[list | None]) -> int | None:
    """``bleu.closest_ref_length``: a difference or length that is unknown comes first."""
    pairs = [(None if hyp is None or r is None else abs(len(r) - len(hyp)), None if r is None else len(r)) for r in refs]
    return min(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or 0), default=(None, None))[1]


# ---------------------------------------------------------------- batches
def groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1024) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, its rows) of batches that are sorted by their first ``keys`` columns, a key's rows over several batches included."""
    key, held = None, []
    for b in batches:
        for at in range(0, b.num_rows, rows):
            for row in zip(*(c.to_pylist() for c in b.slice(at, rows).columns)):
                if held and row[:keys] != key:
                    yield key, held
                    held = []
                key = row[:keys]
                held.append(row)
    if held:
        yield key, held


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def in_groups(keys: int, schema: pa.Schema, of: Callable[[tuple, list[tuple]], Iterable[tuple]]):
    """A function for ``mapInArrow``: ``of(key, rows)`` gives the output rows of a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for key, rows in groups(batches, keys) for out in of(key, rows)), schema)

    return run


# ---------------------------------------------------------------- one id
def flow_matches(copies: list[tuple[str, list[str | None]]], cut: list[list[tuple]]) -> list[list[tuple[int, int] | None]]:
    """Per way (straight code, programs with blocks) the (matched, total) of every member above 0.

    ``copies``: (language, texts) of the rows of one id; ``cut``: their ``token_lists``.
    """
    out = []
    blocks = [any(map(has_blocks, texts)) for _, texts in copies]
    for way in (False, True):
        mine = [(lang, lists) for (lang, _), lists, b in zip(copies, cut, blocks) if b == way]
        if not mine:
            continue
        counts = []
        for m in range(max(len(lists) for _, lists in mine)):
            have = [(lang, lists[m]) for lang, lists in mine if m < len(lists)]
            if way:
                rows = _merged([_rows(x[2], x[3]) for _, x in have])
                counts.append(flow_items(*reaching(rows, have[0][0])))
            else:
                occurs = [occurrences(_rows(x[0], x[1]), lang) for lang, x in have]
                occurs = occurs[0] if len(occurs) == 1 else sorted((o for c in occurs for o in c), key=lambda o: o[0])
                counts.append(flow_items(occurs, straight_defs(occurs, len(have) == 1)))
        if counts:
            out.append(matched(counts))
    return out


def _sexprs(have: list[tuple[str | None, tuple]]) -> list[str]:
    """The s-expressions of a program from (language, ``token_lists``) of its copies."""
    if len(have) == 1:
        return signatures(have[0][1][2], have[0][0])
    rows = _merged([_rows(x[2], x[3]) for _, x in have])
    return signatures([r[2] for r in rows], have[0][0] if have else None, [r[0] for r in rows])


def syntax_matches(copies: list[tuple[str, list[str | None]]], cut: list[list[tuple]]) -> list[tuple[int, int] | None]:
    counts = [Counter(_sexprs([(lang, lists[m]) for (lang, _), lists in zip(copies, cut) if m < len(lists)]))
              for m in range(max(map(len, cut), default=0))]
    return matched(counts, hit_only=True) if counts else []


def best(stats: list[tuple], parts: Callable[[tuple], tuple]) -> tuple:
    """Of the statistics of several languages those with the highest BLEU of method 1; ``parts``: its num, den, hyp_len, ref_len."""
    if len(stats) == 1:
        return stats[0]

    def score(s: tuple) -> float:
        nums, dens, hyp, ref = parts(s)
        if not nums[0]:
            return 0.0
        penalty = 1.0 if ref is None or hyp is None or hyp > ref else 0.0 if not hyp else math.exp(1 - ref / hyp)
        return penalty * math.exp(sum(math.log((a or 0.1) / b) for a, b in zip(nums, dens)) / len(nums))

    return max(stats, key=score)


# ---------------------------------------------------------------- frames
def longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def by_program(rows: DataFrame, columns: Sequence[str], fields: Sequence[T.StructField],
               of: Callable[[tuple, list[tuple]], Iterable[tuple]]) -> DataFrame:
    """The rows that ``of(key, its rows)`` makes of every program inside the task.

    ``columns`` begin with the key, by which ``rows`` are hash partitioned already; the output has the key and ``fields``.
    """
    laid = rows.where(F.col(columns[0]).isNotNull()).select(*columns).sortWithinPartitions(columns[0])
    out = T.StructType([laid.schema[columns[0]], *fields])
    return laid.mapInArrow(in_groups(1, to_arrow_schema(out), of), out)


def signature_counts(programs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, signature, cnt``: the subtree signatures of every program, suites of Python programs included.

    What ``structure.subtree_signatures`` gives over ``code_structure_tokens`` of a token table with layout.
    """
    def of(id_, same):
        sexprs = _sexprs([(x, token_lists(t, x)) for _, t, x in same])
        counts = Counter(hashlib.md5(s.encode()).hexdigest() for s in sexprs)
        return ((id_[0], s, n) for s, n in counts.items())

    return by_program(programs, [key, text, lang], [T.StructField("signature", T.StringType()), *longs("cnt")], of)


def reached_lines(programs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, use_line, var, def_line``: every definition that reaches a use over branches and loops (``dataflow.merged_uses``)."""
    def of(id_, same):
        occurs, defs = reaching(_merged([_rows(*token_lists(t, x)[2:]) for _, t, x in same]), same[0][2])
        at: dict[int, int] = {}
        for pos, line, _, role in occurs:
            if role > 1:
                at[pos] = max(line, at.get(pos, line))
        return ((id_[0], line, name, at[d]) for (_, line, name, _), found in zip(occurs, defs) for d in found)

    return by_program(programs, [key, text, lang], [*longs("use_line"), T.StructField("var", T.StringType()), *longs("def_line")], of)
