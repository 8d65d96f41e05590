"""Reaching definitions, suites and strings over lines: goldens by hand, and random programs against all their runs."""

import random

import pytest

from tidemark.operators import dataflow as D
from tidemark.operators import structure as S


def lines_reached(spark, programs):
    """{program: {(use line, name): lines of the definitions that reach it}}"""
    df = spark.createDataFrame([(k, lang, text) for k, (lang, text) in enumerate(programs)], "id long, lang string, text string")
    rows = D.merged_uses(D.token_table(df, ["id"], "text", "lang", layout=True), ["id"]).collect()
    line = {(r["id"], r["pos"]): r["line"] for r in rows}
    out = [{} for _ in programs]
    for r in rows:
        if r["is_use"]:
            out[r["id"]].setdefault((r["line"], r["token"]), set()).update(line[r["id"], d] for d in r["defs"])
    return out


GOLDENS = [
    # if and else: both arms reach, the value before does not
    ("Python", "x = 1\nif c:\n    x = 2\nelse:\n    x = 3\ny = x", {(5, "x"): {2, 4}, (1, "c"): set()}),
    # no else: the value before reaches too
    ("Python", "x = 1\nif c:\n    x = 2\ny = x", {(3, "x"): {0, 2}, (1, "c"): set()}),
    # elif without else, and one arm without a definition
    ("Python", "x = 1\nif c:\n    x = 2\nelif d:\n    y = x\nelse:\n    x = 3\nz = x",
     {(4, "x"): {0}, (7, "x"): {0, 2, 6}, (1, "c"): set(), (3, "d"): set()}),
    # the end of a loop flows back to its start; it runs at least once
    ("Python", "x = 1\nwhile x:\n    y = x\n    x = y\nz = x",
     {(1, "x"): {0, 3}, (2, "x"): {0, 3}, (3, "y"): {2}, (4, "x"): {3}}),
    ("Python", "t = 0\nfor a in b:\n    if a:\n        t = a\n    u = t\nv = t",
     {(1, "b"): set(), (2, "a"): {1}, (3, "a"): {1}, (4, "t"): {0, 3}, (5, "t"): {0, 3}}),
    # nested loops
    ("Python", "x = 0\nwhile a:\n    while b:\n        y = x\n    x = 1\nz = x",
     {(1, "a"): set(), (2, "b"): set(), (3, "x"): {0, 4}, (5, "x"): {4}}),
    # a string over lines is one token
    ("Python", 's = """a\nx = 1\n\n\'"""\ny = x + s', {(3, "x"): set(), (3, "s"): {0}}),
    # braces, else if, single statements, two blocks on one level
    ("C++", "int x = 1;\nif (c) {\nx = 2;\n} else if (d) {\nx = 3;\n} else {\nx = 4;\n}\ny = x;",
     {(1, "c"): set(), (3, "d"): set(), (8, "x"): {2, 4, 6}}),
    ("Java", "int x = 1;\nif (c)\nx = 2;\nelse\nx = 3;\ny = x;", {(1, "c"): set(), (5, "x"): {2, 4}}),
    ("Java", "int x = 1;\nfor (int i = 0; i < x; i++)\nif (i > 2)\nx = i;\ny = x;",
     {(1, "i"): {1}, (1, "x"): {0, 3}, (2, "i"): {1}, (3, "i"): {1}, (4, "x"): {0, 3}}),
    ("C++", "int x = 1;\ndo {\nx = x + 1;\n}\nwhile (x < 9);\ny = x;", {(2, "x"): {0, 2}, (4, "x"): {2}, (5, "x"): {2}}),
    # a header over lines, and brackets that are no blocks
    ("Python", "x = 1\nif (c and\n  d):\n    x = {'a': 1,\n  'b': 2}\ny = x", {(1, "c"): set(), (2, "d"): set(), (5, "x"): {0, 3}}),
    # a suite on the header's line
    ("Python", "x = 1\nif c: x = 2\nelse: x = 3\ny = x", {(1, "c"): set(), (3, "x"): {1, 2}}),
    # else after a loop is no arm
    ("Python", "x = 1\nfor i in a:\n    x = 2\nelse:\n    x = 3\ny = x", {(1, "a"): set(), (5, "x"): {4}}),
]


def test_goldens(spark):
    found = lines_reached(spark, [(lang, text) for lang, text, _ in GOLDENS])
    for (lang, text, want), got in zip(GOLDENS, found, strict=True):
        got = {k: v for k, v in got.items() if k in want}
        assert got == want, text


# ------------------------------------------------------------ random programs against all their runs
NAMES = ["p", "q", "r"]


def make(rng, depth):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["set", "set", "if", "ifelse", "loop"]) if depth else "set"
        if kind == "set":
            out.append(("set", rng.choice(NAMES), rng.choice(NAMES)))
        else:
            out.append((kind, rng.choice(NAMES), make(rng, depth - 1), make(rng, depth - 1) if kind == "ifelse" else None))
    return out


def write(tree, python, pad, lines, notes):
    for node in tree:
        at = len(lines)
        if node[0] == "set":
            lines.append(f"{pad}{node[1]} = {node[2]}" + ("" if python else ";"))
            notes.append((node, at, None))
            continue
        word = "while" if node[0] == "loop" else "if"
        lines.append(f"{pad}{word} {node[1]}:" if python else f"{pad}{word} ({node[1]}) {{")
        inner: list = []
        write(node[2], python, pad + "    ", lines, inner)
        other: list = []
        if node[3] is not None:
            lines.append(f"{pad}else:" if python else f"{pad}}} else {{")
            write(node[3], python, pad + "    ", lines, other)
        if not python:
            lines.append(f"{pad}}}")
        notes.append((node, at, (inner, other)))


def runs(notes, states, seen):
    """Walk with every set of last definitions; ``seen`` collects (line, name) -> definition lines."""
    for node, at, parts in notes:
        after = set()
        for state in states:
            s = dict(state)
            if node[0] == "set":
                seen.setdefault((at, node[2]), set()).update([s[node[2]]] if node[2] in s else [])
                s[node[1]] = at
                after.add(tuple(sorted(s.items())))
                continue
            if node[0] == "loop":
                now = {tuple(sorted(s.items()))}
                for _ in range(3):
                    for t in now:
                        seen.setdefault((at, node[1]), set()).update([dict(t)[node[1]]] if node[1] in dict(t) else [])
                    now = runs(parts[0], now, seen)
                    after |= now
                continue
            seen.setdefault((at, node[1]), set()).update([s[node[1]]] if node[1] in s else [])
            one = {tuple(sorted(s.items()))}
            after |= runs(parts[0], one, seen)
            after |= runs(parts[1], one, seen) if node[3] is not None else one
        states = after
    return states


def test_random_programs_equal_all_their_runs(spark):
    rng = random.Random(11)
    programs, wanted = [], []
    for k in range(60):
        tree, lines, notes = make(rng, 3), [], []
        write(tree, k % 2 == 0, "", lines, notes)
        seen: dict = {}
        runs(notes, {()}, seen)
        programs.append(("Python" if k % 2 == 0 else "Java", "\n".join(lines)))
        wanted.append(seen)
    for (lang, text), got, want in zip(programs, lines_reached(spark, programs), wanted, strict=True):
        assert got == want, text


def test_straight_code_is_the_same_on_both_ways(spark):
    rng = random.Random(3)
    programs = [("Java", "\n".join(f"{rng.choice(NAMES)} = {rng.choice(NAMES)} + {rng.choice(NAMES)};" for _ in range(30))) for _ in range(5)]
    df = spark.createDataFrame([(k, lang, text) for k, (lang, text) in enumerate(programs)], "id long, lang string, text string")
    a = D.merged_nodes(D.straight_uses(D.token_table(df, ["id"], "text", "lang"), ["id"]), ["id"])
    b = D.merged_nodes(D.merged_uses(D.token_table(df, ["id"], "text", "lang", layout=True), ["id"]), ["id"])
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("lang,text,want", [
    ("Python", 'a = """x\n\n y"""\nb = 1', [(0, "a"), (0, "="), (0, '"""x\n y"""'), (2, "b"), (2, "="), (2, "1")]),
    ("Python", "a = '''x\ny''' + c\nb", [(0, "a"), (0, "="), (0, "'''x\ny'''"), (1, "+"), (1, "c"), (2, "b")]),
    ("Java", 'a = "x//y";\nb', [(0, "a"), (0, "="), (0, '"x//y"'), (0, ";"), (1, "b")]),
])
def test_strings_over_lines(spark, lang, text, want):
    df = spark.createDataFrame([(1, lang, text)], "id long, lang string, text string")
    rows = D.token_table(df, ["id"], "text", "lang").orderBy("pos").collect()
    assert [(r["line"], r["token"]) for r in rows] == want


def test_suites_are_nodes(spark):
    a = "if c:\n    x = 1\n    y = 2\nz = 3"
    b = "if c:\n    x = 1\ny = 2\nz = 3"
    df = spark.createDataFrame([(1, "Python", a), (2, "Python", b), (3, "Python", a.replace("    ", "\t"))], "id long, lang string, text string")
    sig = S.subtree_signatures(S.code_structure_tokens(D.token_table(df, ["id"], "text", "lang", layout=True), ["id"]), ["id"])
    by = {k: sorted(r["signature"] for r in sig.collect() if r["id"] == k) for k in (1, 2, 3)}
    assert len(by[1]) == len(by[2]) == 2 and by[1] != by[2] and by[1] == by[3]


def test_null_empty_and_unclosed_programs(spark):
    rows = [(1, "Python", None), (2, "Python", ""), (3, "Java", "if (c) { x = 1;"), (4, "Python", "  if"), (5, None, "while (a) b"),
            (6, "Python", "if a:\n\tx = 1\n  y = x"), (7, "C++", "} else { x = 1; } while"), (None, "Java", "x = y;")]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    out = D.program_nodes(df, ["id"], "text", "lang")
    assert {r["id"] for r in out.collect()} == {3, 5, 6, 7}
    assert D.program_nodes(df.where("id > 99"), ["id"], "text", "lang").count() == 0


def test_definitions_that_merge_are_one_parent_name(spark):
    text = "x = 1\nif c:\n    x = 2\ny = x * x"
    df = spark.createDataFrame([(1, "Python", text)], "id long, lang string, text string")
    nodes = D.program_nodes(df, ["id"], "text", "lang")
    by_pos = {r["pos"]: [(p["ppos"], p["pname"]) for p in r["parents"]] for r in nodes.collect()}
    assert by_pos[11] == [(0, "x"), (6, "x")] and by_pos[9] == [(11, "x"), (13, "x")]
    norm = {r["pos"]: (r["var"], r["parents"]) for r in D.normalized(nodes, ["id"]).collect()}
    assert norm[11] == ("var_0", "var_0") and norm[9] == ("var_1", "var_0,var_0")
