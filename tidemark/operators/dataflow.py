"""Code tokens and data flow (definitions and uses) as one generic DataFrame job.

Re-aimed from per-language syntax-tree walkers: the program is cut into an
ordered token table; a name followed by an assignment operator, or preceded
by a type word, is a definition (``comesFrom`` for declarations,
``computedFrom`` for assignments); every other name is a use. In straight code
a use comes from the last definition of the same name on an earlier line; in
programs with blocks from all definitions that reach it over branches and loops
(``reaching``). The uses to the right of a definition on its line are that
definition's parents.

Plan: programs are hash partitioned by id once. Tokens are exploded inside
the task; every window and aggregation afterwards is keyed by (id, ...), which
the existing partitioning satisfies, so the job has a single shuffle. Each
token row emits its node records (head, parent link, "is a parent" marker) in
one explode, so nodes are assembled by one aggregation instead of joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.comments import STRING_NL, strip_comments
from tidemark.functions.keywords import KEYWORDS, LANG_CODE
from tidemark.functions.text import col_
from tidemark.operators.reaching import BRANCH_PATTERN, DEDENT, INDENT, reaching, with_regions
from tidemark.session import fanout_partitions

# --- fixed values: token pattern, assignment operators, declaration type words
TOKEN = (
    '"""[\\s\\S]*?"""' "|'''[\\s\\S]*?'''"
    '|"[^"\\\\\\n]*(?:\\\\.[^"\\\\\\n]*)*"'
    "|'[^'\\\\\\n]*(?:\\\\.[^'\\\\\\n]*)*'"
    "|[A-Za-z_][A-Za-z0-9_]*"
    "|[0-9]+(?:\\.[0-9]+)?"
    "|==|!=|<=|>=|\\+=|-=|\\*=|/=|%=|&&|\\|\\||<<|>>|->|::|\\+\\+|--"
    "|[^\\s]"
)
ASSIGN_OPS = ("=", "+=", "-=", "*=", "/=", "%=")
TYPE_WORDS = ("int", "long", "short", "float", "double", "char", "bool", "boolean", "byte", "auto", "var",
              "String", "unsigned", "signed", "void")

# bytes of token rows, with what the windows above them hold, per byte of compressed columns that programs are built from
FANOUT = 500
LAYOUT_FANOUT = 2000

# loop targets are definitions: "for x in xs", "for a, b in xs", and "for (Type x : xs)"
LOOP_OPENERS = ("for", "foreach", ",")
LOOP_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"
NOT_TYPES = tuple(dict.fromkeys(w for words in KEYWORDS.values() for w in words if w not in TYPE_WORDS))


@dataclass(frozen=True)
class FlowRules:
    """What makes a name a definition; one set serves the three languages, another can be passed for a fourth."""

    assign_ops: tuple[str, ...] = ASSIGN_OPS
    type_words: tuple[str, ...] = TYPE_WORDS
    loop_openers: tuple[str, ...] = LOOP_OPENERS

    def defines(self) -> Column:
        prev, nxt = F.col("prev_tok"), F.col("next_tok")
        declared = prev.rlike(LOOP_NAME) & ~prev.isin(*NOT_TYPES)  # a class name in front
        loop = ((nxt == "in") & (prev.isin(*self.loop_openers) | declared)) | ((nxt == ":") & declared)
        return F.coalesce(nxt.isin(*self.assign_ops), F.lit(False)) | F.coalesce(prev.isin(*self.type_words), F.lit(False)) | \
            F.coalesce(loop, F.lit(False))

    def defines_sql(self) -> str:
        def words(ws):
            return ", ".join("'" + w + "'" for w in ws)

        declared = f"(regexp_matches(prev_tok, '{LOOP_NAME}') AND prev_tok NOT IN ({words(NOT_TYPES)}))"
        return (f"(coalesce(next_tok IN ({words(self.assign_ops)}), false) OR coalesce(prev_tok IN ({words(self.type_words)}), false) "
                f"OR coalesce((next_tok = 'in' AND (prev_tok IN ({words(self.loop_openers)}) OR {declared})) "
                f"OR (next_tok = ':' AND {declared}), false))")


def _is_keyword(token: Column, lang: Column) -> Column:
    """Set membership per language: one hash probe per token."""
    out = F.lit(False)
    for name, code in LANG_CODE.items():
        out = F.when(lang == name, token.isin(*KEYWORDS[code])).otherwise(out)
    return out


def _lines(code: Column) -> Column:
    """The lines of a text without comments, counted by all its line feeds: a string over lines stands on its first."""
    lines = F.split(code, "\n", -1)
    # a string over lines leaves as many empty lines behind it as it has line feeds
    spread = F.flatten(F.transform(lines, lambda ln: F.concat(F.array(ln), F.array_repeat(
        F.lit(""), F.size(F.split(ln, STRING_NL, -1)) - 1))))
    return F.when(code.contains(STRING_NL), spread).otherwise(lines)


def _layout_events(lines: Column, found: Column) -> Column:
    """Per line ``(line, closes, opens)``: suites that end and begin before it, by an indentation stack; one more for the end.

    Lines inside brackets, after a backslash and without tokens don't count.
    """
    kind = "struct<open:array<int>,par:int,wraps:boolean,out:array<struct<closes:int,opens:int>>>"
    start = F.struct(F.array(F.lit(0)).alias("open"), F.lit(0).alias("par"), F.lit(False).alias("wraps"),
                     F.array().cast("array<struct<closes:int,opens:int>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        toks = x["toks"]
        depth = F.length(F.regexp_replace(F.regexp_extract(x["line"], "^([ \t\f]*)", 1), "\t", "        "))
        kept = F.filter(acc["open"], lambda d: d <= depth)
        deeper = F.element_at(kept, -1) < depth
        counts = (F.size(toks) > 0) & (acc["par"] <= 0) & ~acc["wraps"]
        par = acc["par"] + F.size(F.filter(toks, lambda t: t.isin("(", "[", "{"))) - F.size(F.filter(toks, lambda t: t.isin(")", "]", "}")))
        event = F.struct(F.when(counts, F.size(acc["open"]) - F.size(kept)).otherwise(0).alias("closes"),
                         F.when(counts & deeper, 1).otherwise(0).alias("opens"))
        stack = F.when(~counts, acc["open"]).when(deeper, F.concat(kept, F.array(depth))).otherwise(kept)
        wraps = F.when(F.size(toks) == 0, acc["wraps"]).otherwise(F.element_at(toks, -1) == "\\")
        return F.struct(stack.alias("open"), par.alias("par"), wraps.alias("wraps"), F.concat(acc["out"], F.array(event)).alias("out")).cast(kind)

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct((F.size(acc["open"]) - 1).alias("closes"), F.lit(0).alias("opens"))))

    rows = F.zip_with(lines, found, lambda ln, toks: F.struct(ln.alias("line"), toks.alias("toks")))
    return F.aggregate(rows, start, step, finish)


def token_table(programs: DataFrame, ids: Sequence[str], text: str, lang: str, laid: bool = False, layout: bool = False) -> DataFrame:
    """``ids, pos, line, token, kind, prev_tok, next_tok`` with comments removed first.

    kind: string, number, keyword, name, op. Positions are 0-based over the
    whole program; lines are 0-based and counted by line feeds, those inside
    strings included; a string over several lines is one token. ``laid`` tells
    that the programs are hash partitioned by some of ``ids`` already, so nothing
    is shuffled. With ``layout`` the suites of Python programs stand between
    tokens ``<indent>`` and ``<dedent>`` of kind layout, and ``lang`` and
    ``rpos``, the position without them, are added.
    """
    ids = list(ids)
    keyed = programs.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in ids)))  # same plan in every consumer
    # a column of its own: the expressions below use it more than once
    keyed = keyed.select(*ids, lang, strip_comments(text, lang, one_line=True).alias("_code"))
    lines = _lines(F.col("_code"))

    def tokens_of(ln: Column) -> Column:
        return F.regexp_extract_all(ln, F.lit(TOKEN), F.lit(0))

    def feeds(t: Column) -> Column:
        return F.size(F.split(t, STRING_NL, -1)) - 1

    def flat_of(found: Column) -> Column:
        plain = F.flatten(F.transform(found, lambda toks, i: F.transform(toks, lambda t: F.struct(i.alias("line"), t.alias("tok")))))
        # behind a string over lines stand tokens of its last line
        behind = F.flatten(F.transform(found, lambda toks, i: F.transform(toks, lambda t, j: F.struct(
            (i + F.aggregate(F.slice(toks, F.lit(1), j), F.lit(0), lambda n, x: n + feeds(x))).alias("line"), t.alias("tok")))))
        over = F.exists(found, lambda toks: F.exists(toks, lambda t: t.contains(STRING_NL)))
        return F.when(over, behind).otherwise(plain)

    # tokenize before the shuffle: the exchange then carries token arrays and is
    # reused by every consumer; the array is also a column, so the lambda below
    # does not re-run the tokenizer for every element
    if layout:
        cut = keyed.select(*ids, lang, lines.alias("_lines")).select("*", F.transform("_lines", tokens_of).alias("_found"))
        suites = (F.col(lang) == "Python") & F.exists("_lines", lambda ln: ln.rlike("^[ \t\f]"))
        cut = cut.select("*", F.when(suites, _layout_events(F.col("_lines"), F.col("_found"))).alias("_events"))
        marks = F.zip_with(
            F.concat("_found", F.array(F.array().cast("array<string>"))), "_events", lambda toks, e: F.concat(
                F.array_repeat(F.lit(DEDENT), e["closes"]), F.array_repeat(F.lit(INDENT), e["opens"]), toks))
        staged = cut.select(*ids, lang, F.when(F.col("_events").isNull(), F.col("_found")).otherwise(marks).alias("_found")).select(
            *ids, lang, flat_of(F.col("_found")).alias("_flat"))
    else:
        staged = keyed.select(*ids, lang, F.transform(lines, tokens_of).alias("_found")).select(
            *ids, lang, flat_of(F.col("_found")).alias("_flat"))
    if not laid:
        staged = staged.repartition(fanout_partitions(staged, LAYOUT_FANOUT if layout else FANOUT), *ids)
    f = F.col("_flat")
    with_ctx = F.transform(f, lambda x, i: F.struct(
        x["line"].alias("line"), x["tok"].alias("tok"),
        F.get(f, i - 1)["tok"].alias("prev_tok"), F.get(f, i + 1)["tok"].alias("next_tok")))
    exploded = staged.select(*ids, lang, F.posexplode(with_ctx).alias("pos", "t"))
    tok = F.col("t.tok")
    kind = (
        F.when(tok.startswith('"') | tok.startswith("'"), "string")
        .when(tok.rlike("^[0-9]"), "number")
        .when(_is_keyword(tok, F.col(lang)), "keyword")
        .when(tok.rlike("^[A-Za-z_]"), "name")
        .otherwise("op")
    )
    if layout:
        kind = F.when(tok.isin(INDENT, DEDENT), "layout").otherwise(kind)
    out = exploded.select(
        *ids, *([F.col(lang).alias("lang")] if layout else []), F.col("pos").cast("bigint").alias("pos"),
        F.col("t.line").cast("bigint").alias("line"),
        F.when(tok.contains(STRING_NL), F.translate(tok, STRING_NL, "\n")).otherwise(tok).alias("token"), kind.alias("kind"),
        F.col("t.prev_tok").alias("prev_tok"), F.col("t.next_tok").alias("next_tok"),
    )
    if layout:
        so_far = Window.partitionBy(*ids).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("rpos", F.coalesce(F.sum(F.when(F.col("kind") != "layout", 1).otherwise(0)).over(so_far), F.lit(0)).cast("bigint"))
    return out


def branches(text) -> Column:
    """Whether a program text may hold a block that branches or loops; null texts don't."""
    c = col_(text)
    # a plain search leaves the pattern, which is tried at every character, to the few texts that may match
    may = c.contains("if") | c.contains("for") | c.contains("while") | c.contains("do")
    return F.coalesce(may & c.rlike(BRANCH_PATTERN), F.lit(False))


def _roles(tokens: DataFrame, rules: FlowRules) -> tuple[Column, Column, Column]:
    """(is_def, is_use, relation) of a token row."""
    name = (F.col("kind") == "name") & ~F.col("next_tok").eqNullSafe("(")
    is_def = name & rules.defines()
    rel = F.when(F.col("prev_tok").isin(*rules.type_words), "comesFrom").otherwise("computedFrom")
    return is_def, name & ~is_def, rel


def straight_uses(tokens: DataFrame, ids: Sequence[str], rules: FlowRules = FlowRules()) -> DataFrame:
    """``ids, pos, line, token, is_def, is_use, rel, defs``: the last definition on an earlier line reaches a use."""
    ids = list(ids)
    is_def, is_use, rel = _roles(tokens, rules)
    t = tokens.select(*ids, "pos", "line", "token", is_def.alias("is_def"), is_use.alias("is_use"), rel.alias("rel")).where(
        F.col("is_def") | F.col("is_use"))
    w_name = Window.partitionBy(*ids, "token").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("is_def"), F.col("pos"))).over(w_name)
    return t.select("*", last.alias("def_pos"))


def merged_uses(tokens: DataFrame, ids: Sequence[str], rules: FlowRules = FlowRules()) -> DataFrame:
    """The same rows for programs with blocks, from tokens with layout: ``defs`` holds all definitions that reach a use."""
    ids = list(ids)
    is_def, is_use, rel = _roles(tokens, rules)
    t = with_regions(tokens, ids)
    t = t.withColumn("is_def", F.coalesce(is_def, F.lit(False))).withColumn("is_use", F.coalesce(is_use, F.lit(False))).withColumn("rel", rel)
    met = reaching(t, ids, "token", ["pos", "rpos", "line", "token", "rel"])
    return met.select(*ids, F.col("rpos").alias("pos"), "line", "token", "is_def", "is_use", "rel", "defs")


def nodes(tokens: DataFrame, ids: Sequence[str], rules: FlowRules = FlowRules()) -> DataFrame:
    """Data-flow nodes of straight code from its token table."""
    return merged_nodes(straight_uses(tokens, ids, rules), ids)


def merged_nodes(uses: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Data-flow nodes merged by position: ``ids, pos, var, rel, parents array<struct<ppos,name>>, is_parent``.

    ``uses``: rows of ``straight_uses`` (one reaching definition, ``def_pos``) or ``merged_uses`` (all of them, ``defs``).
    """
    ids = list(ids)
    w_line = Window.partitionBy(*ids, "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = uses.withColumn("stmt_pos", F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(w_line))
    rec = "struct<node:bigint,head:boolean,var:string,rel:string,ppos:bigint,pname:string,marker:boolean>"

    def r(node, head, var, rel_, ppos, pname, marker):
        return F.struct(node.cast("bigint").alias("node"), F.lit(head).alias("head"), var.alias("var"), rel_.alias("rel"),
                        ppos.cast("bigint").alias("ppos"), pname.alias("pname"), F.lit(marker).alias("marker"))

    none_s = F.lit(None).cast("string")
    none_l = F.lit(None).cast("bigint")
    pos, tokc = F.col("pos"), F.col("token")
    if "defs" in uses.columns:
        from_defs = [F.array(r(pos, True, tokc, F.lit("comesFrom"), none_l, none_s, False)),
                     F.transform("defs", lambda d: r(pos, True, tokc, F.lit("comesFrom"), d, tokc, False)),
                     F.transform("defs", lambda d: r(d, False, none_s, none_s, none_l, none_s, True))]
    else:
        from_defs = [F.array(
            r(pos, True, tokc, F.lit("comesFrom"), F.col("def_pos"), F.when(F.col("def_pos").isNotNull(), tokc), False),
            F.when(F.col("def_pos").isNotNull(), r(F.col("def_pos"), False, none_s, none_s, none_l, none_s, True)))]
    use_recs = F.concat(*[x.cast(f"array<{rec}>") for x in (*from_defs, F.array(
        F.when(F.col("stmt_pos").isNotNull(), r(F.col("stmt_pos"), False, none_s, none_s, pos, tokc, False)),
        F.when(F.col("stmt_pos").isNotNull(), r(pos, False, none_s, none_s, none_l, none_s, True))))])
    def_recs = F.array(r(pos, True, tokc, F.col("rel"), none_l, none_s, False))
    recs = F.filter(F.when(F.col("is_def"), def_recs.cast(f"array<{rec}>")).otherwise(use_recs), lambda x: x.isNotNull())
    e = t.select(*ids, F.explode(recs).alias("x")).select(*ids, "x.*")
    parents = F.array_sort(F.collect_list(F.when(F.col("pname").isNotNull(), F.struct(F.col("ppos"), F.col("pname")))))
    return (
        e.groupBy(*ids, "node")
        .agg(
            F.max(F.when(F.col("head"), F.col("var"))).alias("var"),
            F.max(F.when(F.col("head"), F.col("rel"))).alias("rel"),
            parents.alias("parents"),
            F.bool_or("marker").alias("is_parent"),
            F.bool_or("head").alias("has_head"),
        )
        .where("has_head")
        .select(*ids, F.col("node").alias("pos"), "var", "rel", "parents", "is_parent")
    )


def program_nodes(programs: DataFrame, ids: Sequence[str], text: str, lang: str) -> DataFrame:
    """Data-flow nodes of all programs; those with blocks take the way over their regions."""
    ids = list(ids)
    straight = straight_uses(token_table(programs.where(~branches(text)), ids, text, lang), ids)
    merged = merged_uses(token_table(programs.where(branches(text)), ids, text, lang, layout=True), ids)
    return merged_nodes(straight, ids).unionByName(merged_nodes(merged, ids))


def edges(node_df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per (node, parent); nodes without parents keep one row with NULL parent."""
    ids = list(ids)
    return node_df.select(*ids, "pos", "var", "rel", F.explode_outer("parents").alias("p")).select(
        *ids, "pos", "var", "rel", F.col("p.pname").alias("parent"), F.col("p.ppos").alias("parent_pos"))


def normalized(node_df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Kept nodes (with parents, or a parent of another node) with names renamed ``var_i``
    by first appearance (parents before the node's own name): ``ids, pos, var, rel, parents``.

    Definitions of one name that reach a use together are one parent name; an
    operand that a statement repeats is repeated.
    """
    ids = list(ids)
    kept = node_df.where((F.size("parents") > 0) | F.col("is_parent"))
    own = (F.col("rel") == "comesFrom") & F.forall("parents", lambda p: p["pname"] == F.col("var"))
    kept = kept.withColumn("parents", F.when(own, F.slice("parents", 1, 1)).otherwise(F.col("parents")))
    seq = F.concat(
        F.transform("parents", lambda p, i: F.struct(i.alias("sub"), p["pname"].alias("name"))),
        F.array(F.struct(F.size("parents").alias("sub"), F.col("var").alias("name"))),
    )
    names = kept.select(*ids, "pos", "rel", F.posexplode(seq).alias("k", "s")).select(
        *ids, "pos", "rel", F.col("s.sub").alias("sub"), F.col("s.name").alias("name"))
    first = F.min(F.struct("pos", "sub")).over(Window.partitionBy(*ids, "name"))
    names = names.withColumn("_first", first)
    names = names.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*ids).orderBy("_first")))
    names = names.withColumn("vname", F.concat(F.lit("var_"), (F.col("_rank") - 1).cast("string")))
    per_node = names.groupBy(*ids, "pos").agg(
        F.max("rel").alias("rel"),
        F.max_by("vname", "sub").alias("var"),
        F.array_sort(F.collect_list(F.struct("sub", "vname"))).alias("_all"),
    )
    plist = F.transform(F.slice("_all", 1, F.size("_all") - 1), lambda x: x["vname"])
    return per_node.select(*ids, "pos", "var", "rel", F.array_join(plist, ",").alias("parents"))


def group_match(items: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """``group, member, matched, total`` for every member above 0 against member 0 of its group.

    One count per (group, member, item) and a window over (group, item): no join,
    so frames partitioned by ``group`` stay where they are.
    """
    c = items.groupBy(group, member, item).agg(F.count(F.lit(1)).alias("rc"))
    own = F.max(F.when(F.col(member) == 0, F.col("rc"))).over(Window.partitionBy(group, item))
    c = c.withColumn("cc", F.coalesce(own, F.lit(0))).where(F.col(member) > 0)
    return c.groupBy(group, member).agg(
        F.sum(F.least("rc", "cc")).cast("bigint").alias("matched"), F.sum("rc").cast("bigint").alias("total"))
