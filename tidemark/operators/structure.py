"""Subtree signatures and syntax match over nested token streams (re-aimed syntax trees).

Input is an ordered token table ``ids, pos, sym, delta`` (+1 opens a node, -1
closes one, 0 is a leaf). Each node is written as an s-expression piece; the
signature of a subtree is the md5 of its s-expression, i.e. of the substring
between its opening and closing piece. Nodes are found without any range or
pairwise join: the k-th opener at depth d closes with the k-th closer at
depth d. Signatures are taken for the root and every node with children.

Plan: the token table arrives hash partitioned by ``ids`` (or some of them); the
running sums, ranks and the one aggregation per program are all keyed by
``ids`` (+ extra keys), so nothing is shuffled and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bleu_formulas import r6
from tidemark.operators.reaching import DEDENT, INDENT

# --- fixed values: structural tags that balance on the fixture pages
PAGE_TAGS = ("nav", "ul", "li", "a", "article", "div", "footer")
PAGE_TAG_RE = "<(/?)(" + "|".join(PAGE_TAGS) + ")[\\s>]"


def page_tokens(pages: DataFrame) -> DataFrame:
    """``page_id, pos, sym, delta`` from the structural tags of each page."""
    slash = F.regexp_extract_all("html", F.lit(PAGE_TAG_RE), F.lit(1))
    name = F.regexp_extract_all("html", F.lit(PAGE_TAG_RE), F.lit(2))
    tags = F.zip_with(slash, name, lambda s, n: F.struct(n.alias("sym"), F.when(s == "/", -1).otherwise(1).alias("delta")))
    staged = pages.select("page_id", tags.alias("_tags")).repartition("page_id")
    return staged.select("page_id", F.posexplode("_tags").alias("pos", "t")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "t.sym", "t.delta")


def code_structure_tokens(tokens: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Brackets and suites (layout tokens) become nodes, other tokens leaves (names, numbers and strings abstracted)."""
    tok = F.col("token")
    sym = F.when(F.col("kind") == "layout", "suite").otherwise(
        F.when(tok.isin("(", ")"), "paren").when(tok.isin("[", "]"), "index").when(tok.isin("{", "}"), "block")
        .when(F.col("kind") == "name", "n").when(F.col("kind") == "number", "1").when(F.col("kind") == "string", "s")
        .otherwise(tok)
    )
    delta = F.when(tok.isin("(", "[", "{", INDENT), 1).when(tok.isin(")", "]", "}", DEDENT), -1).otherwise(0)
    return tokens.select(*ids, "pos", sym.alias("sym"), delta.alias("delta"))


def subtree_signatures(tokens: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``ids, signature`` for the root and every node with at least one child (with multiplicity).

    One aggregation per program gathers its pieces and its node spans; there is
    no join. The s-expression is cut as bytes, so a node costs its own length
    wherever it stands: a record ten times longer takes ten times as long.
    """
    ids = list(ids)
    piece = (F.when(F.col("delta") == 1, F.concat(F.lit("("), F.col("sym")))
             .when(F.col("delta") == -1, F.lit(")")).otherwise(F.concat(F.lit(" "), F.col("sym"))))
    before = Window.partitionBy(*ids).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    keyed = tokens.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in ids)))
    t = keyed.select(*ids, "pos", "delta", piece.alias("piece"))
    t = t.select("*", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)).alias("off"),
                 F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"))
    # the k-th opener at a depth closes with the k-th closer there; leaves stay apart at delta 0
    t = t.withColumn("d", F.when(F.col("delta") == -1, F.col("depth") - 1).otherwise(F.col("depth")))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy(*ids, "d", "delta").orderBy("pos")))
    mate = Window.partitionBy(*ids, "d", "k")
    opener = F.max(F.when(F.col("delta") == 1, F.struct("pos", "off"))).over(mate)
    t = t.withColumn("o", opener)
    closes = (F.col("delta") == -1) & (F.col("pos") > F.col("o.pos") + 1)
    prog = t.groupBy(*ids).agg(
        F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), ""),
                 "UTF-8").alias("sexpr"),
        F.collect_list(F.when(closes, F.struct(F.col("o.off").alias("a"), (F.col("off") + 1).alias("b")))).alias("spans"),
    ).where(F.octet_length("sexpr") > 0)
    sx = F.col("sexpr")
    sigs = F.concat(F.array(F.md5(sx)), F.transform("spans", lambda sp: F.md5(
        F.substring(sx, (sp["a"] + 1).cast("int"), (sp["b"] - sp["a"]).cast("int")))))
    return prog.select(*ids, F.explode(sigs).alias("signature"))


def group_syntax_match(sigs: DataFrame, group: str, member: str) -> DataFrame:
    """``group, member, matched, total`` for every member above 0: its subtrees (with multiplicity) found in member 0.

    Counts and a window over (group, signature): no join, so frames partitioned
    by ``group`` stay where they are.
    """
    c = sigs.groupBy(group, member, "signature").agg(F.count(F.lit(1)).alias("cnt"))
    hit = F.max(F.col(member) == 0).over(Window.partitionBy(group, "signature"))
    c = c.withColumn("hit", hit).where(F.col(member) > 0)
    return c.groupBy(group, member).agg(
        F.sum(F.when(F.col("hit"), F.col("cnt")).otherwise(0)).cast("bigint").alias("matched"),
        F.sum("cnt").cast("bigint").alias("total"))


def syntax_match(ref_sigs: DataFrame, cand_sigs: DataFrame, pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key, matched, total, score``: reference subtrees (with multiplicity) found among the candidate's."""
    r = ref_sigs.groupBy(key, "signature").agg(F.count(F.lit(1)).alias("cnt"))
    c = cand_sigs.select(key, "signature").distinct().withColumn("hit", F.lit(True))
    m = r.join(c, [key, "signature"], "left").groupBy(key).agg(
        F.sum(F.when(F.col("hit"), F.col("cnt")).otherwise(0)).cast("bigint").alias("matched"),
        F.sum("cnt").cast("bigint").alias("total"))
    out = pairs.select(key).join(m, key, "left").select(
        key, F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    return out.withColumn("score", F.expr(f"CASE WHEN total = 0 THEN 0e0 ELSE {r6('CAST(matched AS DOUBLE) / total')} END"))
