"""Definitions that reach a use, over the blocks of every program, as windows over one frame.

Blocks ("regions"): the arms of an if and the bodies of loops, delimited by
braces, by the end of a single statement, or by layout tokens (suites). Every
definition and every use knows the regions around it, outermost first, and
climbs them from the innermost out:

* a use that no definition of its name covers in its region looks on before
  the region's whole statement;
* a definition that no later one covers in its region holds on after the
  statement; it covers there in turn if the statement is a loop, or an if with
  an else whose arms all cover the name;
* in a loop, what holds at the end of the body also reaches what looks out of
  its start (a loop's body is taken to run at least once).

A use is reached by what holds at its place in each region it looks into, so
ends of arms are united. One level of regions is one step: running counts of
covering definitions number the stretches of a region, and a use meets the
definitions before it in its own stretch. Definitions hold from the next line on.

All windows are keyed by the program first, so a program's rows are shuffled once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import MAX_PARTITIONS, checkpoint_dir

# --- fixed values: layout tokens, words that branch
INDENT, DEDENT = "<indent>", "<dedent>"
CONDITIONAL = ("if", "elif", "for", "foreach", "while")
LOOPS = ("for", "foreach", "while", "do")
PYTHON_WORDS = ("if", "elif", "else", "for", "while")
BRANCH_PATTERN = r"(^|[^A-Za-z0-9_])(if|for|foreach|while|do)([^A-Za-z0-9_]|$)"

#: Rows of a task of the steps over the levels; one comes to about two kilobytes in their windows.
TASK_ROWS = 400_000

_ROOT = -1


def _layout() -> Column:
    return F.col("token").isin(INDENT, DEDENT)


def with_regions(tokens: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The token rows; those that begin a region's body have ``region`` (number, kind, start, end, first and last line).

    ``tokens``: ids, lang, pos, line, token, prev_tok, next_tok, with layout tokens.
    """
    ids = list(ids)
    token, python = F.col("token"), F.col("lang") == "Python"
    opens = (token == INDENT) | (~python & (token == "{"))
    closes = (token == DEDENT) | (~python & (token == "}"))
    inner = F.when(token.isin("(", "[") | (python & (token == "{")), 1).when(
        token.isin(")", "]") | (python & (token == "}")), -1).otherwise(0)
    order = Window.partitionBy(*ids).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.select(
        "*", opens.alias("opens"), closes.alias("closes"), F.sum(inner).over(so_far).alias("par"),
        F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far).alias("deep"),
        (F.col("prev_tok").isNull() | F.col("prev_tok").isin(INDENT, DEDENT) | (F.lag("line").over(order) < F.col("line"))).alias("first"),
        F.max("pos").over(Window.partitionBy(*ids)).alias("last_pos"))
    t = t.withColumn("deep", F.when(F.col("closes"), F.col("deep") + 1).otherwise(F.col("deep")))  # a closer belongs to its block
    says = (~python & token.isin(*CONDITIONAL, "else", "do")) | (python & F.col("first") & token.isin(*PYTHON_WORDS))
    joined = ~python & (token == "if") & F.col("prev_tok").eqNullSafe("else")
    kind = (F.when(~says | (~python & (token == "else") & F.col("next_tok").eqNullSafe("if")), None)
            .when(token.isin(*LOOPS), "loop").when(joined, "elif").otherwise(token))
    t = t.withColumn("word", F.when(kind.isNotNull(), F.struct(
        (F.col("pos") - F.when(joined, 1).otherwise(0)).alias("number"), kind.alias("kind"), F.col("line").alias("first_line"))))
    # a header ends at the first closing bracket (or colon) on the word's own level
    ender = F.when(python, token == ":").otherwise(token == ")")
    headed = F.col("word").isNotNull() & (python | token.isin(*CONDITIONAL))
    level = Window.partitionBy(*ids, "par").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(headed, F.struct(F.lit(True).alias("open"), F.col("word").alias("word")))
                    .when(ender, F.struct(F.lit(False).alias("open"), F.lit(None).cast(t.schema["word"].dataType).alias("word"))),
                    ignorenulls=True).over(level)
    t = t.withColumn("before", before)
    ended = F.when(ender & F.col("before.open"), F.col("before.word")).when(
        F.col("word").isNotNull() & ~headed, F.col("word"))
    t = t.withColumn("body_of", F.lag(ended).over(order))
    # where the body that begins here ends: its closer, the statement's end, or the line's end
    after = Window.partitionBy(*ids, "deep").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    # a closing layout token stands before the next line's tokens
    spot = F.struct("pos", (F.col("line") - F.when(token == DEDENT, 1).otherwise(0)).alias("line"))
    closer = F.min(F.when(F.col("closes"), spot)).over(after)
    statement = F.min(F.when(token == ";", spot)).over(
        Window.partitionBy(*ids, "deep", "par").orderBy("pos").rowsBetween(0, Window.unboundedFollowing))
    line_end = F.max(F.when(~_layout(), spot)).over(Window.partitionBy(*ids, "line"))
    end = F.when(F.col("opens"), closer).when(python, line_end).otherwise(statement)
    whole = F.coalesce(end, F.struct(F.col("last_pos").alias("pos"), F.col("line").alias("line")))
    t = t.withColumn("end", whole)
    number = F.col("body_of.number")
    region = F.when(F.col("body_of").isNotNull(), F.struct(
        number.alias("number"), F.col("body_of.kind").alias("kind"),
        F.when(F.col("body_of.kind") == "loop", number).otherwise(F.col("pos")).alias("start"), F.col("end.pos").alias("end"),
        F.col("body_of.first_line").alias("l0"), F.col("end.line").alias("l1")))
    return t.withColumn("region", region)


_ORDER = ("at", "turn", "outer", "number")


def _depths(events: DataFrame, ids: list[str]) -> DataFrame:
    """``depth`` of every event: regions open there, itself included."""
    so_far = Window.partitionBy(*ids).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum(F.when(F.col("turn") == 0, 1).when(F.col("turn") == 2, -1).otherwise(0)).over(so_far))


def with_paths(rows: DataFrame, ids: Sequence[str], payload: Sequence[str]) -> tuple[DataFrame, int]:
    """(the rows that define or use a name, with ``path``: the regions around them, outermost first; the deepest level).

    ``rows`` have ``region`` and the boolean columns is_def and is_use beside the payload.
    """
    ids, payload = list(ids), list(payload)
    folder = checkpoint_dir(rows.sparkSession)
    occurs = F.col("is_def") | F.col("is_use")
    r = F.col("region")

    def event(at: Column, turn: int, outer: Column, number: Column, when: Column) -> Column:
        return F.when(when, F.struct(at.cast("long").alias("at"), F.lit(turn).alias("turn"), outer.cast("long").alias("outer"),
                                     number.cast("long").alias("number")))

    zero = F.lit(0)
    kinds = F.array_compact(F.array(
        event(r["start"], 0, -r["end"], r["number"], r.isNotNull()), event(F.col("pos"), 1, zero, zero, occurs),
        event(r["end"], 2, zero, r["number"], r.isNotNull())))
    events = rows.where(occurs | r.isNotNull()).select(*ids, *payload, "is_def", "is_use", "region", F.explode(kinds).alias("e")).select(
        *ids, *payload, "is_def", "is_use", "region", "e.*")
    # columns on the shared folder: a checkpoint would hold the rows uncompressed, ten times as large
    spark = rows.sparkSession
    path = f"{folder.rstrip('/')}/tidemark-regions/{uuid.uuid4().hex}"
    events = _depths(events, ids)
    events.write.parquet(path)
    events = spark.read.schema(events.schema).parquet(path)
    deepest, count = events.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count(F.lit(1))).first()
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    events = events.repartition(max(base, min(MAX_PARTITIONS, -(-count // TASK_ROWS))), *ids)
    so_far = Window.partitionBy(*ids).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)

    def around(value: Column) -> list[Column]:
        """The last region begun at each depth, as far as it is still open."""
        return [F.when(F.col("depth") >= k + F.when(F.col("turn") == 0, 1).otherwise(0), F.last(F.when(
            (F.col("turn") == 0) & (F.col("depth") == k), value), ignorenulls=True).over(so_far)) for k in range(1, deepest + 1)]

    starts = events.withColumn("parent", F.coalesce(*reversed(around(F.col("number"))), F.lit(_ROOT).cast("long")))
    # the arms of one if: an arm that follows another at once goes on with its statement
    arm = (F.col("turn") == 0)
    siblings = Window.partitionBy(*ids, "turn", "parent").orderBy("number")
    last = F.lag(F.struct(F.col("region.kind").alias("kind"), F.col("region.end").alias("end"))).over(siblings)
    starts = starts.withColumn("goes_on", arm & F.col("region.kind").isin("elif", "else") & F.coalesce(
        last["kind"].isin("if", "elif") & (last["end"] + 1 == F.col("number")), F.lit(False)))
    starts = starts.withColumn("statement", F.max(F.when(~F.col("goes_on"), F.col("number"))).over(
        siblings.rowsBetween(Window.unboundedPreceding, 0)))
    arms = Window.partitionBy(*ids, "turn", "parent", "statement")
    known = starts.withColumn("info", F.when(arm, F.struct(
        "number", "statement", (F.col("region.kind") == "loop").alias("loop"), F.count(F.lit(1)).over(arms).alias("arms"),
        F.max(~F.col("region.kind").isin("if", "elif")).over(arms).alias("sure"),
        F.min("region.l0").over(arms).alias("l0"), F.max("region.l1").over(arms).alias("l1"), F.max("region.end").over(arms).alias("end"))))
    path = F.array_compact(F.array(*around(F.col("info")))) if deepest else F.array().cast(
        "array<struct<number:bigint,statement:bigint,loop:boolean,arms:bigint,sure:boolean,l0:bigint,l1:bigint,end:bigint>>")
    return known.withColumn("path", path).where("turn = 1").select(*ids, *payload, "is_def", "is_use", "path"), deepest


def reaching(rows: DataFrame, ids: Sequence[str], name: str, payload: Sequence[str]) -> DataFrame:
    """The rows that define or use a name, with ``defs``: positions of the definitions that reach a use (empty for definitions).

    ``rows`` as ``with_regions`` gives them, with is_def, is_use and the payload: pos, line, ``name``, ``rpos`` (the position to report) and more.
    """
    ids = list(ids)
    f, deepest = with_paths(rows, ids, payload)
    f = f.select("*", F.col("line").cast("long").alias("x"), F.when(F.col("is_use"), F.lit(-1)).otherwise(F.col("pos")).cast("long").alias("y"),
                 F.col("is_def").alias("covers"), F.lit(True).alias("on"), F.array().cast("array<bigint>").alias("defs"))
    for level in range(deepest, -1, -1):
        here = F.col("on") & (F.size("path") == level)
        top = F.try_element_at("path", F.lit(level)) if level else None
        f = f.withColumn("here", here).withColumn("reg", F.when(here, top["number"] if level else F.lit(_ROOT).cast("long")))
        inside = Window.partitionBy(*ids, name, "reg")
        cover = F.when(F.col("here") & F.col("covers"), 1).otherwise(0)
        f = f.withColumn("stretch", F.sum(cover).over(inside.orderBy("x", "y").rangeBetween(Window.unboundedPreceding, 0)))
        f = f.withColumn("stretches", F.sum(cover).over(inside))
        held = F.when(F.col("here") & F.col("is_def"), F.col("rpos"))
        met = F.collect_list(held).over(Window.partitionBy(*ids, name, "reg", "stretch").orderBy("x", "y"))
        looks = F.col("here") & F.col("is_use")
        f = f.withColumn("defs", F.when(looks, F.array_union("defs", met)).otherwise(F.col("defs")))
        if not level:
            break
        out = F.col("here") & F.when(F.col("is_use"), F.col("stretch") == 0).otherwise(F.col("stretch") == F.col("stretches"))
        f = f.withColumn("out", out).withColumn("top", F.when(F.col("here"), top))
        round_ = F.collect_set(F.when(F.col("out") & F.col("top.loop") & F.col("is_def"), F.col("rpos"))).over(inside)
        f = f.withColumn("defs", F.when(looks & F.col("out") & F.col("top.loop"), F.array_union("defs", round_)).otherwise(F.col("defs")))
        f = f.withColumn("statement", F.col("top.statement"))
        covered = F.size(F.collect_set(F.when(F.col("here") & F.col("covers"), F.col("reg"))).over(
            Window.partitionBy(*ids, name, "statement")))
        f = f.withColumn("covered", covered)
        moves = F.col("here") & F.col("out")
        f = f.select(
            *ids, *payload, "is_def", "is_use", "defs",
            F.when(moves, F.slice("path", 1, level - 1)).otherwise(F.col("path")).alias("path"),
            F.when(moves, F.when(F.col("is_use"), F.col("top.l0")).otherwise(F.col("top.l1"))).otherwise(F.col("x")).alias("x"),
            F.when(moves & F.col("is_def"), F.col("top.end")).otherwise(F.col("y")).alias("y"),
            F.when(moves, F.col("is_def") & F.col("top.sure") & (F.col("covered") == F.col("top.arms"))).otherwise(F.col("covers")).alias("covers"),
            (F.col("on") & (~F.col("here") | F.col("out"))).alias("on"))
    return f.select(*ids, *payload, "is_def", "is_use", F.array_sort("defs").alias("defs"))
