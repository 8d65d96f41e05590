"""Derived programs with blocks: the statements of an order, four a block, branching by a fixed rule.

A block of four statements is straight code, an if with else, an if without
else or a loop, by its number and the order key. Some Python and Java statements
are followed by a string over three lines that holds an assignment. The rule is also
written in SQL (``tidemark.plans.sql_blocks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import table

SIZE = 4


def block_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, lang, text``: one program per order that has line items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    key = F.col("l_orderkey")
    w = Window.partitionBy(key).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    target = F.concat(F.lit("q"), (F.col("l_partkey") % 3).cast("string"))
    t = li.select(
        key.alias("id"), F.row_number().over(w).alias("ord"), target.alias("target"),
        F.coalesce(F.lag(target).over(w), F.lit("base")).alias("operand"), F.col("l_quantity").cast("long").cast("string").alias("factor"),
        F.col("l_suppkey").cast("string").alias("note"), (F.col("l_returnflag") == "A").alias("noted"),
        F.lead("l_partkey").over(w).isNull().alias("last"))
    python = F.col("id") % 3 == 0
    nth, block = (F.col("ord") - 1) % SIZE, F.floor((F.col("ord") - 1) / SIZE)
    kind = (block + F.col("id")) % 4
    first, other = nth == 0, (kind == 1) & (nth == 2)
    head = (F.when(first & kind.isin(1, 2), F.when(python, "if base > 0:\n").otherwise("if (base > 0) {\n"))
            .when(first & (kind == 3), F.when(python, "while base > 0:\n").otherwise("while (base > 0) {\n"))
            .when(other, F.when(python, "else:\n").otherwise("} else {\n")).otherwise(""))
    pad = F.when(python & (kind != 0), "    ").otherwise("")
    end = F.when(python, "").otherwise(";")
    statement = F.concat(F.when(python, "").otherwise("int "), "target", F.lit(" = "), "factor", F.lit(" * "), "operand", end)
    note = F.when(F.col("noted") & (F.col("id") % 3 < 2), F.concat(
        F.lit("\n"), pad, F.when(python, "").otherwise("String "), F.lit('note = """sup '), "note", F.lit("\nq1 = q2\n\"\"\""), end)).otherwise("")
    foot = F.when(~python & (kind != 0) & (F.col("last") | (nth == SIZE - 1)), "\n}").otherwise("")
    lines = t.select("id", "ord", F.concat(head, pad, statement, note, foot).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    text = F.when(F.col("id") % 3 == 0, F.col("body")).when(
        F.col("id") % 3 == 1, F.concat(F.lit("int f(int base) {\n"), "body", F.lit("\n}"))).otherwise(
        F.concat(F.lit("int main() {\nint base = 1;\n"), "body", F.lit("\n}")))
    lang = F.when(F.col("id") % 3 == 0, "Python").when(F.col("id") % 3 == 1, "Java").otherwise("C++")
    return lines.groupBy("id").agg(body.alias("body")).select("id", lang.alias("lang"), text.alias("text"))
