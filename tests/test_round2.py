"""Goldens and brute force for corpus numbering, sample pages, code trees, renaming and structure."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.code import with_renamed
from tidemark.operators import dataflow as D
from tidemark.operators import structure as S
from tidemark.operators import weighted as W
from tidemark.operators.corpus import attach_samples, grade_of, sequential_ids
from tidemark.operators.pages import sample_io_pairs
from tidemark.sources import files as FS


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_sequential_ids_keep_rows_and_columns(spark, adaptive, reuse):
    ids = random.Random(3).sample(range(10**9), 20000)
    df = spark.createDataFrame([(i, f"payload {i}", i % 7) for i in ids], "id long, text string, k int").repartition(23)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, (adaptive, reuse, "19"), strict=True):
            spark.conf.set(k, v)
        got = sequential_ids(df, "id").collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {i: k for k, i in enumerate(sorted(ids))}
    assert len(got) == len(ids)
    assert all(r.seq == want[r.id] and r.text == f"payload {r.id}" and r.k == r.id % 7 for r in got)


PAGES = {
    # an earlier heading must not swallow the sample heading
    "<h1>Title</h1><h2>Sample Input 1</h2><pre>1</pre><h2>Sample Output 1</h2><pre>2</pre>": [(1, "1", "2")],
    # section headings between the samples
    "<h2>Input</h2><p>n</p><h2>Output</h2><h3>Sample Input 1</h3><pre>1</pre><h3>Sample Output 1</h3><pre>2</pre>"
    "<h3>Sample Input 2</h3><pre>3</pre><h3>Sample Output 2</h3><pre>4</pre>": [(1, "1", "2"), (2, "3", "4")],
    # no number
    "<h2>Sample Input</h2><pre> 5 </pre><h2>Sample Output</h2><pre>6</pre>": [(1, "5", "6")],
    # upper-case tags, output before input, attributes
    "<H2 id=a>Output for the Sample Input</H2><PRE>8</PRE><H2>Sample Input</H2><PRE class=x>7</PRE>": [(1, "7", "8")],
    # other headings, a heading without a block, a repeated heading
    "<h3>入力例 1</h3><pre>a</pre><h3>出力例 1</h3><pre>b</pre><h3>入力例 1</h3><pre>c</pre><h2>Sample Output 9</h2>": [(1, "c", "b")],
    "<h2>Hint</h2><pre>x</pre><prefix>y</prefix>": [],
}


def test_sample_pairs_of_golden_pages(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    got = {}
    for r in sample_io_pairs(pages).collect():
        got.setdefault(r.page_id, []).append((r.ord, r.input, r.expected))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in enumerate(PAGES.values()) if v}


def test_samples_attached_and_graded(spark):
    code = spark.createDataFrame([(1, 7, "a"), (2, 8, "b")], "id long, page_id long, code string")
    pairs = spark.createDataFrame([(7, 2, "x", "y"), (7, 1, "u", "v")], "page_id long, ord long, input string, expected string")
    out = attach_samples(code, pairs, "page_id").withColumn("grade", grade_of("test_case")).collect()
    assert [(r.id, [(t.input, t.expected) for t in r.test_case], r.grade) for r in out] == [(1, [("u", "v"), ("x", "y")], "fine")]
    none = spark.createDataFrame([(1, None), (2, [])], "id long, test_case array<string>")
    assert {r.g for r in none.select(grade_of("test_case").alias("g")).collect()} == {"coarse"}


def test_code_tree_of_user_files(spark, tmp_path):
    for path, body in {"p00001/C++/a.cpp": b"int a;\n\nint b;", "p00001/Java/B.java": "é".encode(), "p00002/Python/c.py": b"pass", "p00002/Python/e.py": b"",
                       "p00002/Python/c.txt": b"no", "p00002/Rust/d.rs": b"no", "p00002/C/bad.c": b"\xff\xfe"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    got = sorted((r.problem, r.lang, r.code) for r in FS.read_code_tree(spark, str(tmp_path)).collect())
    assert got == [("p00001", "C++", "int a;\n\nint b;"), ("p00001", "Java", "é"), ("p00002", "Python", "pass")]


def test_keywords_from_files(spark, tmp_path):
    (tmp_path / "java.txt").write_text("abstract\nassert\n\nassert\n")
    (tmp_path / "c_sharp.txt").write_text("base\n")
    (tmp_path / "notes.txt").write_text("x\n")
    got = sorted((r.kw_lang, r.keyword) for r in W.read_keywords(spark, str(tmp_path)).collect())
    assert got == sorted([(W.LANG_IDS["Java"], "abstract"), (W.LANG_IDS["Java"], "assert"), (W.LANG_IDS["C#"], "base")])


def test_new_names_never_clash_with_words_of_the_record(spark):
    import hashlib

    def new(i, name, digits):
        return hashlib.md5(f"{i}:{name}".encode()).hexdigest()[:digits].translate(str.maketrans("0123456789abcdef", "abcdefghijklmnop"))

    code = f"x = 1\n{new(1, 'x', 5)}(x)"
    df = spark.createDataFrame([(1, code, "Python"), (2, "y = 2\nprint(y)", "Python")], "id long, code string, lang string")
    got = {r.id: r.renamed for r in with_renamed(df).collect()}
    assert got[1] == code.replace("x", new(1, "x", 12), 1).replace("(x)", f"({new(1, 'x', 12)})")
    assert got[2] == f"{new(2, 'y', 5)} = 2\nprint({new(2, 'y', 5)})"


def test_subtree_signatures_cost_is_linear(spark):
    def tokens(n):
        rows = spark.range(1).select(F.lit(1).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(4 * n - 1))).alias("pos"))
        m = F.col("pos") % 4
        return rows.select("id", F.col("pos").cast("bigint").alias("pos"), F.lit("é").alias("sym"),
                           F.when(m == 0, 1).when(m == 3, -1).otherwise(0).alias("delta"))

    def seconds(n):
        began = time.perf_counter()
        assert S.subtree_signatures(tokens(n), ["id"]).count() == n + 1
        return time.perf_counter() - began

    seconds(500)
    small, large = min(seconds(4000) for _ in range(2)), min(seconds(40000) for _ in range(2))
    assert large < 25 * small + 2


def test_weighted_recall_by_hand(spark):
    # reference "if a b", candidate "if b": order 1 = (1 + 0.2) / (1 + 0.2 + 0.2); longer orders have no match
    pairs = spark.createDataFrame([(1, "Java", ["if", "b"], ["if", "a", "b"])], "pair_id long, lang string, hyp array<string>, ref array<string>")
    r = W.weighted_stats(pairs, ["pair_id"], "lang", "hyp", "ref", W.keyword_dim(spark)).first()
    assert (r.num_1, r.den_1, r.num_2, r.den_2, r.hyp_len, r.ref_len) == (pytest.approx(1.2), pytest.approx(1.4), 0.0, 2.0, 2, 3)


def test_syntax_match_by_hand(spark):
    # member 1: ( ( a ) ( b ) ) against ( ( a ) ): the inner ( a ) is shared, ( b ), the outer node and the root are not
    def rows(member, text):
        return [(1, member, k, c if c.isalpha() else "paren", {"(": 1, ")": -1}.get(c, 0)) for k, c in enumerate(text.split())]

    tok = spark.createDataFrame(rows(0, "( ( a ) )") + rows(1, "( ( a ) ( b ) )"), "id long, member int, pos long, sym string, delta int")
    r = S.group_syntax_match(S.subtree_signatures(tok, ["id", "member"]), "id", "member").first()
    assert (r.matched, r.total) == (1, 4)


def test_dataflow_by_hand(spark):
    # int x = 1; int y = x * x;  -> kept: x (no parent, a parent), the two uses of x, y from both uses
    progs = spark.createDataFrame([(1, 0, "int x = 1;\nint y = x * x;", "Java"), (1, 1, "int a = 1;\nint b = a * 2;", "Java")],
                                  "id long, member int, text string, lang string")
    key = ["id", "member"]
    norm = D.normalized(D.nodes(D.token_table(progs, key, "text", "lang"), key), key)
    items = sorted((r.member, r.pos, r.var, r.rel, r.parents) for r in norm.collect())
    assert items == [
        (0, 1, "var_0", "comesFrom", ""), (0, 6, "var_1", "comesFrom", "var_0,var_0"), (0, 8, "var_0", "comesFrom", "var_0"),
        (0, 10, "var_0", "comesFrom", "var_0"),
        (1, 1, "var_0", "comesFrom", ""), (1, 6, "var_1", "comesFrom", "var_0"), (1, 8, "var_0", "comesFrom", "var_0")]
    r = D.group_match(norm.select("id", "member", F.concat_ws("|", "var", "rel", "parents").alias("item")), "id", "member", "item").first()
    assert (r.matched, r.total) == (2, 3)


def test_loop_targets_are_definitions(spark):
    progs = spark.createDataFrame([
        (1, "for x in xs:\n    y = x", "Python"), (2, "for (Item i : items) {\n  f(i);\n}", "Java"), (3, "if x:\n    z = x", "Python")],
        "id long, text string, lang string")
    edges = D.edges(D.nodes(D.token_table(progs, ["id"], "text", "lang"), ["id"]), ["id"])
    got = sorted((r.id, r.var, r.rel, r.parent) for r in edges.where("parent IS NOT NULL").collect())
    assert got == [(1, "x", "comesFrom", "x"), (1, "x", "computedFrom", "xs"), (1, "y", "computedFrom", "x"),
                   (2, "i", "comesFrom", "i"), (2, "i", "computedFrom", "items"), (3, "z", "computedFrom", "x")]
