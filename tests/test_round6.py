"""Programs that are scored one by one inside the task give what the frames of tokens, windows and aggregations give."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bleu_formulas as BF
from tidemark.functions.text import line_tokens, word_tokens
from tidemark.operators import attempts as AT
from tidemark.operators import bleu as B
from tidemark.operators import dataflow as D
from tidemark.operators import inrow as P
from tidemark.operators import structure as S
from tidemark.operators import weighted as W
from tidemark.plans import codebleu as C
from tidemark.session import kept
from tidemark.sources import files as FS

SF001 = "/root/testdata/sf0.001"
KEY = ["id", "member"]

STRAIGHT = ["x = y", "y = x * 2", "int a = b;", "a += b", "x, y = y, x", "f(x)", "s = 'a b'", 's = "a\\"b"', "# note", "// note", "/* a\n b */", '"""doc\n\n x"""',
            't = """a\n\n b = c""" + x', "''' lone", "x = 'lone", "(x", "y)", "{", "}", "[a]", "\\", "", "   ", "\ta = 1", "  b = a", "    c = b", "\x0cq", "é = x",
            "x y", "a ", "p  ", '"a\\ b"', "r\r", "\r", "x = 1.5e3", "a==b", "a->b::c", "Foo z", "return x", "String s = t;", "\ufdd0 = x", "lambda k: k"]
BLOCKS = ["if x:", "if (x) {", "else:", "} else {", "elif y:", "else if (y) {", "while y:", "while (y) {", "for i in x:", "for (int i = 0; i < x; i++) {", "do {",
          "if (x)", "else", "for (Foo z : x)", "if x: y = 1", "x = y;", "y = x;", "}", "    x = y", "    y = x", "        x = 1"]


def _programs(seed: int, n: int, pieces: list[str]) -> list[tuple[int, str, list[str]]]:
    rng = random.Random(seed)

    def text() -> str | None:
        out = "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        return None if rng.random() < 0.02 else out + rng.choice(["", "", "", "  ", "\r\n", " \x85"])

    return [(k, rng.choice(["Python", "Java", "C++", "Ruby", "C#"]), [text() for _ in range(3)]) for k in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, lang, None, t) for i, lang, t in rows], "id long, lang string, grade string, texts array<string>").repartition(4, "id")


def _members(rows):
    return rows.select("id", "lang", F.posexplode("texts").alias("member", "text"))


def _flow(rows):
    def matches(uses):
        return D.group_match(D.normalized(D.merged_nodes(uses, KEY), KEY).select(*KEY, F.concat_ws("|", "var", "rel", "parents").alias("item")), "id", "member", "item")

    blocks = F.exists("texts", D.branches)
    straight = D.token_table(_members(rows.where(~blocks)), KEY, "text", "lang")
    merged = D.token_table(_members(rows.where(blocks)), KEY, "text", "lang", layout=True)
    return matches(D.straight_uses(straight, KEY)).unionByName(matches(D.merged_uses(merged, KEY)))


def _syntax(rows):
    tok = D.token_table(_members(rows), KEY, "text", "lang", layout=True)
    return S.group_syntax_match(S.subtree_signatures(S.code_structure_tokens(tok, KEY), KEY), "id", "member")


@pytest.mark.parametrize("pieces", [STRAIGHT, STRAIGHT + BLOCKS + BLOCKS], ids=["straight", "blocks"])
def test_scores_are_those_of_the_frames(spark, pieces):
    rows = _programs(5, 150, pieces)
    rows += rows[:10]  # ids that come twice
    frame, keywords = _frame(spark, rows), W.keyword_dim(spark)
    pairs = C._pairs(frame)
    lines = pairs.select(*KEY, line_tokens("text2").alias("hyp"), F.array(line_tokens("text1")).alias("refs"))
    words = pairs.select(*KEY, "lang", word_tokens("text1").alias("hyp"), word_tokens("text2").alias("ref"))
    share = F.expr(BF.r6("CAST(matched AS DOUBLE) / total"))
    bleu = {(r["id"], r["member"]): r["bleu"] for r in B.sentence_bleu(lines, KEY).collect()}
    weighted = {(r["id"], r["member"]): r["score"] for r in W.weighted_ngram(words, KEY, "lang", "hyp", "ref", keywords).collect()}
    twice = set(range(10)) if pieces is not STRAIGHT else set()  # windows leave the order of equal positions open there
    flow, syntax = ({(r["id"], r["member"]): r["s"] for r in f(frame).select(*KEY, share.alias("s")).collect()} for f in (_flow, _syntax))
    got = {(r["id"], r["member"]): r for r in C.codebleu_scores(frame, keywords, 2).collect()}
    assert got.keys() == bleu.keys() and len(got) == 300
    for k, r in got.items():
        text = next(t for i, _, t in rows if i == k[0])
        assert (r["bleu"], r["weighted"]) == (bleu[k], weighted[k]), text
        if k[0] not in twice:
            assert (r["syntax"], r["dataflow"]) == (syntax.get(k, 0.0), flow.get(k, 0.0)), text
    assert 0 < sum(r["dataflow"] for r in got.values()) and 0 < sum(r["syntax"] for r in got.values())


def test_tokens_are_those_of_the_token_table(spark):
    rows = [(i, lang, t[0]) for i, lang, t in _programs(8, 400, STRAIGHT + BLOCKS)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    for layout in (False, True):
        want = {}
        for r in D.token_table(df, ["id"], "text", "lang", layout=layout).orderBy("id", "pos").collect():
            want.setdefault(r["id"], []).append((r["token"], r["line"]))
        for i, lang, text in rows:
            lists = P.token_lists(text, lang)[2 * layout:][:2]
            assert [(t.replace(P.STRING_NL, "\n"), n) for t, n in zip(*lists)] == want.get(i, []), (lang, text)
    blocks = {r["id"] for r in df.where(D.branches("text")).collect()}
    assert {i for i, _, t in rows if P.has_blocks(t)} == blocks


def test_no_window_and_one_exchange_of_the_texts(spark):
    plan = C.codebleu(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1 and plan.count("MapInArrow") == 1


def test_largest_batches_hold_a_program_over_their_ends():
    import pyarrow as pa

    def batch(ids):
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "v": pa.array(range(len(ids)), pa.int64())})

    got = [(k[0], len(rows)) for k, rows in P.groups(iter([batch([1, 1, 2]), batch([]), batch([2, 2, 3]), batch([3])]), 1, rows=2)]
    assert got == [(1, 2), (2, 3), (3, 2)]
    assert Counter(P.words_of(" a  b\x0b")) == Counter(["a", "b"])


def test_block_queries_are_those_of_the_frames(spark):
    rows = [(i, lang, t[0]) for i, lang, t in _programs(9, 300, STRAIGHT[:10] + BLOCKS + BLOCKS)] + [(None, "Java", "x = y;")]
    df = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3, "id")
    tok = D.token_table(df, ["id"], "text", "lang", layout=True)
    sig = S.subtree_signatures(S.code_structure_tokens(tok, ["id"]), ["id"]).groupBy("id", "signature").agg(F.count(F.lit(1)).alias("cnt"))
    assert sorted(P.signature_counts(df, "id", "text", "lang").collect()) == sorted(sig.collect())
    uses = D.merged_uses(tok, ["id"]).collect()
    line = {(r["id"], r["pos"]): r["line"] for r in uses}
    want = sorted((r["id"], r["line"], r["token"], line[r["id"], d]) for r in uses for d in r["defs"])
    got = P.reached_lines(df, "id", "text", "lang")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_code_tree_on_a_mounted_file_system_is_that_of_sparks_writer(spark, tmp_path, monkeypatch):
    rows = [("p1", "C++", "int a;"), ("p1", "C++", "int b;\n"), ("p/2", "Python", "é\r\nx"), ("p=3%", "Java", None), (None, "C", "c"), ("p1", "", "x"), ("p1", "Java", "")]
    df = spark.createDataFrame(rows, "problem string, lang string, code string").repartition(3, "problem")
    trees = []
    for k, own in enumerate((True, False)):
        root = tmp_path / str(k)
        if not own:
            monkeypatch.setattr(FS, "_mounted", lambda *a: None)
        FS.write_code_tree(df, str(root))
        FS.write_code_tree(df, str(root))  # overwrites
        trees.append(sorted((str(p.parent.relative_to(root)), p.read_bytes()) for p in root.rglob("*.txt")))
    assert trees[0] == trees[1] and len(trees[0]) == len(rows)
    assert not list((tmp_path / "0").rglob(".*"))  # no checksum files, each of which costs a process
    got = FS.read_code_tree(spark, str(tmp_path / "0"), {lang: "txt" for lang in FS.EXTENSIONS}).select("problem", "lang", "code").collect()
    assert ("p1", "C++", "int a;\n") in [tuple(r) for r in got]


def test_other_stores_take_sparks_writer(spark):
    assert FS._mounted(spark, "/a/b") == "/a/b" and FS._mounted(spark, "file:///a/b") == "/a/b" and FS._mounted(spark, "file:/a") == "/a"
    assert FS._mounted(spark, "hdfs://n/a") is None and FS._mounted(spark, "s3a://b/a") is None and FS._mounted(spark, "a/b") is None


def test_listing_of_a_tree_leaves_the_setting(spark, tmp_path):
    before = spark.conf.get(FS._LISTING)
    seen = []
    with FS._few_listing_tasks(spark):
        seen.append(int(spark.conf.get(FS._LISTING)))
    assert seen[0] < int(before) and spark.conf.get(FS._LISTING) == before


def test_rounds_keep_of_a_resolved_record_its_text_only(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(AT, "kept", lambda df, name: frames.append(out := kept(df, name)) or out)
    records = spark.createDataFrame([(k, "c" * 50, [k]) for k in range(9)], "id long, code string, `a.b` array<long>")
    done, left = AT.attempt_rounds(records, lambda o, k: o.select("id", F.concat("code", F.lit(str(k))).alias("text")),
                                   lambda t: t.withColumn("usable", F.col("id") % 3 == 0), 2)
    assert {r["id"] for r in done.collect()} == {0, 3, 6} and {r["text"][-1] for r in left.collect()} == {"2"}
    for f in frames[1:]:
        assert all((r["code"] is None) == r["usable"] == (r["a.b"] is None) for r in f.collect())
