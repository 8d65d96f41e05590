"""Sample tests on pages: siblings, inner tags, characters, unclosed and void tags, by hand."""

import pytest

from tidemark.operators.pages import sample_io_pairs

IN, OUT = "<h2>Sample Input 1</h2>", "<h2>Sample Output 1</h2>"
CASES = [
    ("plain", f"{IN}<pre>a</pre>{OUT}<pre>b</pre>", [("a", "b")]),
    ("inner tags and characters", f"{IN}<pre>a &lt; <b>b</b></pre>{OUT}<pre>&#97;&#x62;&amp;lt; &copy;</pre>", [("a < b", "ab&lt; &copy;")]),
    ("a block in a div is no sibling, the next one is", f"{IN}<div><pre>x</pre></div>{OUT}<pre>b</pre>", [("b", "b")]),
    ("the next sibling after a div", f"{IN}<div><pre>x</pre></div><pre>a</pre>{OUT}<pre>b</pre>", [("a", "b")]),
    ("another parent", f"<div>{IN}</div><pre>x</pre><div>{OUT}<pre>b</pre></div>", []),
    ("equal depth, other parent", f"<div>{IN}</div><div><pre>x</pre></div>{OUT}<pre>b</pre>", []),
    ("both in one parent", f"<body><div>{IN}<pre>a</pre></div><div>{OUT}<pre>b</pre></div></body>", [("a", "b")]),
    ("unclosed and void tags", f"<p>t{IN}<p>u<br><img src='x'><hr/><pre>a</pre><p>{OUT}<pre>b</pre>", [("a", "b")]),
    ("a heading of two texts", f"<h2>Sample <i>Input</i> 1</h2><pre>a</pre>{OUT}<pre>b</pre>", []),
    ("a heading of one text in a tag", f"<h2><b>Sample Input</b></h2><pre>a</pre>{OUT}<pre>b</pre>", [("a", "b")]),
    ("comments and scripts", f"{IN}<!-- <pre>x</pre> --><script>if (a<b) '<pre>y</pre>'</script><pre>a</pre>{OUT}<pre>b</pre>", [("a", "b")]),
    ("a repeated heading", f"{IN}<pre>a</pre>{IN}<pre>c</pre>{OUT}<pre>b</pre>", [("c", "b")]),
    ("two pairs in Japanese", "<h3>入力例 1</h3><pre>1</pre><h3>出力例 1</h3><pre>2</pre><h3>入力例 2</h3><pre>3</pre><h3>出力例 2</h3><pre>4</pre>",
     [("1", "2"), ("3", "4")]),
    ("no output", f"{IN}<pre>a</pre>", []),
    ("an empty block", f"{IN}<pre></pre>{OUT}<pre>b</pre>", [("", "b")]),
    ("a stray angle", f"1 < 2 {IN}<pre>a < b</pre>{OUT}<pre>b</pre>", [("a < b", "b")]),
    ("null", None, []), ("nothing", "", []),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(k, html) for k, (_, html, _) in enumerate(CASES)], "page_id long, html string")
    out = {}
    for r in sorted(sample_io_pairs(pages).collect(), key=lambda r: (r["page_id"], r["ord"])):
        out.setdefault(r["page_id"], []).append((r["input"], r["expected"]))
    return out


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_page(found, k):
    assert found.get(k, []) == CASES[k][2]
