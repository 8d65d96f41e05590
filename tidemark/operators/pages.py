"""HTML page operators: heading/block pairs and sample tests.

``io_pairs``: each page is one row; pieces after every ``<h1`` are exploded
(narrow), the heading text and the first following paragraph, cut at the next
block-level tag, are taken with regular expressions. Unbalanced ``p`` tags are
tolerated. ``sample_io_pairs``: the page becomes a stream of tags and texts with
depths, so that a heading finds the next block among its own siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import py_strip

# --- fixed values: extraction patterns
HEADING = "^(?:\\s[^>]*)?>([\\s\\S]*?)</h1>"
AFTER = "</h1>([\\s\\S]*)$"
BLOCK = "<p(?:\\s[^>]*)?>([\\s\\S]*?)(?:</?(?:p|article|div|footer)(?:\\s[^>]*)?>|$)"


def io_pairs(pages: DataFrame) -> DataFrame:
    """``page_id, ord, heading, block``: one row per ``h1`` with its first paragraph (may be '')."""
    pieces = pages.select("page_id", F.posexplode(F.split("html", "<h1", -1)).alias("ord", "piece")).where(
        (F.col("ord") >= 1) & F.col("piece").rlike(HEADING)
    )
    after = F.regexp_extract("piece", AFTER, 1)
    return pieces.select(
        "page_id",
        F.col("ord").cast("bigint").alias("ord"),
        py_strip(F.regexp_extract("piece", HEADING, 1)).alias("heading"),
        py_strip(F.regexp_extract(after, BLOCK, 1)).alias("block"),
    )


def _strip_sql(e: str) -> str:
    ws = "[ \\t\\n\\r\\f\\x0B]"
    return f"regexp_replace({e}, '^{ws}+|{ws}+$', '', 'g')"


IO_PAIRS_SQL = f"""
SELECT page_id, CAST(i - 1 AS BIGINT) AS ord,
       {_strip_sql(f"regexp_extract(piece, '{HEADING}', 1)")} AS heading,
       {_strip_sql(f"regexp_extract(regexp_extract(piece, '{AFTER}', 1), '{BLOCK}', 1)")} AS block
FROM (SELECT page_id, i, parts[i] AS piece
      FROM (SELECT page_id, string_split(html, '<h1') AS parts FROM pages), range(2, len(parts) + 1) r(i))
WHERE regexp_matches(piece, '{HEADING}')"""


# --- fixed values: sample headings, searched anywhere in the heading's text (a number may follow);
# output patterns are tested first, so "Output for the Sample Input N" is an output
SAMPLE_OUTPUT = "Output for the Sample Input|Sample Output|出力例"
SAMPLE_INPUT = "Sample Input|入力例|サンプル入力|Sample input"

# --- fixed values: pieces of a page, tags without an end tag, tags whose text is taken, named characters
PIECE = ("(?i)<!--[\\s\\S]*?-->|<(?:script|style)(?:\\s[^>]*)?>[\\s\\S]*?</(?:script|style)\\s*>"
         "|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<")
TAG_NAME = "(?i)^</?([a-z][a-z0-9]*)[^>]*>$"
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3")
BLOCK_TAG = "pre"
SKIPPED = "(?i)^<(?:!|\\?|script|style)"
CHARACTER = "&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z]+;|[^&]+|&"
NAMED = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&yen;": "¥"}
MAX_CODE = 0x10FFFF


def decoded(text: Column) -> Column:
    """Numbered and the common named characters of HTML text; others stay as they are written."""
    def one(run: Column) -> Column:
        digits = F.regexp_extract(run, "^&#([0-9]+);$", 1)
        hexed = F.regexp_extract(run, "^&#[xX]([0-9a-fA-F]+);$", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
        fits = (code > 0) & (code <= MAX_CODE) & ~code.between(0xD800, 0xDFFF)
        named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
        return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(
            F.coalesce(F.try_element_at(named, run), run))

    runs = F.regexp_extract_all(text, F.lit(CHARACTER), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(runs, one), "")).otherwise(text)


def tag_stream(pages: DataFrame) -> DataFrame:
    """``page_id, pos, tag, opens, closes, text, depth, level, family, stop``: the pieces of every page.

    ``depth`` counts the tags open before a piece. Tags that are void, close
    themselves, or occur unequally often as start and end tag on the page don't
    count. ``level`` and ``family`` name a start tag's parent: siblings have the
    same of both. ``stop`` is the place of its end tag.
    """
    pieces = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PIECE), F.lit(0))).alias("pos", "piece"))
    piece = F.col("piece")
    skipped = piece.rlike(SKIPPED)
    name = F.when(~skipped, F.lower(F.regexp_extract(piece, TAG_NAME, 1)))
    t = pieces.select("page_id", "pos", F.nullif(name, F.lit("")).alias("tag"), piece.startswith("</").alias("ending"),
                      piece.endswith("/>").alias("closed"), F.when(~skipped & (F.coalesce(name, F.lit("")) == ""), piece).alias("text"))
    counted = F.coalesce(F.col("tag").isNotNull() & ~F.col("tag").isin(*VOID_TAGS) & ~F.col("closed"), F.lit(False))
    ends = F.when(counted & F.col("ending"), -1).when(counted, 1).otherwise(0)
    even = F.sum(ends).over(Window.partitionBy("page_id", "tag")) == 0
    t = t.withColumn("step", F.when(even, ends).otherwise(0))
    t = t.withColumn("opens", F.col("step") == 1).withColumn("closes", F.col("step") == -1)
    order = Window.partitionBy("page_id").orderBy("pos")
    t = t.withColumn("depth", F.coalesce(F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # children of one parent: start tags on a level between two ends of tags one level up
    t = t.withColumn("level", F.when(F.col("closes"), F.col("depth") - 1).otherwise(F.col("depth")))
    t = t.withColumn("under", F.when(F.col("closes"), F.col("level") + 1).otherwise(F.col("level")))
    family = Window.partitionBy("page_id", "under").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("family", F.sum(F.when(F.col("closes"), 1).otherwise(0)).over(family))
    after = Window.partitionBy("page_id", "level").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return t.withColumn("stop", F.min(F.when(F.col("closes"), F.col("pos"))).over(after))


def headed_elements(pages: DataFrame) -> DataFrame:
    """``page_id, pos, tag, level, family, texts, text``: headings and blocks with their texts, inner tags left out, characters decoded."""
    t = tag_stream(pages)
    named = F.col("opens") & F.col("tag").isin(*HEADINGS, BLOCK_TAG) & F.col("stop").isNotNull()
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(named, F.struct("pos", "tag", "level", "family", "stop")), ignorenulls=True).over(order)
    t = t.withColumn("own", owner).where((F.col("own.stop") > F.col("pos")) & (named | F.col("text").isNotNull()))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda x: x["text"])
    return t.groupBy("page_id", F.col("own.pos").alias("pos"), F.col("own.tag").alias("tag"), F.col("own.level").alias("level"),
                     F.col("own.family").alias("family")).agg(parts.alias("parts")).select(
        "page_id", "pos", "tag", "level", "family", F.size("parts").alias("texts"),
        py_strip(decoded(F.array_join("parts", ""))).alias("text"))


def sample_io_pairs(pages: DataFrame) -> DataFrame:
    """``page_id, ord, input, expected``: sample tests read from headed ``pre`` blocks.

    A heading (h1-h3) that holds one single text takes the next ``pre`` among
    its siblings; then headings are classified. A repeated heading keeps its
    first position and its last value. The i-th input is joined with the i-th
    output. All windows are bounded by one page; null pages give nothing.
    """
    events = headed_elements(pages)
    is_block = F.col("tag") == BLOCK_TAG
    later = Window.partitionBy("page_id", "level", "family").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    block = F.first(F.when(is_block, F.col("text")), ignorenulls=True).over(later)
    kind = F.when(F.col("text").rlike(SAMPLE_OUTPUT), "output").when(F.col("text").rlike(SAMPLE_INPUT), "input")
    heads = events.withColumn("block", block).where(~is_block & (F.col("texts") == 1)).withColumn("cls", kind).where(
        F.col("cls").isNotNull() & F.col("block").isNotNull())
    once = heads.groupBy("page_id", "text", "cls").agg(F.min("pos").alias("first_pos"), F.max_by("block", "pos").alias("value"))
    ranked = once.withColumn("ord", F.row_number().over(Window.partitionBy("page_id", "cls").orderBy("first_pos")))
    return ranked.groupBy("page_id", "ord").agg(
        F.max(F.when(F.col("cls") == "input", F.col("value"))).alias("input"),
        F.max(F.when(F.col("cls") == "output", F.col("value"))).alias("expected"),
    ).where(F.col("input").isNotNull() & F.col("expected").isNotNull()).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), "input", "expected")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sample_io_sql(pages: str = "pages") -> str:
    """The same in DuckDB SQL over ``pages(page_id, html)``; siblings by the place of their parent's start tag."""
    void, heads = (", ".join(_quoted(x) for x in xs) for xs in (VOID_TAGS, HEADINGS))
    named = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in NAMED.items())
    runs = f"""array_to_string(list_transform(regexp_extract_all(raw, '{CHARACTER}', 0),
           lambda r: CASE WHEN regexp_matches(r, '^&#[0-9]+;$') THEN chr(CAST(regexp_extract(r, '[0-9]+') AS INT))
                          WHEN regexp_matches(r, '^&#[xX][0-9a-fA-F]+;$') THEN chr(CAST('0x' || regexp_extract(r, '[xX]([0-9a-fA-F]+)', 1) AS INT))
                          ELSE CASE r {named} ELSE r END END), '')"""
    return f"""
WITH pc AS MATERIALIZED (
  SELECT page_id, k AS pos, es[k] AS piece,
         CASE WHEN regexp_matches(es[k], '{SKIPPED}') THEN NULL ELSE nullif(lower(regexp_extract(es[k], '{TAG_NAME}', 1)), '') END AS tag
  FROM (SELECT page_id, regexp_extract_all(html, '{PIECE}', 0) AS es FROM {pages}), range(1, len(es) + 1) r(k)),
tg AS MATERIALIZED (
  SELECT *, CASE WHEN tag IS NULL OR tag IN ({void}) OR ends_with(piece, '/>') THEN 0 WHEN starts_with(piece, '</') THEN -1 ELSE 1 END AS mark
  FROM pc),
ev0 AS MATERIALIZED (
  SELECT *, CASE WHEN sum(mark) OVER (PARTITION BY page_id, tag) = 0 THEN mark ELSE 0 END AS step FROM tg),
dp AS MATERIALIZED (
  SELECT *, coalesce(sum(step) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM ev0),
el AS MATERIALIZED (
  SELECT o.page_id, o.pos, o.tag, o.depth,
         (SELECT min(c.pos) FROM dp c WHERE c.page_id = o.page_id AND c.step = -1 AND c.pos > o.pos AND c.depth = o.depth + 1) AS stop,
         (SELECT max(p.pos) FROM dp p WHERE p.page_id = o.page_id AND p.step = 1 AND p.pos < o.pos AND p.depth = o.depth - 1) AS parent
  FROM dp o WHERE o.step = 1 AND o.tag IN ({heads}, '{BLOCK_TAG}')),
tx AS (
  SELECT e.page_id, e.pos, e.tag, e.depth, e.parent, count(d.pos) AS texts, coalesce(string_agg(d.piece, '' ORDER BY d.pos), '') AS raw
  FROM el e LEFT JOIN dp d ON d.page_id = e.page_id AND d.pos > e.pos AND d.pos < e.stop AND d.tag IS NULL AND NOT regexp_matches(d.piece, '{SKIPPED}')
  WHERE e.stop IS NOT NULL GROUP BY ALL),
tt AS MATERIALIZED (
  SELECT page_id, pos, tag, depth, parent, texts, {_strip_sql(runs)} AS text FROM tx),
hd AS (
  SELECT h.page_id, h.pos, h.text,
         (SELECT arg_min(b.text, b.pos) FROM tt b WHERE b.page_id = h.page_id AND b.tag = '{BLOCK_TAG}' AND b.depth = h.depth
            AND b.parent IS NOT DISTINCT FROM h.parent AND b.pos > h.pos) AS block,
         CASE WHEN regexp_matches(h.text, '{SAMPLE_OUTPUT}') THEN 'output' WHEN regexp_matches(h.text, '{SAMPLE_INPUT}') THEN 'input' END AS cls
  FROM tt h WHERE h.tag <> '{BLOCK_TAG}' AND h.texts = 1),
d AS (
  SELECT page_id, text, cls, min(pos) AS first_pos, arg_max(block, pos) AS value
  FROM hd WHERE cls IS NOT NULL AND block IS NOT NULL GROUP BY page_id, text, cls),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, cls ORDER BY first_pos) AS ord FROM d)
SELECT page_id, CAST(ord AS BIGINT) AS ord, max(CASE WHEN cls = 'input' THEN value END) AS input,
       max(CASE WHEN cls = 'output' THEN value END) AS expected
FROM r GROUP BY page_id, ord
HAVING max(CASE WHEN cls = 'input' THEN value END) IS NOT NULL AND max(CASE WHEN cls = 'output' THEN value END) IS NOT NULL"""


SAMPLE_IO_SQL = sample_io_sql()
