"""I/O queries: JSONL scan, code-tree scan, corpus write, resumable stream (written, then read back)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators.corpus import default_type
from tidemark.plans.build import LANG, corpus
from tidemark.plans.registry import register
from tidemark.plans.sql_fixtures import NL, with_ctes
from tidemark.sources import files as FS
from tidemark.sources.tables import table
from tidemark.streaming import append as A
from tidemark.streaming import resume as R


@register("read_corpus", with_ctes("""
SELECT id, filename, type, code, CAST(coalesce(len(test_case), 0) AS BIGINT) AS n_tests,
       test_case[1].expected AS first_expected, false AS corrupt
FROM code_corpus""", "code_corpus"))
def read_corpus(spark, sf):
    path = FS.scratch_path(spark, "corpus-jsonl")
    FS.write_corpus(corpus(spark, sf).select("id", "filename", "type", "code", "test_case"), path, mode="overwrite")
    return FS.read_corpus(spark, path).select(
        "id", "filename", "type", "code", F.coalesce(F.size("test_case"), F.lit(0)).cast("bigint").alias("n_tests"),
        F.get("test_case", 0)["expected"].alias("first_expected"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


PROBLEM = "'p' || lpad(CAST(id // 100 AS VARCHAR), 5, '0')"


@register("read_code_tree", with_ctes(f"""
SELECT problem, lang, string_agg(code, {NL} ORDER BY id) || {NL} AS code
FROM (SELECT id, {PROBLEM} AS problem, {LANG} AS lang, code FROM code_corpus) GROUP BY problem, lang""", "code_corpus"))
def read_code_tree(spark, sf):
    """A tree with one source file per problem (a hundred ids) and language, written and scanned."""
    root = FS.scratch_path(spark, "code-tree")
    problem = F.concat(F.lit("p"), F.lpad(F.floor(F.col("id") / 100).cast("string"), 5, "0"))
    k = corpus(spark, sf).select(problem.alias("problem"), default_type("type").alias("lang"), F.struct("id", "code").alias("c"))
    files = k.groupBy("problem", "lang").agg(F.array_sort(F.collect_list("c")).alias("cs")).select(
        "problem", "lang", F.array_join(F.transform("cs", lambda c: c["code"]), "\n").alias("code"))
    FS.write_code_tree(files, root)
    return FS.read_code_tree(spark, root, {lang: "txt" for lang in FS.EXTENSIONS}).select("problem", "lang", "code")


@register("write_corpus", with_ctes("""
SELECT id, type, grade, code FROM code_corpus UNION ALL SELECT id, type, grade, upper(code) FROM code_corpus""",
                                    "code_corpus"))
def write_corpus(spark, sf):
    """Overwrite with the corpus, append a second run, read back: both runs' rows."""
    path = FS.scratch_path(spark, "corpus-parquet")
    k = corpus(spark, sf).select("id", "type", "grade", "code")
    FS.write_corpus(k, path, mode="overwrite", fmt="parquet")
    FS.write_corpus(k.withColumn("code", F.upper("code")), path, mode="append", fmt="parquet")
    return spark.read.parquet(path)


@register("resume_stream", """
SELECT event_id, user_id, event_type, floor(value * 1e2 + 5e-1) / 1e2 AS value, CAST(ts AS DATE) AS day FROM events""")
def resume_stream(spark, sf):
    """Two availableNow runs over the events file with one checkpoint: the second finds nothing new."""
    sink = FS.scratch_path(spark, "events-sink")
    ckpt = FS.scratch_path(spark, "events-ckpt")
    for _ in range(2):
        R.run_available(spark, sf, R.EVENT_SCHEMA, R.tag_events, sink, ckpt, glob="events.parquet")
    return spark.read.parquet(sink)


# every seventh line is cut short, some records have no code or a name without a language
_RAW = "'{\"id\": ' || CAST(id AS VARCHAR) || ', \"filename\": \"' || name || '\", \"code\": '"
_REJECT_SRC = f"""
  SELECT id, name, code, CASE WHEN id % 7 = 3 THEN 'malformed' WHEN id % 5 = 2 THEN 'no_code'
                              WHEN name NOT SIMILAR TO '(java|python)_(train|test|valid)_[0-9]+.jsonl' THEN 'no_language' END AS reason
  FROM (SELECT id, CASE WHEN id % 4 = 1 THEN 'notes ' || CAST(id AS VARCHAR) || '.txt' ELSE filename END AS name, code FROM code_corpus)"""


@register("corpus_rejects", with_ctes(f"""
SELECT CASE WHEN reason = 'malformed' THEN NULL ELSE id END AS id, CASE WHEN reason = 'malformed' THEN NULL ELSE name END AS filename, reason,
       CASE WHEN reason IS NULL THEN upper(name[1]) || split_part(name, '_', 1)[2:] END AS lang,
       CASE WHEN reason IS NULL THEN split_part(name, '_', 2) END AS split,
       CASE WHEN reason = 'malformed' THEN {_RAW} END AS raw,
       CASE WHEN reason = 'malformed' OR reason = 'no_code' THEN NULL ELSE md5(code) END AS code_md5
FROM ({_REJECT_SRC})""", "code_corpus"))
def corpus_rejects(spark, sf):
    """A JSONL corpus with malformed lines, missing code and untaggable file names, split into two sinks in one pass."""
    lines, root = FS.scratch_path(spark, "mixed-jsonl"), FS.scratch_path(spark, "split")
    k = corpus(spark, sf).select("id", "code", F.when(F.col("id") % 4 == 1, F.concat(
        F.lit("notes "), F.col("id").cast("string"), F.lit(".txt"))).otherwise(F.col("filename")).alias("filename"))
    whole = F.to_json(F.struct("id", "filename", F.when(F.col("id") % 5 != 2, F.col("code")).alias("code")))
    cut = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "filename": "'), "filename", F.lit('", "code": '))
    k.select(F.when(F.col("id") % 7 == 3, cut).otherwise(whole).alias("value")).write.text(lines)
    accepted, rejected = f"{root}/accepted", f"{root}/rejected"
    FS.split_corpus(spark, lines, accepted, rejected)
    out = FS.read_sink(spark, accepted).unionByName(FS.read_sink(spark, rejected))
    return out.select("id", "filename", "reason", "lang", "split", "raw", F.md5("code").alias("code_md5"))


ARRIVALS = 3


@register("append_once", f"""
SELECT event_id, user_id, event_type, floor(value * 1e2 + 5e-1) / 1e2 AS value, CAST(ts AS DATE) AS day, event_id % {ARRIVALS} AS batch
FROM events""")
def append_once(spark, sf):
    """Events arrive in three files; the second run fails after writing its rows, the third replays it and goes on."""
    inbox, sink = FS.scratch_path(spark, "inbox"), FS.scratch_path(spark, "appended")
    events = table(spark, sf, "events")

    def lost(batch_id: int) -> None:
        raise RuntimeError("the run ended here")

    for k in range(ARRIVALS):
        events.where(F.col("event_id") % ARRIVALS == k).coalesce(1).write.mode("append").parquet(inbox)
        if k == 1:
            try:
                A.append_available(spark, inbox, R.EVENT_SCHEMA, R.tag_events, sink, after_write=lost)
            except StreamingQueryException:
                pass
        A.append_available(spark, inbox, R.EVENT_SCHEMA, R.tag_events, sink)
    return A.committed(spark, sink).withColumn("batch", F.col("batch").cast("long"))
