"""File sources and sinks: JSONL corpora, source-code trees, append/overwrite writes.

Scratch output goes under the shared ``spark.checkpoint.dir`` (never a
machine-local temp folder), in a fresh sub-folder per call.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

CORPUS_SCHEMA = (
    "id long, filename string, type string, code string, "
    "test_case array<struct<input:string,expected:string>>, _corrupt_record string"
)

# --- fixed values: language folder -> file extension of a source tree
EXTENSIONS = {"C++": "cpp", "Python": "py", "C": "c", "JavaScript": "js", "Java": "java"}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-io/{name}-{uuid.uuid4().hex}"


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """JSONL corpus with an explicit schema; malformed lines land in ``_corrupt_record``."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


# --- fixed values: corpus file names that name a language and a split
TAG_RE = "^(java|python)_(train|test|valid)_[0-9]+\\.jsonl$"


def language_tag(name: str = "filename") -> tuple[Column, Column]:
    """(language, split) of a corpus file name, empty where it names none."""
    return F.initcap(F.regexp_extract(name, TAG_RE, 1)), F.regexp_extract(name, TAG_RE, 2)


def split_corpus(spark: SparkSession, path: str, accepted: str, rejected: str, schema: str = CORPUS_SCHEMA) -> None:
    """Read a JSONL corpus once and append its records to two sinks: tagged records, and rejects with a reason.

    Reasons, the first that holds: ``malformed`` (the line is no JSON record; it is
    kept in ``raw``), ``no_code`` (code missing or blank), ``no_language`` (the file
    name names no language). One job reads, decides and writes both; the rows
    are told apart by folders below ``accepted``'s parent, which is then read by ``read_sink``.
    """
    rows = read_corpus(spark, path, schema)
    lang, split = language_tag()
    reason = (F.when(F.col("_corrupt_record").isNotNull(), "malformed")
              .when(F.coalesce(F.trim("code"), F.lit("")) == "", "no_code")
              .when(F.coalesce(lang, F.lit("")) == "", "no_language"))
    out = rows.withColumn("reason", reason).withColumn("lang", F.when(reason.isNull(), lang)).withColumn(
        "split", F.when(reason.isNull(), split)).withColumnRenamed("_corrupt_record", "raw")
    sink = F.when(F.col("reason").isNull(), accepted).otherwise(rejected)
    root = accepted.rsplit("/", 1)[0]
    if rejected.rsplit("/", 1)[0] != root:
        raise ValueError("both sinks must lie in one folder")
    out.withColumn("sink", F.regexp_extract(sink, "([^/]+)$", 1)).write.mode("append").partitionBy("sink").parquet(root)


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """The records of one of the sinks that ``split_corpus`` writes."""
    root, name = sink.rsplit("/", 1)
    return spark.read.parquet(f"{root}/sink={name}")


def write_corpus(df: DataFrame, path: str, mode: str = "append", fmt: str = "json") -> None:
    """Append (resumable runs) or overwrite (fresh runs) a corpus."""
    df.write.mode(mode).format(fmt).save(path)


#: What Spark escapes in the folder names of partition values.
_ESCAPED = frozenset([*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"])


def _folder(value: str | None) -> str:
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` for plain file calls if it lies on a mounted file system, else None."""
    scheme = re.match("([A-Za-z][A-Za-z0-9+.-]*):", root)
    if scheme:
        return re.sub("^file:(//)?(?=/)", "", root) if scheme[1] == "file" and re.match("file:(///|/[^/])", root) else None
    try:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    except Exception:  # noqa: BLE001 - Spark Connect: only the server knows
        return None
    return root if default.startswith("file:") and root.startswith("/") else None


def _write_files(top: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file per row below ``top``; rows come sorted, so a repeated task writes the same names with the same texts."""
    part, last, nth, n = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        for problem, lang, code in zip(*(c.to_pylist() for c in b.columns)):
            folder = f"{top}/problem={_folder(problem)}/lang={_folder(lang)}"
            if folder != last:
                os.makedirs(folder, exist_ok=True)
                last, nth = folder, 0
            # readers pass over names that begin with a dot, and see a file whole or not at all
            hidden = f"{folder}/.{part:05}-{nth}-{uuid.uuid4().hex}"
            with open(hidden, "w", encoding="utf-8", newline="") as f:
                f.write((code or "") + "\n")
            os.replace(hidden, f"{folder}/part-{part:05}-{nth}.txt")
            nth += 1
            n += 1
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def write_code_tree(df: DataFrame, root: str) -> None:
    """Lay out snippets as ``<root>/problem=<p>/lang=<L>/*.txt``, one file per snippet.

    On a mounted file system the tasks write the files themselves: Hadoop's local
    file system starts a process for the permissions of every file and of its
    checksum, some milliseconds each, which is most of the time of a tree of small files. Other stores take Spark's writer.
    """
    rows = df.select("problem", "lang", "code")
    if top := _mounted(df.sparkSession, root):
        shutil.rmtree(top, ignore_errors=True)
        text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).sortWithinPartitions("problem", "lang", "code")
        text.mapInArrow(lambda batches: _write_files(top, batches), "n long").agg(F.sum("n")).collect()
        os.makedirs(top, exist_ok=True)
        return
    (rows.sortWithinPartitions("problem", "lang")
       .write.mode("overwrite").option("maxRecordsPerFile", 1)
       .option("mapreduce.fileoutputcommitter.algorithm.version", "2")  # tasks move their own files, not the driver all of them
       .partitionBy("problem", "lang").text(root))


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core while a reader is made; by default every folder is a task, up to 10,000."""
    try:
        n = max(64, 4 * spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - Spark Connect
        yield
        return
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_code_tree(spark: SparkSession, root: str, extensions: dict[str, str] | None = None) -> DataFrame:
    """``problem, lang, path, code`` of a tree ``<root>/<problem>/<language>/<file>.<extension>``.

    One row per file. Folder names may be Hive style (``problem=``, ``lang=``). A
    file counts only under a known language folder and with that language's
    extension; files that are not valid UTF-8 are skipped, and empty files hold no snippet.
    """
    known = extensions or EXTENSIONS
    with _few_listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = "/(?:problem=)?([^/]+)/(?:lang=)?([^/]+)/[^/]+[.]([A-Za-z0-9]+)$"
    path = F.regexp_replace(F.col("path"), "%2B", "+")
    rows = files.select("path", "content", F.regexp_extract(path, folder, 1).alias("problem"),
                        F.regexp_extract(path, folder, 2).alias("lang"), F.regexp_extract(path, folder, 3).alias("ext"))
    wanted = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    ok = rows.where((wanted[F.col("lang")] == F.col("ext")) & F.expr("is_valid_utf8(content)") & (F.octet_length("content") > 0))
    return ok.select("problem", "lang", "path", F.expr("decode(content, 'UTF-8')").alias("code"))
