"""Ranked lexical search with bit-sliced Bloom signatures.

Index: documents with about as many entries share a block. An entry is a term
together with a power of two that its count reaches, so a signature tells not
only that a term may be there but how often at most. A block is a bitmap with
one row per signature bit and one column per document.

Search: the rows of an entry's bits, and-ed, mark every document that may hold
it; bits of other terms can only add documents. Each term's weight times its
score at the largest count its marks allow, summed over the query's terms, is an
upper bound of the document's score. The documents with the largest bounds are
scored exactly first; the last of the best ``top`` found so is a score that the
final list must reach. Every document whose bound reaches it is then
scored exactly from its whole text, so the result is that of scoring all.

The blocks are a table in the shared folder, written once. Queries are taken
in blocks of ``QUERY_BLOCK``; what a task knows of them is their terms.

Defined cases: null and empty text has no term; a query without a known term has
no result; every row of documents is a document of its own, so repeated rows are
ranked each (ties by doc_id, null ids last); queries with the same id count
as one query with all their terms, a null id is one too; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import checkpoint_dir

TOP = 20
#: Signature bits per entry and bits set by an entry: at most 1 in 70 absent terms is marked.
BITS, HASHES = 12, 4
#: Bits of one block's bitmap at most, and documents in it.
BLOCK_BITS, BLOCK_DOCS = 1 << 23, 2048
#: Documents of more than 2 ** MAX_CLASS entries share the widest signature; their bounds are looser, not wrong.
MAX_CLASS = 16
#: Queries searched together, and documents per query that are scored first.
QUERY_BLOCK, FIRST = 512, 40
#: The score's length parameter: 100 - 25 + 25 * n / mean length.
_SEPARATORS = [c for c in range(128) if not chr(c).isalnum()]
_TABLE = bytes(32 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, in UTF-8, A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


def counts_of(text: bytes | None) -> Counter:
    return Counter(terms_of(text))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray | int, n_docs: int, n_terms: int):
    return 100 - 25 + (25 * n * n_docs) // n_terms


def positions(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """(entries, HASHES) bit numbers from 64-bit hashes, by double hashing."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(n_bits)).astype(np.int64)


def entry_hash(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hash of the entries (term, 2 ** level)."""
    return hashes * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)


def signature_entries(counts: Counter) -> np.ndarray:
    """Entry hashes of a document: for every term the powers of two up to its count."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    n = np.fromiter(counts.values(), np.int64, len(counts))
    out, level = [], 0
    while len(hashes):
        out.append(entry_hash(hashes, level))
        level += 1
        some = n >= (1 << level)
        hashes, n = hashes[some], n[some]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class _Block:
    """Documents of one length class while their bitmap is being filled."""

    def __init__(self, cls: int):
        self.n_bits = BITS << cls
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // self.n_bits)) // 8 * 8
        self.ids, self.digests, self.lengths, self.entries = [], [], [], []

    def row(self, doc_type: pa.DataType) -> pa.RecordBatch:
        width = -(-len(self.ids) // 8) * 8
        bits = np.zeros((self.n_bits, width), np.uint8)
        for d, entries in enumerate(self.entries):
            bits[positions(entries, self.n_bits).ravel(), d] = 1
        packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([self.ids], pa.list_(doc_type)), pa.array([self.digests], pa.list_(pa.int64())),
             pa.array([self.lengths], pa.list_(pa.int64())), pa.array([self.n_bits], pa.int64()),
             pa.array([packed], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64())],
            names=["ids", "digests", "lengths", "n_bits", "rows", "term", "df"])


def _index_rows(docs: DataFrame, asked: frozenset[bytes]) -> DataFrame:
    """Block rows, and (term, df) rows of the asked terms beside them: both from one reading of the texts."""
    doc = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Block] = {}
        df: Counter = Counter()
        kind = None
        for b in slices(batches):
            kind = b.column(0).type
            for doc_id, digest, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(),
                                            b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts = counts_of(text)
                if not counts:
                    continue
                df.update(asked & counts.keys())
                entries = signature_entries(counts)
                cls = min((len(entries) - 1).bit_length(), MAX_CLASS)
                block = open_.setdefault(cls, _Block(cls))
                block.ids.append(doc_id)
                block.digests.append(digest)
                block.lengths.append(sum(counts.values()))
                block.entries.append(entries)
                if len(block.ids) >= block.room:
                    yield open_.pop(cls).row(kind)
        for block in open_.values():
            yield block.row(kind)
        if df:
            n = len(df)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(list(df), pa.binary()),
                 pa.array(list(df.values()), pa.int64())],
                names=["ids", "digests", "lengths", "n_bits", "rows", "term", "df"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(
        build, f"ids array<{doc}>, digests array<long>, lengths array<long>, n_bits long, rows binary, term binary, df long")


class Queries:
    """Distinct terms of a block of queries and their weights; what a task needs to bound or score a document."""

    def __init__(self, ids: list, terms: list[dict[bytes, int]], df: dict[bytes, int], n_docs: int, n_terms: int):
        known = sorted({t for q in terms for t in q if df.get(t)})
        self.ids, self.n_docs, self.n_terms = ids, n_docs, n_terms
        self.number = {t: i for i, t in enumerate(known)}
        self.weight = np.array([weight(n_docs, df[t]) for t in known], np.int64)
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in known], np.uint64)
        self.asked = [{self.number[t]: n for t, n in q.items() if t in self.number} for q in terms]
        self.times = np.zeros((len(ids), len(known)))
        for q, asked in enumerate(self.asked):
            self.times[q, list(asked)] = list(asked.values())

    def bounds(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(queries, documents) upper bounds from a block's bitmap; whole numbers, exact as doubles."""
        m, docs = length_part(lengths, self.n_docs, self.n_terms), len(lengths)
        worth = np.zeros((len(self.weight), docs))
        active, level = np.arange(len(self.weight)), 0
        marked = np.full((len(active), rows.shape[1]), 0xFF, np.uint8)
        while len(active) and 1 << level <= lengths.max(initial=0):  # no term occurs more often than the longest text has terms
            at = positions(entry_hash(self.hashes[active], level), len(rows))
            marked = np.bitwise_and.reduce(rows[at], axis=1) & marked
            some = marked.any(axis=1)
            active, marked = active[some], marked[some]
            if not len(active):
                break
            t, d = np.nonzero(np.unpackbits(marked, axis=1, count=docs, bitorder="little"))
            most = np.minimum((1 << (level + 1)) - 1, lengths[d])
            worth[active[t], d] = self.weight[active[t]] * ((10**9 * most) // (1000 * most + 12 * m[d]))
            level += 1
        return self.times @ worth

    def scores(self, text: bytes | None, queries: list[int]) -> list[int]:
        counts = counts_of(text)
        n = sum(counts.values())
        m = length_part(n, self.n_docs, self.n_terms) if n else 0
        found = {self.number[t]: tf for t, tf in counts.items() if t in self.number}
        gain = {i: int(self.weight[i]) * ((10**9 * tf) // (1000 * tf + 12 * m)) for i, tf in found.items()}
        return [sum(times * gain.get(i, 0) for i, times in self.asked[q].items()) for q in queries]


def _blocks(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for i in range(b.num_rows):
            ids, digests, lengths, n_bits, rows = (b.column(c)[i] for c in range(5))
            lengths = lengths.values.to_numpy()
            yield ids.values, digests.values, lengths, np.frombuffer(rows.as_buffer(), np.uint8).reshape(n_bits.as_py(), -1)


def _best_bounds(blocks: DataFrame, queries: Queries, doc: str, first: int) -> DataFrame:
    """(query, doc_id, digest, bound): of every block and query the documents with the ``first`` largest bounds above 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, lengths, rows in _blocks(batches):
            bound = queries.bounds(rows, lengths)
            k = min(first, bound.shape[1])
            best = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(bound)), k)
            d = best.ravel()
            some = bound[q, d] > 0
            q, d = q[some], d[some]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.take(pa.array(d)), digests.take(pa.array(d)),
                                              pa.array(bound[q, d].astype(np.int64))], names=["query", "doc_id", "digest", "bound"])

    return blocks.mapInArrow(run, f"query int, doc_id {doc}, digest long, bound long")


def _reaching(blocks: DataFrame, queries: Queries, least: np.ndarray, doc: str) -> DataFrame:
    """(doc_id, digest, queries): every document not proven to stay below a query's least score, with those queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, lengths, rows in _blocks(batches):
            d, q = np.nonzero((queries.bounds(rows, lengths) >= np.maximum(least, 1)[:, None]).T)
            if len(d):
                which, begin = np.unique(d, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(d)], pa.int32()), pa.array(q, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), digests.take(pa.array(which)), lists],
                                                 names=["doc_id", "digest", "queries"])

    return blocks.mapInArrow(run, f"doc_id {doc}, digest long, queries array<int>")


def _exact(docs: DataFrame, wanted: DataFrame, queries: Queries, doc: str) -> DataFrame:
    """(query, doc_id, score) of the wanted documents, from their whole texts.

    ``wanted`` has one row per (doc_id, digest). The join is Spark's choice from the written table's size.
    """
    pick = wanted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "queries")
    met = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(
        pick, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("doc_id", "text", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            asked = b.column(2).to_pylist()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            scores = [s for text, qs in zip(texts, asked, strict=True) for s in queries.scores(text, qs)]
            row = np.repeat(np.arange(b.num_rows), [len(qs) for qs in asked])
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for qs in asked for q in qs], pa.int32()), b.column(0).take(pa.array(row)),
                 pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return met.mapInArrow(run, f"query int, doc_id {doc}, score long").where("score > 0")


def _one_row_each(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("query")).alias("queries"))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): terms of every query, counted in Spark."""
    item = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = [counts_of(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            row = np.repeat(np.arange(b.num_rows), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array([t for c in counts for t in c], pa.binary()),
                 pa.array([n for c in counts for n in c.values()], pa.int64())], names=["item_id", "term", "times"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {item}, term binary, times long").groupBy(
        "item_id", "term").agg(F.sum("times").alias("times"))


def _search_block(spark: SparkSession, docs: DataFrame, asked: dict, item: str, top: int, first: int, folder: str) -> DataFrame:
    doc = docs.schema["doc_id"].dataType.simpleString()
    index = _write(_index_rows(docs, frozenset(t for q in asked.values() for t in q)), f"{folder}/index")
    df = {bytes(r["term"]): r["df"] for r in index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    blocks = index.where("rows is not null").select("ids", "digests", "lengths", "n_bits", "rows")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)),
                                 F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    queries = Queries(list(asked), list(asked.values()), df, n_docs, n_terms)

    bounds = _best_bounds(blocks, queries, doc, first)
    largest = Window.partitionBy("query").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last(), "digest")
    sure = bounds.withColumn("nth", F.row_number().over(largest)).where(F.col("nth") <= first)
    sample = _exact(docs, _write(_one_row_each(sure), f"{folder}/first"), queries, doc)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    least = np.zeros(len(asked), np.int64)
    for r in sample.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == top).collect():
        least[r["query"]] = r["score"]

    wanted = _write(_reaching(blocks, queries, least, doc).groupBy("doc_id", "digest").agg(
        F.first("queries").alias("queries")), f"{folder}/wanted")
    scored = _exact(docs, wanted, queries, doc)
    best = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(asked)), f"query int, item_id {item}")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, first: int = FIRST, block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each query's ``top`` documents with a score above 0.

    Queries come in blocks of about ``block`` (dealt by a hash of their id); only a block's terms reach the driver.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    terms = query_terms(items)
    n = max(1, -(-items.select("item_id").distinct().count() // block))
    out = None
    for k in range(n):
        asked: dict = defaultdict(dict)
        for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "term").collect():
            asked[r["item_id"]][bytes(r["term"])] = r["times"]
        part = _search_block(spark, docs, dict(asked), items.schema["item_id"].dataType.simpleString(), top, first, f"{folder}/{k}")
        out = part if out is None else out.unionByName(part)
    return out


#: The same rows in SQL.
ORACLE = r"""
with term_rows as (
  select rowid_, doc_id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rowid_, doc_id, "text" from documents)),
tf as (select rowid_, doc_id, term, count(*) as tf from term_rows group by all),
len as (select rowid_, sum(tf)::bigint as n from tf group by 1),
tot as (select count(*) as n_docs, sum(n)::bigint as n_terms from len),
df as (select term, count(*) as df from tf group by 1),
q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
s as (
  select q.item_id, tf.rowid_, tf.doc_id,
         sum(q.times * cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df.df + 1)::double)) as bigint)
             * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + (25 * len.n * n_docs) // n_terms))))::bigint as score
  from q join tf on q.term = tf.term join df on df.term = q.term join len on len.rowid_ = tf.rowid_ cross join tot
  group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 20
"""
