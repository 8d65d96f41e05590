"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: bit i is set when it is set in over half of the XXH64 hashes of
a text's word shingles. Distinct fingerprints within ``max_bits`` bits are
linked. Of ``max_bits + 1`` blocks of bits, two linked fingerprints agree in at
least one, so the trie is laid out once per block with that block's bits first:
its nodes there (one Spark group each) pair with themselves only, and below them
node pairs are traversed together, their differing bits added up, and a pair is
pruned when it passes the error budget. A node with more than ``max_node``
fingerprints is divided the same way by its remaining bits before traversal.
Connected components come from alternating large-star and small-star rounds.

Every step works on distinct fingerprints, so copies cost nothing; a
fingerprint has at most 2,080 others within two bits, so links grow with the
input and not with its square.

Defined cases: null or wordless text has fingerprint zero and is linked like
any other; fewer words than a shingle give one shingle; repeated rows share a
component; a null id joins its component but never names it unless alone; an
empty table gives an empty result; other columns are ignored (kept by
``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carry, materialise, slices

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints of one trie node that one task traverses; larger nodes are divided first.
MAX_NODE = 20_000
#: Node pairs handled at a time.
FRONTIER = 200_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.uint64:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.uint64(0)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle_words, len(words))
    last = ends[k - 1:].tolist()
    first = [0, *(ends[:len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at:at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def with_fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long; with ``digest`` the text's digest as ``sha`` too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    also = [text_digest(F.col("text")).alias("sha")] if digest else []

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]],
                                             names=["doc_id", "fp", *b.schema.names[2:]])

    return docs.select("doc_id", "text", *also).mapInArrow(
        hashed, f"doc_id {kind}, fp long" + (", sha string" if digest else ""))


def text_digest(text: Column) -> Column:
    """SHA-256 of the whole text; the null text has the empty digest, so no row's digest is null."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def trie_pairs(group: np.ndarray, bits: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of equal ``group`` whose ``bits`` differ in at most ``budget`` places.

    ``group`` and ``bits`` are sorted by (group, bits), bits distinct within a
    group. A trie node is a range of rows that agree in the first ``depth``
    bits; a frontier is a set of node pairs of one depth with the bits they
    differ in so far.
    """
    n = len(bits)
    if n < 2:
        return
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    before: dict[int, np.ndarray] = {}
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, err))), (depth, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        own = a0 == b0  # the node with itself
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            two = leaf & ~own
            i, j = a0[two], b0[two]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err, own = (x[~leaf] for x in (a0, a1, b0, b1, err, own))
        if depth == 64 or not len(a0):
            continue
        if depth not in before:
            one = (bits >> np.uint64(63 - depth)) & np.uint64(1)
            before[depth] = np.r_[0, np.cumsum(one.astype(np.int64))]
        ones = before[depth]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # a node's zeros come before its ones
        out = []
        for x0, x1, y0, y1, more, which in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None),
                                            (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~own)):
            ok = (x1 > x0) & (y1 > y0) & (err + more <= budget)
            if which is not None:
                ok &= which  # a node with itself has this pair already, the other way round
            out.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + more))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*out, strict=True))))


def _blocks(free: int, parts: int) -> list[int]:
    """The set bits of ``free`` in ``parts`` runs of about equal length, as masks."""
    at = [i for i in range(63, -1, -1) if free >> i & 1]
    cut = [round(len(at) * k / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in at[cut[k]:cut[k + 1]]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _traverse(rows: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between the fingerprints of each (path, top) node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def links(path, top, fp):
            new = np.r_[True, (path[1:] != path[:-1]) | (top[1:] != top[:-1])] if len(path) else np.zeros(0, bool)
            group = np.cumsum(new)
            bits = (fp.view(np.uint64) ^ np.uint64(1 << 63))  # the order of signed longs as unsigned
            for i, j in trie_pairs(group, bits, budget):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

        for b in batches:
            cols = [np.concatenate([h, b.column(k).to_numpy()]) for k, h in enumerate(held)]
            if not len(cols[0]):
                continue
            # the last node may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(same))
            held = [c[cut:] for c in cols]
            yield from links(*(c[:cut] for c in cols))
        yield from links(*held)

    laid = rows.repartition("path", "top").sortWithinPartitions("path", "top", "fp")
    return laid.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_node: int = MAX_NODE) -> DataFrame:
    """(a, b) for distinct fingerprints ``fp`` within ``max_bits`` bits; a pair may come more than once."""
    parts = max_bits + 1
    found = None
    nodes = [(i, m, (1 << 64) - 1 & ~m) for i, m in enumerate(_blocks((1 << 64) - 1, parts))]  # path, top, free bits
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("top"))
        for i, m, _ in nodes])).alias("n")).select("n.path", "n.top", "fp")
    while True:
        free_bits = min(bin(f).count("1") for _, _, f in nodes)
        large = None
        if 1 << free_bits > max_node:  # otherwise no node can hold more
            large = materialise(rows.groupBy("path", "top").count().where(F.col("count") > max_node)
                                .select("path", "top"))
            large = None if large.isEmpty() else large
        light = rows if large is None else rows.join(large, ["path", "top"], "left_anti")
        part = _traverse(light, max_bits)
        found = part if found is None else found.unionByName(part)
        if large is None:
            return found
        heavy = materialise(rows.join(large, ["path", "top"], "left_semi"))
        below = []
        for path, top, free in nodes:
            for block in _blocks(free, parts):
                below.append((len(below), path, top | block, free & ~block))
        options = [F.struct(F.lit(i).alias("path"), F.lit(p).alias("up"),
                            F.col("fp").bitwiseAND(F.lit(_signed(t))).alias("top")) for i, p, t, _ in below]
        rows = heavy.select("fp", F.col("path").alias("was"), F.explode(F.array(*options)).alias("n")).where(
            F.col("n.up") == F.col("was")).select("n.path", "n.top", "fp")
        nodes = [(i, t, f) for i, _, t, f in below]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of the links (a, b), for nodes with a link.

    Alternating large-star and small-star rounds, each checkpointed; minima are
    partial aggregates and edges are joined to them by node, so a node with a
    third of all links is divided like any skewed join. The driver sees a count
    and a checksum per round.
    """
    def mins(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = mins(both).select("u", F.least("u", "m").alias("m"))
        return both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        m = mins(down)
        linked = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        return linked.unionByName(m.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u != v").distinct())
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = materialise(small(large(edges)))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(own: DataFrame, max_bits: int, max_node: int) -> DataFrame:
    """The rows of ``own``, one per fingerprint ``fp``, with their component's smallest fingerprint ``root`` (never null)."""
    roots = components(links(own.select("fp"), max_bits, max_node))
    return own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    max_node: int = MAX_NODE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    marked = materialise(with_fingerprint(docs, shingle_words))
    own = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = _rooted(own, max_bits, max_node)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
             max_node: int = MAX_NODE) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the smallest id (null ids last), then text digest.

    Components are told apart by their root fingerprint, so null ids stand alone
    like any others. The row is fetched by id and text, as one id may have
    several texts; a text lies in one component only.
    """
    marked = with_fingerprint(docs, shingle_words, digest=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha"))
    own = materialise(marked.groupBy("fp").agg(first.alias("first")))
    keep = _rooted(own, max_bits, max_node).groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("keep_id"), F.col("first.sha").alias("keep_sha"))
    met = carry(docs, id=F.col("doc_id"), sha=text_digest(F.col("text"))).join(
        keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    # rows that agree in id and text: one stays; the grouping key holds no more than such repeats
    return met.dropDuplicates(["id", "sha"]).select("row.*")
