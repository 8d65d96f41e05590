"""Packing token pieces into sequences by cutting-stock column generation.

A document's ids (with the closing id) are cut into full sequences and one
remainder. Short pieces count with their exact length, longer ones fall into
classes of graded width, 64 for each doubling, and count with their class's
upper length; that bounds the histogram, the linear program and the pattern
table, whatever the input's size. The patterns, rounded down,
are assigned to the pieces ranked by length within their class: rank r of a
class goes to the pattern, copy and place that hold the class's r-th slot. What
rounding leaves over is at most one sequence per pattern; it is laid end to end
and cut every ``capacity`` tokens, its last part at powers of two, so it is not
padded at all.

Defined cases: null text is empty and gives the closing id alone; special
strings inside texts count as the library's default treats them; repeated rows
are packed each on its own; null ids are kept; ties in rank are broken in any
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slices, with_rank
from tidemark.llm.cutting import whole_patterns
from tidemark.llm.tokens import load, usual

CAPACITY = 4096
END_ID = 2
#: Pieces up to so many tokens count with their exact length, longer ones in steps of up to one part in 64 of it.
EXACT = 128
#: Words per generation of the memo; at most two generations are held.
MEMO_WORDS = 300_000
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_PARTS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")

def _byte_letters() -> dict[int, str]:
    """The byte-level vocabulary's letter for every byte: printable Latin-1 characters stand for themselves, others for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class WordIds(dict):
    """word -> bytes of its little-endian 32-bit ids, in two generations: a full young one becomes the old one.

    ``plain`` words come from usual, lower-cased texts: those of letters only are one
    word for the tokenizer, so its model is asked directly, and others fall into parts that are
    looked up in turn. What is left goes through the whole tokenizer.
    """

    def __init__(self, path: str, plain: bool, words: int = MEMO_WORDS):
        super().__init__()
        self.tokenizer, self.plain, self.words, self.old = load(path), plain, words, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            spell = self.id_bytes
            if self.plain and word.isalpha():
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                found = b"".join([spell[t.id] for t in self.model.tokenize(spelt)])
            elif self.plain and len(parts := _PARTS.findall(word)) > 1:
                found = b"".join([self[p] for p in parts])
            else:
                found = b"".join([spell[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
        self[word] = found
        return found

    def make_room(self) -> None:
        if len(self) > self.words:
            self.old = dict(self)
            self.clear()


def memos(path: str) -> tuple[WordIds, WordIds]:
    """(for plain words, for others): one pair a task, so what a worker keeps does not add up."""
    return WordIds(path, True), WordIds(path, False, MEMO_WORDS // 10)


def encode_words(path: str, texts: list[str], memo: tuple[WordIds, WordIds] | None = None) -> list[bytes]:
    """Ids of whole texts as little-endian 32-bit numbers, for a tokenizer that drops white space.

    A text is taken apart where the parts' ids, one after another, are the
    text's. The tokenizer lower-cases and drops white space, so that is between
    words; for usual texts it also splits letters from marks.
    """
    plain, other = memo or memos(path)
    part, rest = plain.__getitem__, other.__getitem__
    out: list[bytes] = []
    for text in texts:
        if usual(text):
            out.append(b"".join(map(part, text.lower().split())))
            plain.make_room()
        else:
            out.append(b"".join(map(rest, [w for w in _SPACE.split(text) if w])))
            other.make_room()
    return out


def _encode(path: str, texts: list[str | None], end_id: int, memo: tuple[WordIds, WordIds]) -> list[bytes]:
    end = int(end_id).to_bytes(4, "little")
    return [ids + end for ids in encode_words(path, [t or "" for t in texts], memo)]


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, doc_crc (of the whole document)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memos(path)
        for b in slices(batches):
            row, start, length, crc, tokens, whole = [], [], [], [], [], []
            for i, ids in enumerate(_encode(path, b.column(1).to_pylist(), end_id, memo)):
                n, doc_crc = len(ids) // 4, zlib.crc32(ids)
                for s in range(0, n, capacity):
                    part = ids[4 * s:4 * (s + capacity)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(doc_crc if len(part) == len(ids) else zlib.crc32(part))
                    tokens.append(n)
                    whole.append(doc_crc)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, whole))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, doc_crc long")


def _tail_cuts(total: int, capacity: int) -> list[int]:
    """Where the stream's last, partly filled sequence is cut: its length in powers of two, largest first."""
    at, cuts = total - total % capacity, []
    rest = total - at
    while rest:
        cuts.append(at)
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
    return cuts


def _recut(docs: DataFrame, path: str, wanted: DataFrame, end_id: int) -> DataFrame:
    """(doc_id, doc_crc, start, length, ids_crc32) for the wanted cuts of the documents left over by rounding."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("doc_crc", "start", "length")).alias("cuts")).select(
        F.col("doc_id").alias("_id"), "cuts")
    # at most one sequence's pieces per pattern are left over: a bound that does not grow with the input
    met = docs.select("doc_id", "text").join(F.broadcast(lists), F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "doc_id", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memos(path)
        for b in slices(batches):
            row, cols = [], ([], [], [], [])
            cuts = b.column(2).to_pylist()
            for i, ids in enumerate(_encode(path, b.column(1).to_pylist(), end_id, memo)):
                doc_crc = zlib.crc32(ids)
                for c in cuts[i]:
                    if c["doc_crc"] == doc_crc:
                        row.append(i)
                        s, n = c["start"], c["length"]
                        for col, x in zip(cols, (doc_crc, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in cols)],
                names=["doc_id", "doc_crc", "start", "length", "ids_crc32"])

    return met.mapInArrow(cut, f"doc_id {kind}, doc_crc long, start long, length long, ids_crc32 long").distinct()


def length_class(length: Column, capacity: int, exact: int = EXACT) -> Column:
    """The length that a piece counts with: its own up to ``exact``, else rounded up by a step that doubles with the length."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(length - 1, F.lit(exact)))) - F.length(F.bin(F.lit(exact // 2))))
    rounded = F.least(F.ceil(length / step) * step, F.lit(capacity))
    return F.when(length <= exact, length).otherwise(rounded).cast("int")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, exact: int = EXACT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The driver sees the histogram of classes (``exact`` rows and 64 for each doubling beyond)
    and makes the pattern table from it; documents never leave the executors.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, path, capacity, end_id).withColumn(
        "cls", length_class(F.col("length"), capacity, exact))
    ranked = materialise(with_rank(pieces, ["cls"], ["length", "doc_id", "start", "doc_crc"], rank="nth"))
    histogram = {r["cls"]: r["count"] for r in ranked.groupBy("cls").count().collect()}
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, times = whole_patterns(sizes, demand, capacity)
    base = np.concatenate([[0], np.cumsum(times)])
    slots = []
    for j, s in enumerate(sizes.tolist()):
        filled = 0
        for p in np.flatnonzero(patterns[:, j]).tolist():
            per = int(patterns[p, j])
            slots.append((s, filled, filled + per * int(times[p]), per, int(base[p])))
            filled += per * int(times[p])
    sequences = int(base[-1])
    table = spark.createDataFrame(slots, "slot_cls int, lo long, hi long, per long, base long")
    n0 = F.col("nth") - 1
    placed = ranked.join(F.broadcast(table), (F.col("cls") == F.col("slot_cls")) & (n0 >= F.col("lo"))
                         & (n0 < F.col("hi")), "left")
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(nth - 1 - lo) div per"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "cls", "nth")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    first = placed.where(F.col("sequence_id").isNotNull()).withColumn(
        "offset", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))

    # what rounding left over: its size is bounded by the patterns, not by the input
    left = placed.where(F.col("sequence_id").isNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc", "cls", "nth")
    stream = Window.partitionBy(F.lit(0)).orderBy("cls", "nth").rowsBetween(Window.unboundedPreceding, 0)
    left = materialise(left.withColumn("to", F.sum("length").over(stream)).withColumn("from", F.col("to") - F.col("length")))
    total = left.agg(F.max("to")).first()[0] or 0
    tail = _tail_cuts(total, capacity)
    full = total - total % capacity
    marks = F.array(*[F.lit(t) for t in tail]).cast("array<long>") if tail else F.array().cast("array<long>")
    inner = F.filter(F.concat(marks, F.array((F.floor((F.col("to") - 1) / capacity) * capacity).cast("long"))),
                     lambda x: (x > F.col("from")) & (x < F.col("to")))
    left = left.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.array("from", "to"), inner))))
    left = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)))
    left = left.withColumn("a", F.element_at("cuts", F.col("k"))).withColumn("b", F.element_at("cuts", F.col("k") + 1))
    in_tail = F.size(F.filter(marks, lambda x: x <= F.col("a")))
    begun = F.when(F.col("a") < full, F.floor(F.col("a") / capacity) * capacity).otherwise(
        F.element_at(marks, F.greatest(in_tail, F.lit(1)))) if tail else F.floor(F.col("a") / capacity) * capacity
    left = left.select(
        "doc_id", "doc_tokens", "doc_crc", "ids_crc32", (F.col("start") + F.col("a") - F.col("from")).alias("start"),
        (F.col("b") - F.col("a")).alias("length"), F.size("cuts").alias("n_cuts"),
        (F.lit(sequences) + F.when(F.col("a") < full, F.floor(F.col("a") / capacity))
         .otherwise(F.lit(full // capacity) + in_tail - 1)).cast("long").alias("sequence_id"),
        (F.col("a") - begun).cast("long").alias("offset"))
    whole = left.where("n_cuts = 2").select(*columns)
    parts = left.where("n_cuts > 2").drop("ids_crc32")
    again = _recut(docs, path, parts.select("doc_id", "doc_crc", "start", "length"), end_id).select(
        F.col("doc_id").alias("_id"), F.col("doc_crc").alias("_crc"), F.col("start").alias("_start"),
        F.col("length").alias("_length"), "ids_crc32")
    parts = parts.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_crc") == F.col("_crc"))
                       & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length")), "left")
    return first.select(*columns).unionByName(whole).unionByName(parts.select(*columns))
