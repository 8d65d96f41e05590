"""Spelling variants by a relational trie frontier.

Two words at distance one agree in their first or in their second half. So the
vocabulary stands in two tries, of the words and of the words read backwards,
each as an edge table (node, letter, child), where a node is a 64-bit hash of
its prefix. A state is (word, position, node, edits). States without an edit
are the words' own paths from the middle on; joined with the edges at their
node they follow another letter (one replacement) or leave their own letter
out and follow the next one (one deletion). From then on every step joins the
states with the edge of their next letter, until their word is used up; a state
that then stands where another word ends is a pair of neighbours. Inserted
letters are deletions seen from the other word, and a replacement is followed
from the smaller letter only. Edges know the lengths and the next two letters of the words below,
so states that cannot end are dropped at once.

Joins are shuffled equi-joins on (node) and (node, letter), with at most one edge per letter on the
other side, so that adaptive execution can split a node of many states. Words
of more than ``LONG`` letters would need as many steps as they have letters;
they are joined on their common half at once. Every pair found is checked on the
letters themselves, so a clash of hashes cannot show.

Defined cases: null and empty texts have no words; a null doc_id counts as the
empty text in the hash; texts are read whole; repeated rows count each; ties in
count go to the word first in code-point order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, partitions, slices

MODULUS, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Words of more letters are joined on halves instead of walking the trie.
LONG = 40
#: Words a task counts before it hands them on.
HELD = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def variant(prefix_crc: int, run: str, modulus: int = MODULUS) -> str:
    """The run, without one letter if the modulus divides the crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, modulus: int = MODULUS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): counted in the tasks first, then added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = text.lower() if text.isascii() else text.encode().lower().decode()
                own = Counter(_RUN.findall(low))
                crc = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    word = variant(crc, word, modulus)
                    if len(word) >= min_length:
                        total[word] += n
            if len(total) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    read = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _node(side: Column, letters: Column, n: Column) -> Column:
    return F.xxhash64(side, F.substring(letters, F.lit(1), n))


def _letter(at: Column) -> Column:
    """The letter at a position from 0, empty beyond the word's end."""
    return F.substring(F.col("letters"), at + 1, F.lit(1))


def _shifted(places: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), places.cast("int"))


def _bit(letter: Column) -> Column:
    return _shifted(F.pmod(F.ascii(letter), F.lit(61)))


def both_ways(words: DataFrame) -> DataFrame:
    """(side, letters, len): every word as it is and read backwards."""
    ways = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("letters")),
                   F.struct(F.lit(1).alias("side"), F.reverse("word").alias("letters")))
    return words.select(F.explode(ways).alias("w")).select("w.*").withColumn("len", F.length("letters"))


def trie_paths(words: DataFrame) -> DataFrame:
    """(side, letters, len, pos, node, child): the trie steps of every word from its middle on, pos letters before the step."""
    rows = both_ways(words).withColumn("pos", F.explode(F.sequence(F.expr("len div 2").cast("int"), F.col("len") - 1)))
    return rows.withColumn("node", _node(F.col("side"), F.col("letters"), F.col("pos"))).withColumn(
        "child", _node(F.col("side"), F.col("letters"), F.col("pos") + 1))


def trie_edges(paths: DataFrame) -> DataFrame:
    """node, letter, child and, of the words below child, bit sets of lengths, next and second next letters."""
    return paths.groupBy("node", _letter(F.col("pos")).alias("letter")).agg(
        F.min("child").alias("child"), F.bit_or(_shifted(F.col("len"))).alias("lengths"),
        F.bit_or(_bit(_letter(F.col("pos") + 1))).alias("next1"), F.bit_or(_bit(_letter(F.col("pos") + 2))).alias("next2"))


def _can_end(pos: Column, length: Column) -> Column:
    """Whether words below the edge's child have this length and go on with the letters from ``pos`` on."""
    def has(bits: str, bit: Column) -> Column:
        return F.col(bits).bitwiseAND(bit) != 0

    return (has("lengths", _shifted(length)) & has("next1", _bit(_letter(pos)))
            & has("next2", _bit(_letter(pos + 1))))


def first_edits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(side, letters, len, target, pos, node): states with one edit, one letter after it; ``target`` is the near word's length."""
    middle = F.expr("len div 2").cast("int")
    own = paths.where(F.col("pos") >= F.when(F.col("side") == 0, middle).otherwise(F.col("len") - middle)).drop("child")
    met = own.join(edges, "node")
    pos, size = F.col("pos"), F.col("len")

    def state(edit: Column, after: Column, target: Column) -> Column:
        return F.when(edit & _can_end(after, target), F.struct(target.alias("target"), after.alias("pos")))

    edits = F.array_compact(F.array(
        state(F.col("letter") > _letter(pos), pos + 1, size),
        state((pos + 1 < size) & (F.col("letter") == _letter(pos + 1)), pos + 2, size - 1)))
    return met.select("side", "letters", "len", F.col("child").alias("node"), F.explode(edits).alias("e")).select(
        "side", "letters", "len", "e.target", "e.pos", "node")


def next_letter(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states that can follow their next letter, one step on."""
    met = states.withColumn("letter", _letter(F.col("pos"))).join(edges, ["node", "letter"])
    return met.where(_can_end(F.col("pos") + 1, F.col("target"))).select(
        "side", "letters", "len", "target", (F.col("pos") + 1).alias("pos"), F.col("child").alias("node"))


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def _trie_pairs(words: DataFrame) -> DataFrame:
    """(word, near): as long with a larger letter in one place, or without one letter of ``word``."""
    paths = trie_paths(words)
    n = partitions(words.sparkSession)
    edges = materialise(trie_edges(paths).repartition(n, "node", "letter"))
    states = materialise(first_edits(paths, edges))
    # the last letter left out: the word's own path one step before its end
    ends = [paths.where("pos = len - 1").select("side", "letters", "node")]
    while True:
        ends.append(states.where("pos = len").select("side", "letters", "node"))
        going = states.where("pos < len")
        if going.isEmpty():
            break
        states = materialise(next_letter(going, edges))
    ended = reduce(DataFrame.unionByName, ends)
    names = both_ways(words).select(_node(F.col("side"), F.col("letters"), F.col("len")).alias("node"),
                                    F.when(F.col("side") == 0, F.col("letters")).otherwise(F.reverse("letters")).alias("near"))
    word = F.when(F.col("side") == 0, F.col("letters")).otherwise(F.reverse("letters"))
    return ended.join(names, "node").select(word.alias("word"), "near").where(
        _one_edit(F.col("word"), F.col("near"))).distinct()


def _long_pairs(words: DataFrame, long: int) -> DataFrame:
    """(word, near) of words of ``long`` letters and more, not both of ``long``: joined on a common half."""
    def halves(size: Column) -> Column:
        half = F.floor(size / 2).cast("int")
        return F.explode(F.array(
            F.struct(F.lit(0).alias("half"), F.substring(F.col("word"), F.lit(1), half).alias("part")),
            F.struct(F.lit(1).alias("half"), F.substring(F.col("word"), F.length("word") - size + half + 1, size - half).alias("part"))))

    size = F.length("word")
    own = words.select("word", size.alias("size"), halves(size).alias("k")).select("word", "size", "k.*")
    same = own.where(F.col("size") > long).select(F.col("word").alias("near"), "size", "half", "part")
    longer = words.select(F.col("word").alias("near"), (size - 1).alias("size"), halves(size - 1).alias("k")).select(
        "near", "size", "k.*")
    met = own.join(same, ["size", "half", "part"]).where("word < near").unionByName(own.join(longer, ["size", "half", "part"]))
    return met.where(_one_edit(F.col("word"), F.col("near"))).select("word", "near").distinct()


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, near), both ways, for all distinct words that differ by one inserted, deleted or replaced code point."""
    pairs = _trie_pairs(words.where(F.length("word") <= long)).unionByName(
        _long_pairs(words.where(F.length("word") >= long), long))
    pairs = materialise(pairs)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every round doubles the way that is followed; forms never lead in a circle."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialise(at.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_groups(docs: DataFrame, modulus: int = MODULUS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                    ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialise(count_words(docs, modulus, min_length, min_count))
    near_n = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = near_pairs(words.select("word"), long).join(near_n, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    most = -F.col("best.minus")
    rows = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(most >= ratio * F.col("n"), F.col("best.near")).alias("form"), F.when(most >= ratio * F.col("n"), most).alias("form_n")))
    found = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
