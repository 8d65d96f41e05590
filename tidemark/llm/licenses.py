"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A text block is a run of ``block_words`` words, one beginning every half block,
so a template of at most half a block lies whole in some block wherever it
stands. A block meets a template when it holds at least ``threshold`` of the
template's distinct words. The join is exact: words are ordered by their
frequency in the whole corpus (rarest first); a pair with the wanted overlap o
shares a word among the first |T| - o + 1 of the template and the first
|B| - o + 1 of the block, so only these prefixes are looked up; blocks of fewer
than o distinct words are passed over; and a shared word at places i and j leaves
room for at most 1 + min(|T| - i - 1, |B| - j - 1) more. Candidates are verified.

The templates are the given, short list; their index travels with the task.
Words of no template come last in the order: they can't match.

Defined cases: null text is empty; the empty text has no places, no labels and
score 0; very long texts are read whole, block by block; repeated rows and null
ids are scanned like any others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
THRESHOLD = 0.9
BLOCK_WORDS = 64

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def needed(size: int, threshold: float) -> int:
    """The least overlap that reaches the threshold: ceil(threshold * size), safe from rounding."""
    return max(1, math.ceil(threshold * size - 1e-9))


class Index:
    """Templates with their words in corpus frequency order, and the words of their prefixes."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[str, int], threshold: float):
        vocabulary = sorted({w for t in templates for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (text, label) in enumerate(sorted(templates.items())):
            own = sorted({self.rank[w] for w in words_of(text)})
            o = needed(len(own), threshold)
            self.templates.append((own, o, label, frozenset(own)))
            for i, w in enumerate(own[:len(own) - o + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.rare = frozenset(vocabulary[w] for w in self.prefix)

    def match(self, block: list[str]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that the block meets."""
        distinct = set(block)
        size = len(distinct)
        own = sorted(self.rank[w] for w in distinct if w in self.rank)  # the block's first words in the global order
        seen: dict[int, int] = {}
        for j, w in enumerate(own):
            for k, i in self.prefix.get(w, ()):
                t, o, _, _ = self.templates[k]
                if size < o or j > size - o:  # length filter; past the block's prefix for this overlap
                    continue
                got = seen.get(k, 0)
                if got >= 0 and got + 1 + min(len(t) - i - 1, size - j - 1) >= o:
                    seen[k] = got + 1
                else:
                    seen[k] = -1
        for k, got in seen.items():
            if got > 0:
                t, o, label, whole = self.templates[k]
                overlap = len(whole.intersection(own))
                if overlap >= o:
                    yield label, overlap / len(t)


def blocks(words: list[str], size: int) -> Iterator[list[str]]:
    half = size // 2
    for at in range(0, max(1, len(words) - half), half):
        yield words[at:at + size]


def phrase_places(words: list[str], phrases: Mapping[str, str]) -> tuple[list[int], set[str]]:
    line = " " + " ".join(words) + " "
    places, found = [], set()
    for phrase, label in phrases.items():
        at, place, before = line.find(f" {phrase} "), 0, 0
        while at >= 0:
            place, before = place + line.count(" ", before, at), at  # counted on from the last place
            places.append(place)
            found.add(label)
            at = line.find(f" {phrase} ", at + 1)
    return places, found


def template_frequencies(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> dict[str, int]:
    """How often each template word occurs in the whole corpus: one small row per word reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                total.update(filter(vocabulary.__contains__, words_of(t)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())],
                                             names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES,
         threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best containment of a template that some block meets, 1 if a
    phrase occurs, else 0.
    """
    longest = max([0, *(len(words_of(t)) for t in templates)])
    if longest > block_words // 2:
        raise ValueError("a template must fit in half a block")
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = Index(templates, template_frequencies(docs, templates), threshold)
    phrases = {" ".join(words_of(p)): label for p, label in phrases.items()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for text in b.column(1).to_pylist():
                words = words_of(text)
                places, base = phrase_places(words, phrases)
                labels, score = set(base), 1.0 if places else 0.0
                if not index.rare.isdisjoint(words):
                    for block in blocks(words, block_words):
                        if not index.rare.isdisjoint(block):
                            for label, part in index.match(block):
                                labels.add(label)
                                score = max(score, part)
                row = (len(words), len(places), min(places, default=None), max(places, default=None),
                       ",".join(sorted(base)), ",".join(sorted(labels)), score)
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        look, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")


def _templates_sql() -> str:
    return ", ".join(f"('{t}', '{label}')" for t, label in sorted(TEMPLATES.items()))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
ph(phrase, label) AS (VALUES ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')),
plc AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hit AS (
  SELECT rid, p - 1 AS place, label FROM plc, ph
  WHERE w[p] = string_split(phrase, ' ')[1] AND w[p:p + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')),
base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS bl
  FROM hit GROUP BY rid),
tpl(words, need, label) AS (
  SELECT list_distinct(string_split(t, ' ')), greatest(1, ceil(0.9 * len(list_distinct(string_split(t, ' '))) - 1e-9)), l
  FROM (VALUES @TEMPLATES@) v(t, l)),
blk AS (
  SELECT rid, list_distinct(w[a + 1:a + 64]) AS b
  FROM (SELECT rid, w, unnest(range(0, greatest(1, len(w) - 32), 32)) AS a FROM d WHERE len(w) > 0)),
met AS (
  SELECT rid, label, len(list_intersect(words, b)) / len(words)::DOUBLE AS part FROM blk, tpl
  WHERE list_has_any(words, b) AND len(list_intersect(words, b)) >= need),
tm AS (SELECT rid, list(DISTINCT label) AS tl, max(part) AS part FROM met GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(bl, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(tl, [])))), ',') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1e0 ELSE 0e0 END, coalesce(part, 0e0)) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN tm USING (rid)
""".replace("@TEMPLATES@", _templates_sql())
