"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

Terms are all lower-cased words of the labelled examples, and the words'
openings of 4 to 6 letters, known by 64-bit hashes. No word is left out: every
term weighs by its document frequency over the whole corpus and by its class,
i.e. by how much more often toxic examples use it than clean ones, faded out
smoothly where the counts are too small to tell. A word that tells nothing keeps the weight
``PLAIN``, an opening that tells less than that has none. The examples, at most
``PER_CLASS`` of each label, all stand in a block-max inverted index: a document
adds up the short postings of its rarer terms; the ``HEAD`` commonest terms are
kept in blocks of examples with the largest weight of every term in the block,
and a block is visited unless that bound shows that none of its examples can
reach the k-th best cosine, so the nearest examples found are exact. Their
labels vote with weights that fall with distance, shrunk towards the base rate;
the nearest examples' ids are returned as evidence.

Defined cases: null and empty text, and texts without any term, score the
toxic rate of training examples without terms, shrunk towards the base rate; without
training labels every score is 0; texts are read whole; ties in cosine go to the example that comes
first; repeated rows score alike; an empty table gives an empty result; other
columns are ignored (kept by ``reject_toxic``).
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_bucket, in_tasks, slices
from tidemark.llm.samples import label_share, labelled_sample

FOLDS, HELD_OUT = 4, 2
#: Most training examples per label.
PER_CLASS = {1: 4000, 0: 8000}
#: The class weight of a word that tells nothing; telling terms weigh their log ratio, at half height at this z-value.
PLAIN, HALF_Z = 0.1, 5.0
OPENINGS = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 256
#: Most terms kept in blocks; a term of fewer examples than LONG has its posting list only.
HEAD, LONG = 512, 64
#: Documents searched together.
TOGETHER = 64
SHRINK = 0.3
THRESHOLD = 0.3
#: Characters whose words are looked up together.
PORTION = 1_000_000
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_SIGNS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80-\x8f][\x80-\xbf]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters in UTF-8: ASCII letters and all characters beyond ASCII but signs and punctuation."""
    low = (text or "").lower().encode("utf-8", "surrogatepass")
    if not low.isascii() and (b"\xc2" in low or b"\xe2" in low):
        low = _SIGNS.sub(b" ", low)
    return low.translate(_LETTERS).split()


def portions(texts: list[str | None]) -> Iterator[slice]:
    """The texts in slices of about ``PORTION`` characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PORTION or i + 1 == len(texts):
            yield slice(at, i + 1)
            at, size = i + 1, 0


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def openings(word: bytes) -> list[bytes]:
    """The openings of a word, which end in a star."""
    if word.isascii():
        return [word[:k] + b"*" for k in OPENINGS if len(word) > k]
    text = word.decode("utf-8", "surrogatepass")
    return [text[:k].encode("utf-8", "surrogatepass") + b"*" for k in OPENINGS if len(text) > k]


def term_hashes(word: bytes) -> list[int]:
    """64-bit hashes of a word and of its openings as signed numbers."""
    return [_signed(h) for h in map(xxhash.xxh64_intdigest, (word, *openings(word)))]


class Lookup:
    """Texts -> counts of the known terms, given by their hashes in ascending order.

    ``stems`` are the first bytes of the words that have known openings; other words are looked up whole only.
    Nothing is kept from one call to the next but the hashes, so a worker's memory is bounded by the texts of a call.
    """

    def __init__(self, hashes: np.ndarray, stems: set[bytes]):
        self.hashes, self.stems = hashes, stems

    def _find(self, names: Iterable[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the names are terms, the terms' numbers)."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, n).view(np.int64)
        at = np.searchsorted(self.hashes, h)
        known = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
        return known, at[known]

    def _terms(self, words: Iterable[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, terms) of distinct words: those of the word i are terms[starts[i]:starts[i + 1]].

        Openings that words share are looked up once.
        """
        opened: defaultdict[bytes, int] = defaultdict(count().__next__)
        owner, which = array("q"), array("q")
        for i, w in enumerate(words):
            if w[:OPENINGS[0]] in self.stems:
                for o in openings(w):
                    owner.append(i)
                    which.append(opened[o])
        whole, terms = self._find(words, n)
        some, found = self._find(opened, len(opened))
        number = np.full(len(opened), -1)
        number[some] = found
        number = number[np.array(which, np.int64)]
        owners = np.r_[whole, np.array(owner, np.int64)[number >= 0]]
        by = np.argsort(owners, kind="stable")
        return np.searchsorted(owners, np.arange(n + 1), sorter=by), np.r_[terms, number[number >= 0]][by]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term, count), in order of text and term."""
        if not len(self.hashes):
            return (np.zeros(0, np.int64),) * 3
        codes: defaultdict[bytes, int] = defaultdict(count().__next__)
        coded = [np.array([codes[w] for w in words_of(t)], np.int32) for t in texts]
        starts, terms = self._terms(codes, len(codes))
        sizes = [len(c) for c in coded]
        code = np.concatenate([np.zeros(0, np.int32), *coded])
        place, which = _ranges(starts[code], starts[code + 1])
        text = np.repeat(np.arange(len(coded)), sizes)[which]
        key, n = np.unique(text * len(self.hashes) + terms[place], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), n


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, range numbers) of all places in the ranges, one range after another."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) + (start - (np.cumsum(n) - n))[which], which


class BlockMaxIndex:
    """Labelled unit vectors: postings of all terms; those of the commonest also in blocks with largest weights.

    A vector is {term: weight} or a pair of arrays (terms, weights). The blocks
    are made from the postings where they are used, so they are never sent.
    """

    def __init__(self, vectors: list, labels: list[int], ids: list, n_terms: int, block: int = BLOCK,
                 head: int = HEAD, long: int = LONG):
        pairs = [_pair(v) for v in vectors]
        # examples with the same leading term stand together, so block maxima are tight
        lead = [int(t[np.lexsort((t, -w))[0]]) for t, w in pairs]
        order = sorted(range(len(pairs)), key=lambda i: (lead[i], i))
        self.block, self.n_blocks = block, -(-len(order) // block)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.ids = [ids[i] for i in order]
        term = np.concatenate([np.zeros(0, np.int32), *(pairs[i][0].astype(np.int32, copy=False) for i in order)])
        by = np.argsort(term, kind="stable")
        self.begin = np.searchsorted(term, np.arange(n_terms + 1), sorter=by).astype(np.int64)
        del term
        small = np.min_scalar_type(max(len(order), block))  # two bytes an entry instead of eight
        self.example = np.repeat(np.arange(len(order), dtype=small), [len(pairs[i][0]) for i in order])[by]
        self.weight = np.concatenate([np.zeros(0), *(pairs[i][1] for i in order)])[by]
        held = np.diff(self.begin)
        common = np.argsort(-held, kind="stable")[:head]
        self.common = common[held[common] >= long]
        self.blocks = None

    def __getstate__(self):
        return self.__dict__ | {"blocks": None, "top": None, "place": None}

    def _make_blocks(self) -> None:
        self.place = np.full(len(self.begin) - 1, -1, np.int32)  # of the common terms within a block
        self.place[self.common] = np.arange(len(self.common))
        self.blocks = np.zeros((self.n_blocks, len(self.common), self.block))
        for k, t in enumerate(self.common.tolist()):
            e, w = (x[self.begin[t]:self.begin[t + 1]] for x in (self.example, self.weight))
            self.blocks[e // self.block, k, e % self.block] = w
        self.top = self.blocks.max(axis=2, initial=0.0).T  # (common terms, blocks)

    def _rarer(self, terms: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """Scores from the postings of these terms."""
        if not len(terms):
            return np.zeros(width)
        begin, end = self.begin[terms], self.begin[terms + 1]
        n = end - begin
        place = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        return np.bincount(self.example[place], np.repeat(weights, n) * self.weight[place], width)

    def _least(self, scores: np.ndarray, k: int) -> np.ndarray:
        """Per row a score that k examples reach at least: the k-th of the maxima over the examples at one place of all blocks."""
        if self.block < k:
            return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.zeros(len(scores))
        most = scores.reshape(len(scores), self.n_blocks, self.block).max(axis=1, initial=0.0)
        return np.partition(most, -k, axis=1)[:, -k]

    def nearest(self, vector, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a cosine above 0, nearest first."""
        return self.search([vector], k)[0]

    def search(self, vectors: list, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """What ``nearest`` finds, for several vectors at once."""
        if self.blocks is None:
            self._make_blocks()
        width = self.n_blocks * self.block
        scores = np.zeros((len(vectors), width))
        asked = np.zeros((len(vectors), len(self.top)))
        for i, vector in enumerate(vectors):
            terms, weights = _pair(vector)
            at = self.place[terms]
            asked[i, at[at >= 0]] = weights[at >= 0]
            scores[i] = self._rarer(terms[at < 0], weights[at < 0], width)
        least = self._least(scores, k)
        bound = scores.reshape(len(vectors), self.n_blocks, self.block).max(axis=2, initial=0.0) + asked @ self.top
        visit = bound >= np.maximum(least - 1e-8, 1e-300)[:, None]
        for b in range(self.n_blocks):
            rows = np.flatnonzero(visit[:, b])
            if 2 * len(rows) > len(vectors):  # no copies of most rows
                scores[:, b * self.block:(b + 1) * self.block] += asked @ self.blocks[b]
            elif len(rows):
                scores[rows, b * self.block:(b + 1) * self.block] += asked[rows] @ self.blocks[b]
        out = []
        for row, low in zip(scores, self._least(scores, k), strict=True):
            at = np.flatnonzero(row >= max(low - 1e-8, 1e-300))
            cosine = np.round(row[at], 9)
            best = np.lexsort((at, -cosine))[:k]
            out.append((at[best], cosine[best]))
        return out


def _pair(vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, dict):
        return np.array(list(vector), np.int64), np.array(list(vector.values()), np.float64)
    return vector


def unit_arrays(terms: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of length 1, terms in order and without those of no weight."""
    by = np.argsort(terms)
    terms, n = terms[by], n[by]
    raw = (1.0 + np.log(n)) * weight[terms]
    some = raw > 0
    terms, raw = terms[some], raw[some]
    return terms, raw / math.sqrt(float(raw @ raw)) if len(raw) else raw


def unit(counts: dict[int, int], weight: np.ndarray) -> dict[int, float]:
    n = len(counts)
    terms, w = unit_arrays(np.fromiter(counts, np.int64, n), np.fromiter(counts.values(), np.float64, n), weight)
    return dict(zip(terms.tolist(), w.tolist(), strict=True))


class Model:
    def __init__(self, lookup: Lookup, weight: np.ndarray, index: BlockMaxIndex | None, rate: float, rest: float):
        self.lookup, self.weight, self.index, self.rate, self.rest = lookup, weight, index, rate, rest

    def scores(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """(score, ids of the nearest examples) per text."""
        out: list[tuple[float, list]] = [(self.rest, [])] * len(texts)
        for some in portions(texts) if self.index else ():
            text, term, n = self.lookup.counts(texts[some])
            cut = np.searchsorted(text, np.arange(some.stop - some.start + 1))
            vectors = [unit_arrays(term[a:b], n[a:b], self.weight) for a, b in pairwise(cut)]
            told = [i for i, v in enumerate(vectors) if len(v[0])]
            for at in range(0, len(told), TOGETHER):
                part = told[at:at + TOGETHER]
                for i, (near, cosine) in zip(part, self.index.search([vectors[i] for i in part]), strict=True):
                    weight = 1.0 / (1.05 - np.minimum(cosine, 1.0))  # by distance; an equal example counts 20 times a far one
                    votes = float(weight @ self.index.labels[near])
                    out[some.start + i] = ((votes + SHRINK * self.rate) / (float(weight.sum()) + SHRINK),
                                           [self.index.ids[j] for j in near])
        return out


def class_weights(toxic_df: np.ndarray, clean_df: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Per term the log ratio of its shares in toxic and clean examples, from 0 up, faded by its z-value."""
    n, both = toxic + clean, toxic_df + clean_df
    ratio = np.log((toxic_df + 0.5) / (toxic + 0.5)) - np.log((clean_df + 0.5) / (clean + 0.5))
    spread = np.sqrt(both * toxic * clean * (n - both) / (n * n * max(n - 1, 1)) + 1e-9)
    z = np.maximum(toxic_df - both * toxic / n, 0.0) / spread
    return z ** 4 / (z ** 4 + HALF_Z ** 4) * np.maximum(ratio, 0.0)


def choose_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, set[bytes]]:
    """(term hashes, class weights, stems): all words of the sample and its telling openings.

    One row of numbers per term reaches the driver, with the stem of an opening; the sample's bound is theirs too.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for some in portions(texts):
                total: tuple[Counter, Counter] = Counter(), Counter()  # of clean and toxic examples
                stem: dict[int, bytes | None] = {}
                for label, text in zip(b.column(0)[some.start:some.stop].to_pylist(), texts[some], strict=True):
                    own: dict[int, bytes | None] = {}
                    for w in set(words_of(text)):
                        whole, *opened = term_hashes(w)
                        own[whole] = None
                        for h in opened:
                            own.setdefault(h, w[:OPENINGS[0]])
                    total[label].update(own.keys())
                    for h, s in own.items():
                        stem.setdefault(h, s)
                if stem:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(stem, pa.int64()), *(pa.array([t[h] for h in stem], pa.int64()) for t in total),
                         pa.array(stem.values(), pa.binary())], names=["term", "clean", "toxic", "stem"])

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    per = sample.where("label in (0, 1)").select(F.col("label").cast("long"), "text").mapInArrow(
        count, "term long, clean long, toxic long, stem binary").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b"), F.max("stem").alias("stem"))
    more = (F.col("a") + 0.5) / (toxic + 0.5) > (F.col("b") + 0.5) / (clean + 0.5)  # the others' log ratio is not above 0
    found = per.where(F.col("stem").isNull() | more).toArrow()
    terms = found.column("term").to_numpy()
    word = found.column("stem").is_null().to_numpy()
    a, b = (found.column(c).to_numpy().astype(np.float64) for c in ("a", "b"))
    weight = class_weights(a, b, toxic, clean) if len(terms) else np.zeros(0)
    weight = np.where(word, PLAIN + weight, np.where(weight >= PLAIN, weight, 0.0))
    some = weight > 0
    stems = set(found.column("stem").filter(pa.array(some & ~word)).to_pylist())
    terms, weight = terms[some], weight[some]
    order = np.argsort(terms)
    return terms[order], weight[order], stems


def document_frequencies(docs: DataFrame, lookup: Lookup) -> tuple[int, np.ndarray]:
    """(documents, document frequency per term) over all documents; one small row per term reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(lookup.hashes), np.int64)
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            n += len(texts)
            for some in portions(texts):
                df += np.bincount(lookup.counts(texts[some])[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], names=["t", "n"])

    sums = docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = sums.column("t").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(len(lookup.hashes))
    df[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), df


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
        per_class: dict[int, int] | None = None, seed: int = 5) -> Model:
    """The model from at most ``per_class`` training examples per label and corpus-wide document frequencies."""
    train = fold_bucket(F.col("doc_id"), folds) != held_out
    sample = labelled_sample(docs, labels, "toxic", train, per_class or PER_CLASS, seed)
    terms, weight, stems = choose_terms(sample)
    lookup = Lookup(terms, stems)
    rate = label_share(docs, labels, "toxic", train)
    if not len(terms):
        return Model(lookup, np.zeros(0), None, rate, rate)
    n, df = document_frequencies(docs, lookup)
    weight = weight * (np.log((1.0 + n) / (1.0 + df)) + 1.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            for some in portions(texts):
                part = b.slice(some.start, some.stop - some.start)
                text, term, n = lookup.counts(texts[some])
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                units = [unit_arrays(term[i:j], n[i:j], weight) for i, j in pairwise(cut)]
                begin = pa.array(np.cumsum([0, *(len(t) for t, _ in units)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.ListArray.from_arrays(begin, pa.array(np.concatenate([t for t, _ in units]), pa.int32())),
                     pa.ListArray.from_arrays(begin, pa.array(np.concatenate([w for _, w in units]), pa.float64()))],
                    names=["doc_id", "label", "t", "w"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", F.col("label").cast("long"), "text").mapInArrow(
        vectors, f"doc_id {kind}, label long, t array<int>, w array<double>").orderBy("doc_id").toArrow().combine_chunks()
    ids, label = rows.column("doc_id").to_pylist(), rows.column("label").to_pylist()
    units = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(rows.column("t"), rows.column("w"), strict=True)]
    del rows
    with_terms = [i for i, u in enumerate(units) if len(u[0])]
    without = [label[i] for i, u in enumerate(units) if not len(u[0])]
    index = BlockMaxIndex([units[i] for i in with_terms], [label[i] for i in with_terms],
                          [ids[i] for i in with_terms], len(weight))
    return Model(lookup, weight, index, rate, (sum(without) + SHRINK * rate) / (len(without) + SHRINK))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    model = in_tasks(docs.sparkSession, fit(docs, labels, folds, held_out))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = model().scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in found], pa.float64()),
                 pa.array([e for _, e in found], pa.list_(b.column(0).type))], names=["doc_id", "score", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")
    return out.select("doc_id", (fold_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; a narrow map."""
    model = in_tasks(docs.sparkSession, fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = [s < threshold for s, _ in model().scores(b.column(at).to_pylist())]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
