"""Document quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are of three kinds: frequent words, shapes of white-space tokens (letter
case, digits and marks with runs collapsed: ``Aa.``, ``A!``, ``a%``) and how much a
text repeats itself (shares of distinct words and lines, in tenths). Each kind
is a TF-IDF vector of length one times the kind's weight; a truncated singular
value decomposition of the labelled sample gives the latent space. Document
frequencies are counted over all documents. The labelled vectors, bounded by
``PER_CLASS``, travel with the task; every document's cosines to all of them
are computed in blocks, and the nearest ones' labels vote by similarity.

Defined cases: null and empty text, and texts without known terms, score the
share of label 1 among training labels; without training labels every score is
0; texts are read whole; ties go to the example with the smaller id; repeated
rows score alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_bucket, slices
from tidemark.llm.samples import label_share, labelled_sample

FOLDS, HELD_OUT = 5, 0
#: Most labelled vectors per label.
PER_CLASS = {1: 2000, 0: 2000}
MAX_WORDS, MAX_SHAPES = 768, 256
MIN_DOCS = 3
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 256
#: Weight of each kind of term: words, shapes, repetition.
KINDS = {"w": 0.5, "s": 1.0, "r": 1.0}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER, _OTHER, _DIGIT, _RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_A]"), re.compile(r"\d"), re.compile(r"(.)\1+")


def token_terms(token: str) -> tuple[str, str]:
    """(word, shape) of a white-space token: lower-cased without marks around it; letter case, digits and marks
    with runs collapsed, at most 8 characters."""
    core = token.strip(_MARKS)
    if core.isalpha() and core.isascii():
        kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[0].isupper() and core[1:].islower() else None
    else:
        kind = None
    if kind is None:
        kind = _DIGIT.sub("0", _OTHER.sub("a", _UPPER.sub("A", core)))
    if len(core) == len(token):
        around = kind
    else:
        at = token.index(core) if core else 0
        around = token[:at] + kind + token[at + len(core):]
    return "w" + core.lower(), "s" + _RUN.sub(r"\1", around)[:8]


def _shares(text: str, distinct: int, total: int) -> tuple[str, str, str]:
    """Terms of repetition: shares of distinct tokens and lines in tenths, and whether the text is short."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return (f"ru{10 * distinct // total}", f"rl{10 * len(set(lines)) // len(lines)}" if lines else "rl0",
            "r#" if total < 20 else "r=")


def terms(text: str | None) -> Counter:
    """Counts of all terms of a text; their first letter is the kind."""
    tokens = Counter((text or "").split())
    out: Counter = Counter()
    for token, n in tokens.items():
        word, form = token_terms(token)
        out[word] += n
        out[form] += n
    if tokens:
        out.update(_shares(text, len(tokens), sum(tokens.values())))
    return out


class Lookup:
    """Text -> counts of the chosen terms as arrays; tokens are classified once and kept in a bounded memo."""

    MEMO = 400_000

    def __init__(self, names: list[str]):
        self.term = {t: i for i, t in enumerate(names)}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.word, self.shape = np.full(1024, -1, np.int32), np.full(1024, -1, np.int32)

    def __getstate__(self):
        return {"term": self.term}

    def __setstate__(self, state):
        self.term = state["term"]
        self._reset()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers in order, counts)."""
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number, term = self.number, self.term
        distinct = set(tokens)
        for t in [t for t in distinct if t not in number]:
            at = number[t] = len(number)
            if at >= len(self.word):
                self.word, self.shape = (np.concatenate([x, np.full(len(x), -1, np.int32)]) for x in (self.word, self.shape))
            w, s = token_terms(t)
            self.word[at], self.shape[at] = term.get(w, -1), term.get(s, -1)
        which = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        more = [term[t] for t in _shares(text, len(distinct), len(tokens)) if t in term]
        both = np.concatenate([self.word[which], self.shape[which], np.array(more, np.int32)])
        n = np.bincount(both + 1, minlength=len(term) + 1)[1:]
        if len(number) > self.MEMO:
            self._reset()
        at = np.flatnonzero(n)
        return at, n[at]


def _sample_terms(sample: DataFrame) -> DataFrame:
    """(term, n): in how many documents of the bounded sample every term occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total = Counter(chain.from_iterable(terms(t) for t in b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             names=["term", "n"])

    return sample.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _document_frequencies(docs: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """(documents, document frequency per term) over all documents; one small row per term reaches the driver."""
    lookup = Lookup(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(names), np.int64)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                n += 1
                df[lookup.counts(text)[0]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], names=["t", "n"])

    sums = {r["t"]: r["n"] for r in docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(
        F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(len(names))], np.float64)


class Space:
    """Terms with weights, the projection to the latent space, and the labelled vectors there."""

    def __init__(self, names: list[str], idf: np.ndarray):
        self.lookup = Lookup(names)
        self.idf = idf
        self.kind = np.array(["wsr".index(t[0]) for t in names], np.int64)
        self.weight = np.array([KINDS[k] for k in "wsr"])
        self.project = np.zeros((len(names), 0), np.float32)
        self.examples = np.zeros((0, 0), np.float32)
        self.labels = np.zeros(0, np.float32)

    def raw(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights) with each kind of length one times its weight."""
        at, n = self.lookup.counts(text)
        if not len(at):
            return at, np.zeros(0, np.float32)
        x = (1.0 + np.log(n)) * self.idf[at]
        kind = self.kind[at]
        norm = np.sqrt(np.bincount(kind, x * x, 3))
        return at, (x * (self.weight / np.maximum(norm, 1e-12))[kind]).astype(np.float32)

    def latent(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors in the latent space; zero for a text without known terms."""
        y = np.zeros((len(found), self.project.shape[1]), np.float32)
        for i, (at, x) in enumerate(found):
            if len(at):
                y[i] = x @ self.project[at]
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.maximum(norm, 1e-9) * (norm > 1e-6)

    def fit(self, found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dimensions: int) -> None:
        x = np.zeros((len(found), len(self.idf)), np.float32)
        for i, (at, v) in enumerate(found):
            x[i, at] = v
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        best = np.argsort(values)[::-1][:dimensions]
        self.project = vectors[:, best].astype(np.float32)
        y = self.latent(found)
        some = np.abs(y).sum(axis=1) > 0
        self.examples, self.labels = y[some], np.array(labels, np.float32)[some]

    def vote(self, y: np.ndarray, rest: float, k: int = NEIGHBOURS) -> np.ndarray:
        """Scores of unit vectors: exact cosines to every labelled vector, the k nearest vote by similarity."""
        if not len(self.examples):
            return np.full(len(y), rest)
        cosine = np.round((y @ self.examples.T).astype(np.float64), 6)
        k = min(k, cosine.shape[1])
        # ties go to the example that comes first: a fall by place far below the rounding step
        ranked = cosine - np.arange(cosine.shape[1]) * 1e-11
        at = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, at, 1), 0.0) ** SHARPNESS
        total = weight.sum(axis=1)
        score = (weight * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((np.abs(y).sum(axis=1) > 0) & (total > 1e-9), score, rest)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
        per_class: dict[int, int] | None = None, dimensions: int = DIMENSIONS, seed: int = 3) -> tuple[Space, float]:
    """(latent space with labelled vectors, score of texts without terms)."""
    train = fold_bucket(F.col("doc_id"), folds) != held_out
    sample = labelled_sample(docs, labels, "quality", train, per_class or PER_CLASS, seed)
    rest = label_share(docs, labels, "quality", train)
    seen = _sample_terms(sample).where(F.col("n") >= MIN_DOCS)
    names: list[str] = []
    for kind, most in (("w", MAX_WORDS), ("s", MAX_SHAPES), ("r", 64)):
        top = seen.where(F.substring("term", 1, 1) == kind).orderBy(F.desc("n"), "term").limit(most)
        names += [r["term"] for r in top.select("term").collect()]
    n, df = _document_frequencies(docs, names) if names else (0, np.zeros(0))
    space = Space(names, np.log((1.0 + n) / (1.0 + df)) + 1.0)
    if not names:
        return space, rest

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [space.raw(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())),
                 pa.array([f[1].tolist() for f in found], pa.list_(pa.float32()))], names=["doc_id", "label", "t", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", F.col("label").cast("long"), "text").mapInArrow(
        vectors, f"doc_id {kind}, label long, t array<long>, x array<float>").orderBy("doc_id").collect()
    space.fit([(np.array(r["t"], np.int64), np.array(r["x"], np.float32)) for r in rows],
              [r["label"] for r in rows], min(dimensions, len(names)))
    return space, rest


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A narrow map after the fit."""
    space, rest = fit(docs, labels, folds, held_out)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            parts = [space.vote(space.latent([space.raw(t) for t in texts[at:at + BLOCK]]), rest)
                     for at in range(0, len(texts), BLOCK)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, 0.0, 1.0))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
