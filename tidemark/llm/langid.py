"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, found by
the forward algorithm; a text's is the product over its words. Piece
probabilities are learned by expectation-maximisation (forward-backward
expected counts, summed by Spark) on a sample of at most ``PER_LANGUAGE`` training
documents a language. Letters that are no piece have one small probability in
all languages, so any word can be segmented.

Words are runs of letters, lower-cased. Their scores are computed for all new
words of a batch together, grouped by length, and remembered in a bounded memo.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
a null or empty training lang teaches nothing; without training documents all
texts are ``und``; texts are read whole; ties between languages go to the first by
code point; repeated rows and null ids are scored like any others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidemark.llm.common import fold_bucket, materialise, slices

FOLDS, HELD_OUT = 5, 0
#: Most training documents per language.
PER_LANGUAGE = 600
ROUNDS = 3
#: Longer words teach in spans of so many letters, one after another (they are scored whole).
TRAIN_LETTERS = 64
MAX_PIECE = 16
SMOOTHING = 0.05
#: Natural logarithm of the probability of a letter that is no piece.
UNKNOWN = -18.0
MEMO_WORDS = 250_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """The letter pieces of the public vocabulary, with the word start in front where it has one."""
    model = SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)
             and not model.is_unknown(i) and not model.is_byte(i))
    kept = sorted({p.lower() for p in names if len(p) <= MAX_PIECE and (p == _START or p.removeprefix(_START).isalpha())})
    return {p: i for i, p in enumerate(kept)}


def words_of(text: str | None) -> list[str]:
    return [_START + w for w in _WORD.findall((text or "").lower())]


def training_spans(words: list[str]) -> Iterator[str]:
    """The words, long ones cut into spans of ``TRAIN_LETTERS``, so that every letter of a text teaches."""
    for w in words:
        for at in range(0, len(w), TRAIN_LETTERS):
            yield w[at:at + TRAIN_LETTERS]


def _grid(words: list[str], vocab: dict[str, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(end, length, piece numbers) for every span of words of one length; -1 where the span is no piece."""
    n = len(words[0])
    get = vocab.get
    for end in range(1, n + 1):
        for size in range(1, min(end, MAX_PIECE) + 1):
            at = np.fromiter((get(w[end - size:end], -1) for w in words), np.int64, len(words))
            if size == 1 or (at >= 0).any():
                yield end, size, at


def _spans(at: np.ndarray, size: int, logp: np.ndarray) -> np.ndarray:
    """log p per word and language: pieces that exist; single letters always do."""
    return np.where((at >= 0)[:, None], logp[at], UNKNOWN if size == 1 else -np.inf)


def forward(words: list[str], vocab: dict[str, int], logp: np.ndarray) -> np.ndarray:
    """log P(word | language) summed over all segmentations; (words, languages). Words may differ in length."""
    out = np.zeros((len(words), logp.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, which in by_length.items():
        for at in range(0, len(which), 8192):
            part = which[at:at + 8192]
            out[part] = _alpha([words[i] for i in part], n, vocab, logp)[n % (MAX_PIECE + 1)]
    return out


def _alpha(words: list[str], n: int, vocab: dict[str, int], logp: np.ndarray) -> np.ndarray:
    """The last ``MAX_PIECE + 1`` columns of the forward table, by position modulo their number."""
    ring = np.full((MAX_PIECE + 1, len(words), logp.shape[1]), -np.inf)
    ring[0] = 0.0
    done = 0
    for end, size, at in _grid(words, vocab):
        cell = end % (MAX_PIECE + 1)
        if end != done:
            ring[cell] = -np.inf
            done = end
        ring[cell] = np.logaddexp(ring[cell], ring[(end - size) % (MAX_PIECE + 1)] + _spans(at, size, logp))
    return ring


def expected_counts(words: list[str], times: np.ndarray, vocab: dict[str, int], logp: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations; ``logp`` is one language's column (pieces, 1)."""
    total = np.zeros(len(vocab))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, every in by_length.items():
        for from_ in range(0, len(every), 4096):
            which = every[from_:from_ + 4096]
            part = [words[i] for i in which]
            spans = [(end, size, at, _spans(at, size, logp)[:, 0]) for end, size, at in _grid(part, vocab)]
            a = np.full((n + 1, len(part)), -np.inf)
            b = np.full((n + 1, len(part)), -np.inf)
            a[0] = b[n] = 0.0
            for end, size, _, p in spans:
                a[end] = np.logaddexp(a[end], a[end - size] + p)
            for end, size, _, p in reversed(spans):
                b[end - size] = np.logaddexp(b[end - size], b[end] + p)
            for end, size, at, p in spans:
                some = at >= 0
                use = np.exp(a[end - size] + p + b[end] - a[n])[some] * times[which][some]
                total += np.bincount(at[some], use, len(total))
    return total


class Model:
    def __init__(self, path: str, languages: list[str], logp: np.ndarray):
        self.path, self.languages, self.logp = path, languages, logp
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return {"path": self.path, "languages": self.languages, "logp": self.logp}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), 256):
            lists = [words_of(t) for t in texts[at:at + 256]]
            if len(self.number) > MEMO_WORDS:
                self._reset()
            new = list(set().union(*lists) - self.number.keys())
            if new:
                self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
                self.scores = np.concatenate([self.scores, forward(new, vocabulary(self.path), self.logp)])
            for text, words in zip(texts[at:at + 256], lists, strict=True):
                if not words or not any(c.isalpha() for c in text):
                    out.append((UNDETERMINED, 0.0))
                    continue
                which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
                total = self.scores[which].sum(axis=0)
                odds = np.exp(total - total.max())
                best = int(np.argmax(odds))
                out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def _sample(docs: DataFrame, folds: int, held_out: int, per_language: int, seed: int) -> DataFrame:
    """(lang, text): about ``per_language`` training documents a language, by a hash of id and language."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "")
                       & (fold_bucket(F.col("doc_id"), folds) != held_out)).select("doc_id", "lang", "text")
    size = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one small row per language
    if not size:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(size.items()) for x in (lang, per_language / n)])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.where(draw < share[F.col("lang")]).select("lang", "text")


def fit(docs: DataFrame, path: str, folds: int = FOLDS, held_out: int = HELD_OUT,
        per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, seed: int = 9) -> Model:
    """Piece probabilities per language; what reaches the driver is (language, piece, expected count)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update((lang, w) for w in training_spans(words_of(text)))
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in total]), pa.array([w for _, w in total]), pa.array(list(total.values()))],
                    names=["lang", "word", "n"])

    sample = _sample(docs, folds, held_out, per_language, seed)
    counted = materialise(sample.mapInArrow(count, "lang string, word string, n long")
                          .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    vocab = vocabulary(path)
    logp = np.full((len(vocab), len(languages)), -np.log(len(vocab)))
    place = {x: i for i, x in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lang, words = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
                times = b.column(2).to_numpy().astype(np.float64)
                for x in sorted(set(lang.tolist())):
                    which = np.flatnonzero(lang == x)
                    total = expected_counts([words[i] for i in which], times[which], vocabulary(path),
                                            logp[:, [place[x]]])
                    some = np.flatnonzero(total > 1e-6)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(some)), pa.array(some), pa.array(np.rint(total[some] * 1e6).astype(np.int64))],
                        names=["lang", "piece", "n"])

        sums = counted.mapInArrow(expect, "lang string, piece long, n long").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).collect()
        total = np.full(logp.shape, SMOOTHING)
        for r in sums:
            total[r["piece"], place[r["lang"]]] += r["n"] / 1e6
        logp = np.log(total / total.sum(axis=0))
    return Model(path, languages, logp)


def identify(docs: DataFrame, path: str, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior of that language). A narrow map after the fit.

    ``path`` names a sentencepiece vocabulary that every worker has.
    """
    model = fit(docs, path, folds, held_out)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
