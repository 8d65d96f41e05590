"""Exact token counts, with overlap resynchronisation for huge documents.

A huge document is encoded in chunks that overlap, each on its own and with
offsets. Two neighbours are spliced at a position of the overlap where both
begin a new word of the tokenizer's pre-splitting: from such a position on, the
splitting depends on the following text only, so both go on alike for ever. If
the left chunk is in step with the whole text up to there (the first one is,
and each splice hands it on), the splice is proven. Positions so near the cut
end of the left chunk that the missing text could change them don't count. If an
overlap holds no common position (a run of letters longer than the overlap, for
example) it is doubled, up to the rest of the document.

Shorter documents are encoded whole; a memo of word -> token count, bounded and
kept per task, saves encoding frequent words again. Texts are taken
apart for it only where the byte-level splitting pattern ends a word whatever
stands around it, so the sum is exact.

Defined cases: null text is empty and has 0 tokens; special strings inside a
text count as the library's default treats them; texts of any length are read
whole; repeated rows and null ids are counted like any others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.common import slices

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 8
OVER_LIMIT = 512
#: Words per generation of the memo; at most two generations are held.
MEMO_WORDS = 250_000
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r" \s|\s ")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Memo:
    """word -> value in two generations: a full young one becomes the old one, used words come back."""

    def __init__(self, make, words: int = MEMO_WORDS):
        self.make, self.words, self.young, self.old = make, words, {}, {}

    def cover(self, lists: list[list[str]]) -> dict:
        """A dict that has every word of ``lists``."""
        if len(self.young) > self.words:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [w for w in set().union(*lists) if w not in young]
        if missing:
            known = {w: old[w] for w in missing if w in old}
            young.update(known)
            fresh = [w for w in missing if w not in known]
            young.update(zip(fresh, self.make(fresh), strict=True))
        return young


def split_words(text: str) -> list[str]:
    """The text in pieces that begin at safe spaces; joined they give the text."""
    if " " not in text:
        return [text] if text else []
    parts = text.split(" ") if not _UNSAFE.search(text) and text[0] != " " and text[-1] != " " else _SAFE_SPACE.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def _margin(tok: Tokenizer) -> int:
    """How far from a cut end a word start may still change: a special string cut short, or two characters."""
    return 2 + max([0, *(len(t.content) for t in tok.get_added_tokens_decoder().values())])


def _starts(enc) -> tuple[np.ndarray, np.ndarray]:
    """(character position, token number) of the first token of every pre-split word."""
    words = np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(words, prepend=words[0] - 1) != 0)
    offsets = enc.offsets
    return np.array([offsets[i][0] for i in first], np.int64), first


def count_spliced(tok: Tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of the whole text from overlapping chunks; equal to len(encode(text).ids)."""
    margin, n = _margin(tok), len(text)
    encode = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    total, start, skip = 0, 0, 0  # the chunk from ``start`` is in step from its token ``skip`` on
    left = encode(0, min(n, chunk + overlap))
    end = min(n, chunk + overlap)
    while end < n:
        nxt, wide = start + chunk, overlap
        right_end = min(n, nxt + chunk + overlap)
        right = encode(nxt, right_end)
        while True:
            la, lt = _starts(left)
            ra, rt = _starts(right)
            la = la + start
            ra = ra + nxt
            stable = (la >= nxt) & ((la <= end - margin) if end < n else True) & (lt >= skip)
            inside = (ra <= right_end - margin) if right_end < n else np.ones(len(ra), bool)
            common = np.intersect1d(la[stable], ra[inside])
            if len(common):
                at = common[0]
                total += int(lt[np.searchsorted(la, at)]) - skip
                skip = int(rt[np.searchsorted(ra, at)])
                start, left, end = nxt, right, right_end
                break
            if end >= n:  # the left chunk now reaches the end of the text: nothing is left to splice
                return total + len(left.ids) - skip
            wide *= 2
            end = min(n, nxt + wide)
            if end > right_end:  # the right chunk must cover the wider overlap too
                right_end = min(n, end + chunk)
                right = encode(nxt, right_end)
            left = encode(start, end)  # same start, so the tokens up to the old end's margin stay as they were
    return total + len(left.ids) - skip


#: Texts with these are taken apart at spaces only: apostrophes (contractions), special strings, separators that
#: only Python takes for white space, and characters that Unicode versions might class differently.
_UNUSUAL = re.compile("['\x1c-\x1f\x85\u0130\u0250-\U0010ffff]|<\\|")
#: The byte-level splitting pattern for the other texts, with letters and digits in one run.
_PARTS = re.compile(r" ?[^\W_]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def usual(text: str) -> bool:
    if text.isascii():  # a few substring searches are much faster than a character class
        return not ("'" in text or "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not _UNUSUAL.search(text)


def pieces(text: str) -> list[str]:
    """Parts of the text whose token counts add up to the text's; joined they give the text.

    A part ends where the tokenizer's pattern ends a word whatever stands
    around it, so each part is encoded alike alone and in the text.
    """
    return _PARTS.findall(text) if usual(text) else split_words(text)


def _lengths(path: str):
    def make(words: list[str]) -> list[int]:
        return [len(e) for e in load(path).encode_batch_fast(words, add_special_tokens=False)]

    return make


def count_batch(path: str, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
                memo: Memo | None = None) -> list[int]:
    memo = memo or Memo(_lengths(path))
    out: list[int] = []
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        lists = [pieces(t) if len(t) <= chunk else [] for t in part]
        known = memo.cover(lists)
        out += [sum(map(known.__getitem__, ws)) if len(t) <= chunk else count_spliced(load(path), t, chunk, overlap)
                for t, ws in zip(part, lists, strict=True)]
    return out


def count_tokens(docs: DataFrame, path: str, over: int = OVER_LIMIT, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A narrow map: nothing is shuffled.

    ``path`` names a byte-level tokenizer file that every worker has.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_lengths(path))  # one per task: what a worker keeps does not add up
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array(count_batch(path, texts, chunk, overlap, memo), np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > over)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
