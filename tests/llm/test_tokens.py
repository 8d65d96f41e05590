import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ALPHABET = st.sampled_from(["a", "b", " ", "  ", "\n", " ", "'", "'ll", "the", "1", "é", "日", "<|endoftext|>", "<|",
                            "endoftext", "|>", "!", "\x1c", "\t ", "é", "zz" * 30])


def library(text):
    return len(TOK.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join), st.integers(4, 40), st.integers(1, 30))
def test_spliced_chunks_equal_the_library(text, chunk, overlap):
    assert tokens.count_spliced(TOK, text, chunk, overlap) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join))
def test_memo_equals_the_library(text):
    assert "".join(tokens.split_words(text)) == text
    assert tokens.count_batch(PATH, [text]) == [library(text)]


def test_overlap_widens_over_a_run_without_boundaries():
    text = "ab " * 50 + "q" * 3000 + " cd" * 50
    assert tokens.count_spliced(TOK, text, 200, 16) == library(text)


def test_memo_stays_bounded():
    memo = tokens.Memo(lambda ws: [len(w) for w in ws], words=10)
    for k in range(20):
        known = memo.cover([[f"w{k}-{i}" for i in range(8)] + ["same"]])
        assert known["same"] == 4
    assert len(memo.young) <= 20 and len(memo.old) <= 20


def test_odd_rows_and_empty_table(odd, none_left):
    out = [tuple(r) for r in tokens.count_tokens(odd, PATH, chunk=1000, overlap=8).collect()]
    want = [(r.doc_id, len((r.text or "").encode()), library(r.text or ""), library(r.text or "") > 512)
            for r in odd.collect()]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert tokens.count_tokens(none_left, PATH).count() == 0
