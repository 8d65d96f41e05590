from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses

WORDS = st.sampled_from("a b c d e f g h i j".split())
TEMPLATES = {"a b c d e": "one", "f g h": "two", "a f j i h b": "three", "c": "four"}


def brute(block, templates, threshold):
    out = set()
    for text, label in templates.items():
        t = set(text.split())
        part = len(t & set(block)) / len(t)
        if part >= threshold - 1e-9:
            out.add((label, part))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=12), st.dictionaries(WORDS, st.integers(0, 50)), st.sampled_from([0.3, 0.5, 0.8, 0.9, 1.0]))
def test_filters_lose_no_pair(block, frequency, threshold):
    index = licenses.Index(TEMPLATES, frequency, threshold)
    assert set(index.match(block)) == brute(block, TEMPLATES, threshold)


def test_blocks_hold_every_run_of_half_a_block():
    for n in range(0, 200):
        words = [str(i) for i in range(n)]
        found = [set(b) for b in licenses.blocks(words, 16)]
        for at in range(n - 7):
            assert any(b.issuperset(words[at:at + 8]) for b in found)


def test_odd_rows_and_empty_table(odd, none_left):
    rows = licenses.scan(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count()
    assert (by[11].base_labels, by[11].n_base, by[11].first_word, by[11].last_word) == ("cc-by,reserved", 3, 2, 10)
    assert by[11].labels == "cc-by,cc-by-nc-4.0,reserved"
    assert (by[12].base_labels, by[12].labels, by[12].score) == ("", "mit", 1.0)
    assert (by[3].n_words, by[3].n_base, by[3].first_word, by[3].labels, by[3].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(none_left).count() == 0


def test_overlapping_places_count():
    places, found = licenses.phrase_places("cc by cc by by cc".split(), licenses.PHRASES)
    assert places == [0, 2] and found == {"cc-by"}
