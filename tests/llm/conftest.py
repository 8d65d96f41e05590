import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, n long, " \
          "copies int, fp long, cls int, _id long, label int, score double, target string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = "abc def " * 9000 + "tail"
    body = [
        (1, "The cat sat on the mat, quite happily and for a long time indeed it did.", "en", "a"),
        (2, "the cat sat on the MAT, quite happily and for a long time indeed it did.", "en", "a"),
        (2, "the cat sat on the MAT, quite happily and for a long time indeed it did.", "en", "a"),
        (3, None, "fr", None), (4, "", None, "b"), (5, " \n\t ", "en", "b"), (6, long, "en", "c"),
        (7, long, "en", "c"), (8, "x", "de", "c"), (None, "x", None, None), (None, None, None, None),
        (9, "<|endoftext|> a <|startoftext|>b  c <|endof text|>", "en", "d"),
        (10, "été ÉTÉ é \x1c\x1d ß ſ ﬁ 日本語テキスト 12345 ²", "fr", "d"),
        (11, "Licensed under CC BY-NC 4.0.\nAll rights reserved. All rights reserved.", "en", "d"),
        (12, "Released under the MIT License.", "en", None), (13, "z" * 5000, "en", "b"), (14, "a\x00b c", "en", "a"),
    ]
    rows = [(*r, len(r[1] or ""), None, None, 1, None, 2, 3, 4, 5, 0.5, "t") for r in body]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none_left(odd):
    return odd.where("doc_id < -5")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (6, 1, 0), (99, 0, 1), (8, 0, 1)],
        "doc_id long, quality int, toxic int")
