"""Documents with every odd case."""

import pytest

LONG = " ".join(f"word{i}" for i in range(60_000)) + "."
PROSE = "The quick brown fox jumps over the lazy dog while seven curious cats watch from an old wooden fence nearby. "


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (1, PROSE * 4, "en", 1, "x"), (2, PROSE * 4, "en", 1, None), (3, PROSE * 4 + "One more sentence ends it.", "en", 1, "x"), (4, None, "en", None, "x"), (5, "", None, 0, "x"),
        (6, " \n\t ", "en", 3, "x"), (7, "<|endoftext|> a<|im_start|>b \\ | <\\|", "en", 9, "x"), (8, LONG, "en", 9, "x"), (None, PROSE * 4, "en", 9, "x"), (None, None, None, None, None),
        (9, "short", "en", 5, "x"), (9, "short", "en", 5, "x"), (9, "another text with this id", "en", 5, "x"), (10, "日本語のテキスト。 é ≠ 🎉", "ja", 5, "x"), (11, "!!! ???", "en", 5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, `node` string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
