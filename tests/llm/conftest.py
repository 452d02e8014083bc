import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty, wordless, very long and repeated texts, ties, and names that operators use."""
    long_word, long_text = "ab" * 60_000, " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog near the river bank " * 3
    rows = [
        (1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, None, "en", "a", 0),
        (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 4), (6, long_word, "en", None, 9), (7, long_text, None, "b", None),
        (None, plain, "en", "a", 1), (None, "no id here at all, but some words", None, None, None), (8, "two words", "de", "b", 9),
        (9, "two words", "de", "b", 9), (10, "TWO words", "de", "b", 9), (11, "é▁ü \x00   😀 ①", "fr", "b", 9),
        (12, "same " * 400, "en", "b", 2000), (13, plain + "and one more word", "en", "a", 1),
        (14, long_text + " end", "en", "a", 1), (15, "\n".join(["one line of it"] * 90), "en", "a", 1),
    ]
    names = "score key bucket starts node text_a kept n_tokens ids_ slot_ _key_ _spans_ component".split()
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, " + ", ".join(f"`{n}` STRING" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)
