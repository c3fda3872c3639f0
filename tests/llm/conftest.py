import pytest

LONG = "the quick brown fox jumps over the lazy dog " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and clashing extra columns."""
    texts = [None, "", "   \n\t ", "...!?", "one", "one two", LONG, LONG, "Ünïcode wörds äöü 漢字", "the same text of seven words here", "the same text of seven words here", "All Rights Reserved. cc-by GNU General Public License"]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 0.5, 7, "x") for i, t in enumerate(texts)] + [(11, texts[11], "en", None, 1, 0.5, 7, "x"), (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, label string")
