import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeats, and columns whose names operators use inside."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 1, 0, "x"),
        (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 1, 0, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 1, "y"),
        (4, "word " * 30000, "de", None, 150000, 2, "z"),
        (5, "THE QUICK brown fox jumps over the lazy dog near the old river bank", "en", "b", 1, 0, "x"),
        (None, "solo text", "fr", "c", 9, 3, "w"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, size string")
