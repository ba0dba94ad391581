import pytest
from odd_texts import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """ODD as documents; a null id, an id that repeats, and columns that clash with results."""
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, "s", None if t is None else len(t), True, i, "k", "a", "b", "c") for i, t in enumerate(ODD)]
    rows.append((3, "word", "en", "s", 4, False, 0, "k", "a", "b", "c"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int, key string, __qr_t string, __pii_m string, __tw_t string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
