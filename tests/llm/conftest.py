import pytest

#: Extra columns whose names clash with what operators make or use within.
CLASH = "n_words long, kept boolean, score double, key string, id string, label int, component_id long, bin long, html2 string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = (1, True, 0.5, "k", "i", 3, 9, 4, "h")


def prose(k: int, n: int) -> str:
    """n words that repeat no run of words."""
    return " ".join(("the", "of", f"w{k}x{i}", f"v{i * 7 + k}", "and")[i % 5] if i % 5 in (0, 1, 4) else f"w{k}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, other scripts."""
    long_text = prose(7, 30_000)
    rows = [
        (0, prose(1, 300), "en", "a", 10), (1, prose(1, 300), "en", "a", 10), (2, prose(1, 299) + " last", "en", "b", 10), (3, None, "en", "a", None), (4, "", None, None, 0),
        (5, " \n\t ", "de", "a", 3), (6, "one", "en", "a", 3), (7, "one two three four", "fr", "b", 3), (8, long_text, "en", "c", 1), (9, "Ünïcode ß 漢字 😀 &amp; <b>", "de", "c", 5),
        (10, "dup row here", "en", "a", 1), (10, "dup row here", "en", "a", 1), (None, "no id at all", "en", "a", 1), (None, None, None, None, None), (11, "buy buy buy " * 40, "en", "a", 2),
        (12, "1234 5678 !!", "en", "d", 2), (13, "line\n" * 30, "en", "d", 2), (14, "x" * 50_000, "en", "d", 2), (15, "\x00\x01 control", "en", "d", 2),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
