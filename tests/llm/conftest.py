import pytest

LONG = "lorem ipsum dolor " * 9000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "", "x"), (2, None, "x"), (None, "a null id stands here, with enough words to be a text", None), (None, None, "x"), (3, LONG, "x"), (4, LONG, "x"), (5, "  \n\t ", "x"),
        (6, "same row twice " * 12, "x"), (6, "same row twice " * 12, "x"), (7, "one id " * 20, "x"), (7, "two texts " * 20, "x"), (8, "é漢字🙂" * 60, "x"), (9, "word", "x"),
    ]
    cols = ["doc_id", "text", "lang", "source", "n_chars", "at", "mh", "fp", "d", "tid", "base", "added", "length", "_rank", "k", "component_id"]
    full = [(i, t, o, "src", len(t or ""), 1, 1, 1, 1, 1, "b", "a", 1, 1, 1, 1) for i, t, o in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, at long, mh long, fp long, d long, tid long, base string, added string, length long, _rank long, k long, component_id long").select(*cols)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"
