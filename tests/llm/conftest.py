import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, taken int, score string"


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    plain = "the quick brown fox jumps over the lazy dog while seven other animals watch from afar"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    texts = [plain, plain, plain + " end", None, "", "   \n\t ", long, "one", "a b c d", "Released under the MIT License.", "x" * 60_000, "é ü 漢字 <|endoftext|> don't 12", "😀 \x85  tail"]
    out = [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], None, "s", 1, "q") for i, t in enumerate(texts)]
    return [*out, out[0], (None, plain, None, None, None, None, None, None), (50, plain.replace("fox", "cat"), "de", "", 3, "s", 1, "q")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else 0, None if i == 2 else int(i in (1, 8))) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
