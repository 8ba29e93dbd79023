import pytest

from tests.conftest import SF


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns.
ODD_COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "digest string, key long, line string, size string, node string"
)


@pytest.fixture
def odd_documents(spark):
    long_text = " ".join(f"wort{i % 977}" for i in range(60_000))
    extra = ("x", 1, "y", "z", "n")
    rows = [
        (1, "the house is old and the garden is green", "en", "a", 40),
        (1, "the house is old and the garden is green", "en", "a", 40),
        (2, "the house is old and the garden is green", "en", None, 40),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n ", None, None, 4),
        (6, long_text, "de", "b", len(long_text)),
        (7, "1234 %% 5678", None, "b", 12),
        (None, "une maison est verte", "fr", "c", 20),
        (None, None, None, None, None),
        (8, "<|endoftext|> İstanbul ΣΑΣ ẖ H̱ a\x1cb don't", "en", "c", 30),
    ]
    return spark.createDataFrame([r + extra for r in rows], ODD_COLUMNS)
