import pytest

from riskframe.session import ship_package

#: ids, texts, labels and sources with every awkward case
ODD_TEXTS = [None, "", " ", "\n\n", "a", "A a", "one two three", "One  TWO\tthree\nfour", "12 34 . !", "日本語 の テスト",
             "x <|endoftext|> y", "x<|startoftext|>y", " lead", "trail ", "a   b\n \n c", "don't 's stop'll",
             "é ́a İ ẞ ﬁ ΣΑΣ", "\U0010ffff z", "word " * 6000, "wörd" * 3000, "same text here again and again"]


@pytest.fixture(scope="session", autouse=True)
def _shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows: nulls, empty and long texts, repeated rows and ids, null ids, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None, "x", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, ODD_TEXTS[3], None, None, "x", 7), (20, ODD_TEXTS[20], "en", None, "y", 8), (20, "other text", "en", "s", "y", 8),
             (None, ODD_TEXTS[20], "en", None, "z", 9), (None, None, None, None, None, None), (900, ODD_TEXTS[20], "en", None, "z", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, n_tokens int").coalesce(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
