import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with the operators' own names."""
    rows = [
        (1, "The of and to in a is that for it as was", "en", "x", 1, None, "clash"), (1, "The of and to in a is that for it as was", "en", "x", 1, None, "clash"),
        (2, "THE OF AND TO IN A IS THAT FOR IT AS WAS", None, None, None, "k", None), (None, "the of and to in a is that for it as was", "en", None, 3, "k", "r"),
        (None, None, None, None, None, None, None), (3, None, "fr", "x", 0, "k", "r"), (4, "", "de", "x", 0, "k", "r"), (5, " \n\t ", "es", "x", 4, "k", "r"),
        (6, "word " * 20_000, "en", "x", 5, "k", "r"), (7, "é" * 30_000 + " token=abcdef 1.2.3.4 AKIA", "fr", "x", 5, "k", "r"), (2, "another text", "xx", "x", 5, "k", "r"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, row string").repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
