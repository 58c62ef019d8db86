import pytest

#: Columns whose names clash with ones that operators use themselves.
EXTRA = "lang string, source string, n_chars long, row string, key string, whole string, digest string, bucket string, `my col` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and extra columns."""
    long = " ".join(f"word{i % 977} x{i * 7919 % 10007}," for i in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It's 2024!", "en"),
        (2, "The quick brown fox jumps over the lazy dog. It's 2024!", "en"),
        (3, "The  quick brown fox\tjumps over the lazy dog. It's 2024!\n", None),
        (4, None, "en"),
        (5, "", "de"),
        (6, " \t\n\x0b\x0c\r", "fr"),
        (7, long, "en"),
        (8, long + " tail", "en"),
        (9, "ÀÉ naïve Straße — «日本語» é  nbsp \x1c sep <|endoftext|> 🙂🙂", "es"),
        (10, "a", "en"),
        (10, "a", "en"),
        (11, "don't can't we'll x'", "en"),
        (12, "a <|endoftext|>b <|startoftext|><|endoftext|> B<|EndOfText|> it's<|endoftext|>", "en"),
        (None, "no id here", None),
    ]
    rows = [(i, t, g, None if i == 3 else f"src{(i or 0) % 3}", None if i == 4 else len(t or ""), "r", "k", "w", "d", "b", "c") for i, t, g in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)
