import pytest

EXTRA = "fp long, mix_size long, mix_bin int, `key` string, size int, part int, score double, row string, before int, tie int, w string, label int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    long_text = " ".join(f"word{i % 977} is{i % 13}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\nSo it was.", "en", "a"),
        (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\nSo it was.", "en", "a"),
        (2, "", "en", None),
        (3, None, None, "b"),
        (None, "no id here at all, is there", "fr", "b"),
        (None, None, None, None),
        (4, " \t\n \x0b", "xx", "a"),
        (5, long_text, "en", "c"),
        (6, "one", "de", "c"),
        (7, "two words", "de", "é"),
        (8, "ünïcödé ßtraße 日本語 😀 \u00a0 x", "de", ""),
        (9, "one", "de", "c"),
        (10, "word1 is1 \\n ### <|endoftext|> </turn>", "es", "c"),
    ]
    full = [(*r, None, *([None] * 12)) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
