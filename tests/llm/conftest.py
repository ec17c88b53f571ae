import pytest

#: Texts that every operator must take: null, empty, blank, short, odd, repeated, very long.
TEXTS = [None, "", " ", "\n", "a", "Ab", "word " * 40, "word " * 40, "ünï çødé 日本語 🙂 x́", "tab\tand\r\nlines\n\n", "the quick brown fox jumps over the lazy dog " * 5, "\x01\x00 odd", "x" * 70_000, "the same words again and again " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a repeated row, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, i) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "en", None, 6), (None, "no id here", "de", "s2", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(c) for c in ("score", "slot", "block", "media", "node", "key", "grams", "_b", "n_pieces", "lang_pred", "_label", "bucket", "shard", "a", "root")])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
