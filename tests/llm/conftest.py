import pytest
from corpus_samples import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) pairs as documents; ``extra`` adds columns whose names clash with those the operators use inside."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("bucket", "part", "score", "shard", "words", "kept", "topic", "tokens", "size", "band", "component", "text_crc32", "label", "_lang")})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, blanks, long texts, one word, separators, repeats, a null id."""
    long = prose(5, 4000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d"), (6, "a b c d e"), (7, long), (8, long), (9, long + " tail"), (9, long + " tail"), (10, "x" * 100_000), (11, "éÉ \U0001f600 " * 40), (12, "same same same same same same " * 30), (None, "no id here"), (13, prose(1, 60))]
