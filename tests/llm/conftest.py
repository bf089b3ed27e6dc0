import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def make(rows):
        full = [(i, t, *(rest or ("en", "src0"))) for i, t, *rest in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None) for r in full]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long")
    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "no id here at all"),
            (5, long_text), (6, "the same text twice over, word for word, as it was"),
            (6, "the same text twice over, word for word, as it was"),
            (7, "the same text twice over, word for word, as it was"),
            (8, None, None, None), (None, None, None, None)]
    names = ["body", "host", "key", "n", "rep", "shingle", "slice", "bucket", "chunk", "lines",
             "length", "rank", "kept", "url", "ids"]
    frame = docs(rows)
    return frame.select("*", *(F.lit("x").alias(k) for k in names))
