import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Names that operators use inside.
CLASHES = ("size", "target", "taken", "copies", "kept", "removed", "n_lines", "kept_text", "token_ids", "decoded", "quality", "score", "d", "k", "c", "g", "_k", "_d", "key", "a", "b", "rank", "fingerprint", "n_words")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in CLASHES:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, blanks, ties, repeated rows and a very long text."""
    words = [f"w{i}" for i in range(400)]
    long = " ".join(f"v{i % 7919}" for i in range(120_000))
    a = " ".join(words[:120])
    return [
        (1, a), (2, a), (3, a.upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one two"), (9, "x" * 50_000), (10, long), (11, long + " tail"), (12, "\n".join([a] * 3)),
        (13, a + " é ß 中文 😀"), (None, a), (None, None), (14, "p q\nr s\nt u\np q\nr s"), (14, "p q\nr s\nt u\np q\nr s"), (15, " ".join(words[60:200])), (16, " ".join(words)), (16, "other text of the same id"),
    ]
