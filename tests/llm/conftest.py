import pytest
from pyspark.sql import functions as F

TEXTS = [
    None, "", " \t\n", "a", "the cat sat on the mat. the cat sat on the mat.", "the cat  sat on the mat. the cat sat on the mat.",
    "Ünï çödé 你好 мир 😀", "x" * 5000, "word " * 3000, "I'll say: don't\n\n  stop\r\n", "mail a.b@c.de or 1.2.3.4, +1 (234) 555-1234, 4111 1111 1111 1111",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    rows = [(k, t, "en" if k % 2 else None, "s", None if t is None else len(t), k) for k, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "a lonely null id", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, anchor long")
    for name in ("fp", "kept_id", "row_digest", "predicted", "stay", "_norm", "start", "digest"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
