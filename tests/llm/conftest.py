import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, **extra):
        """Rows (doc_id, text[, lang[, source]]) as a documents table; extra columns get one value."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(words) for _ in range(120))
    long = " ".join(rng.choice(words) for _ in range(30_000)) + " " + "x" * 50_000
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, text, "en", "b"), (5, text, "fr", "b"), (5, text, "fr", "b"), (None, text, "en", None),
            (7, long, "en", "b"), (8, "one two", "fr", None), (None, None, None, None)]
