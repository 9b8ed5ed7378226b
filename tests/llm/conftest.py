import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs; more columns with clashing names."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        frame = spark.createDataFrame(full, SCHEMA)
        for clash in ("score", "kept", "key", "spans", "class", "mark", "node", "start"):
            frame = frame.withColumn(clash, frame["n_chars"])
        return frame

    return make


@pytest.fixture(scope="session")
def words():
    """Distinct invented words."""
    import random

    made = random.Random(5)
    return ["".join(made.choices("abcdefghijklmnop", k=7)) for _ in range(6000)]
