import pytest

LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"pass{i}" for i in range(60))
ROWS = [
    (1, "Hello World this is a Text", "en", "s"),
    (2, "Hello  World this is a\tText", "en", "s"),
    (3, None, "en", "s"),
    (4, "", None, None),
    (5, "   \n ", "de", "s"),
    (6, LONG, "en", "s"),
    (7, LONG + " end", "en", "s"),
    (8, "the same text again", "en", "s"),
    (8, "the same text again", "en", "s"),
    (9, "the same text again", "en", "s"),
    (None, "text without an id", "en", "s"),
    (10, f"before {PASSAGE} after", "en", "s"),
    (11, f"other {PASSAGE} words", "en", "s"),
    (12, "12345 ... 678", "en", "s"),
    (-5, "negative id Größe déjà vu", "de", "s"),
    (13, "a b", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clashing = {c: F.lit("x") for c in ("Keep_ID", "group_size", "kept", "size", "shard", "slot", "score", "held_out", "fingerprint", "n_removed", "block", "tie", "fp", "n")}
    return df.repartition(3).withColumns(clashing)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
