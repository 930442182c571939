"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, odd column names."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "record string, score double, label int, bucket int, spans string, locator int")
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))


def awkward_rows():
    texts = ["The quick brown fox jumps over the lazy dog near the old river bank today.",
             "The quick  brown fox\njumps over the lazy dog near the old river bank today.",
             "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss.",
             "", None, "   \t\n ", "x", "!!! 123 ???", LONG, LONG,
             "Mail me: a.b@example.com or +1 (517) 555-0938", "naïve café ÉCOLE ß 中文 🙂 é",
             "<|endoftext|> it's WE'RE 12 <|startoftext|>"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, "r", 0.5, 1, 2, "z", 3)
            for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[0], "en", "s", 1, None, None, None, None, None, None),
                   (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
