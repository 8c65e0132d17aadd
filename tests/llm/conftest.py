import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_help import SF  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, copies, ties, repeated rows, an extra column."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, passage + " alpha beta", "en", "a", 5, "x"), (2, "gamma " + passage, "en", "a", 5, None), (2, "gamma " + passage, "en", "a", 5, None),
        (3, None, None, None, None, None), (None, "no id at all", "en", None, 3, "x"), (4, "", "en", "b", 0, "x"), (5, " \t\n ", "en", "b", 0, "x"),
        (6, "One Two Three", "en", "b", 3, "x"), (7, "one two three", "en", "c", 3, "x"), (8, " ".join(f"w{i % 5000}" for i in range(120_000)), "en", "c", 9, "x"),
        (9, passage + " alpha beta", "en", "a", 5, "x"), (10, "é ü ß <|endoftext|> \x00 z", "de", "b", 5, "x"),
    ]
    return spark.createDataFrame(rows, DOCS + ", component string").repartition(3)
