import os
from pathlib import Path

import pytest
from llm_data import COLUMNS

# Python workers import the package from here, wherever pytest was started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", ""))))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the
    operators use themselves."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))
    rows = [
        (None, None, None, None, None),
        (None, "", "en", "s", 0),
        (1, "", "en", "s", 0),
        (2, " \t\n", None, "s", 3),
        (3, long, "en", "s", len(long)),
        (4, "one", "en", None, 3),
        (5, "the same words here again and again", "en", "s", 35),
        (5, "the same words here again and again", "en", "s", 35),
        (6, "the same words here again and again", "fr", "s", 35),
        (6, "another text under the same id", "fr", "s", 30),
        (7, "x" * 300_000, "en", "s", 300_000),
        (8, "token = \"0123456789abcdef0123456789abcdef\" éİ mail me: a.b@c.de +1 (555) 010-9999", "en", "s", 1),
    ]
    own = "id bigint, row string, fp string, tag int, text2 string, score string, spans string, ids string, words string, n_tokens string, win string"
    extra = (9, "r", "f", 1, "t", "s", "p", "i", "w", "n", "v")
    return spark.createDataFrame([r + extra for r in rows], f"{COLUMNS}, {own}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
