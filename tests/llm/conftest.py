import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tests_llm_prose import prose  # noqa: E402


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and an extra column."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[50] = "changed"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 2), (2, " ".join(near), "en", "b", 3), (3, prose(3, 40) + " " + passage + " " + prose(4, 30), "en", "b", 4),
        (4, prose(5, 10) + "\n" + passage + "\n" + prose(6, 12), "en", "c", 5), (5, None, "en", "a", 6), (6, "", "de", None, 7), (7, "one two", "de", "c", 8), (8, "one two", None, "c", 9),
        (9, prose(7, 9000), "de", "a", 10), (10, "12 34 56", "de", "b", 11), (11, "und und und " * 40, "de", "b", 12), (12, prose(8, 200), "fr", "b", 13), (12, prose(8, 200), "fr", "b", 13), (None, prose(9, 70), "fr", "c", 14),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, _key int")
