from __future__ import annotations

import pytest
from llm_helpers import prose

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, size string, component string, text_key string, score string, copy string, key string"
)
CLASHING = ("x",) * 7


@pytest.fixture(scope="session")
def messy_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = prose(120, 1)
    edited = base.split()
    edited[60] = "changed"
    passage = prose(70, 3)
    texts = [
        base, base, " ".join(edited), base.upper(), "", None, "   \n\t ", "one", "one two", "one two three",
        prose(80, 4) + "\n" + passage + "\n" + prose(30, 5), passage + "\n" + prose(40, 6), prose(5_000, 7),
        "é ü ß 　 日本 x", "spam " * 300, "a b c d\n" * 40,
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], None if i % 4 else 3) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[4], (None, base, None, None, None), (None, None, None, None, None), (7, prose(60, 8), "en", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows as a table in several parts, with columns whose names clash with working ones."""
    return spark.createDataFrame([(*r, *CLASHING) for r in messy_rows], SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
