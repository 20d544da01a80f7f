import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Nulls in every column, empty and blank texts, repeated rows and texts, a long text, one of bare marks.
LONG = " ".join(f"w{k % 700}x{k // 700}" for k in range(9000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
ROWS = [
    (0, f"intro one two three\n{PASSAGE} the end of zero", "en", "b"),
    (1, f"other words here\n{PASSAGE} and more words after it", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n ", "en", "c"),
    (5, "same text again and again of the same", "en", "a"),
    (6, "same text again and again of the same", "en", "b"),
    (6, "same text again and again of the same", "en", "b"),
    (None, f"no id {PASSAGE}", "en", "a"),
    (7, LONG, "fr", "a"),
    (8, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "de", None),
    (9, "### $$$ | | *** <> %%%", "es", "c"),
    (10, "short", "en", "b"),
    (11, f"{PASSAGE} {PASSAGE} naïve café İstanbul Straße ΣΑΣ", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return [(*r, len(r[1]) if r[1] is not None else None) for r in ROWS]


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The odd rows, with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("size", "start", "tie", "bucket", "node", "n", "key", "score", "spans", "n_words", "kept", "place")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def corpus():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
