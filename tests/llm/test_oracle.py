"""Every query that SQL can express, against DuckDB on the given tables."""

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF_DIR

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NAMES = [n for n in __spark_entry__.oracle_sql() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]


def rounded(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(want.columns)
    got = __spark_entry__.queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    left = rounded(tuple(r[c] for c in columns) for r in got.collect())
    right = rounded(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert left == right and left
