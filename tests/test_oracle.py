"""Every registered query against its SQL on the same tables."""

import re
import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from surveyframe.functions import joins

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
INVENTORY = (
    [f"src{i}" for i in range(1, 5)]
    + [f"snk{i}" for i in range(1, 4)]
    + [f"cln{i}" for i in range(1, 8)]
    + [f"seg{i}" for i in range(1, 7)]
    + ["idx1"]
    + [f"agg{i}" for i in range(1, 21)]
    + [f"joi{i}" for i in range(1, 7)]
    + [f"win{i}" for i in range(1, 6)]
    + [f"ord{i}" for i in range(1, 9)]
    + [f"set{i}" for i in range(1, 6)]
    + [f"fn{i}" for i in range(1, 5)]
    + [f"aud{i}" for i in range(1, 11)]
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 12) + 0.0
    return value


def table(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    expected = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    want = table(expected.columns, expected.fetchall())
    assert want, "a comparison of empty results shows nothing"
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


# the optional training-data queries have tests of their own
OWN = [name for name in entry_points.queries() if not re.match(r"op[0-9]+_|pipeline$", name)]


# one hides and attacks by turns until nothing is told; test_disclosure.py tries all tables instead
@pytest.mark.parametrize("name", [name for name in OWN if name in entry_points.oracle_sql()])
def test_query_equals_sql(spark, sf, duck, name):
    compare(spark, sf, duck, name)


LOOKUPS = (
    "cln3_question_base cln4_collapse_options cln5_pool_writeins cln7_cap_violations seg2_rollup_layer idx1_depth_index joi2_with_label"
    " joi4_translate joi5_match_claims joi6_missing_refs win4_rank_open_options aud3_number_index aud4_source_audit aud5_check_pages"
).split()


@pytest.mark.parametrize("name", LOOKUPS)
def test_same_result_when_no_dimension_may_be_broadcast(spark, sf, duck, name, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    compare(spark, sf, duck, name)


def test_only_loops_are_without_sql():
    assert set(OWN) - set(entry_points.oracle_sql()) == {"aud10_withstand_attack"}


def test_every_inventory_id_is_registered():
    assert len(INVENTORY) == 79
    prefixes = {name.split("_")[0] for name in OWN}
    assert prefixes == set(INVENTORY)


def test_entry_is_the_flagship(spark):
    cells = entry_points.entry(spark)
    assert cells.count() == 15
