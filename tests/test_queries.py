"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from scourline.plans.catalogue import QUERIES
from scourline.plans.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings demo_city demo_gdp demo_outlier_int "
    "hospital_like price_area ref_places ref_countries feeds eval_items subjects doc_labels"
).split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else int(value) if value == int(value) else value
    return value


def check(spark, con, data, name, function, sql):
    got = function(spark, data)
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    want_rows = want.select(*[f'"{c}"' for c in columns]).fetchall()
    got_rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    clean = lambda rows: sorted(str(tuple(map(plain, r))) for r in rows)
    assert clean(got_rows) == clean(want_rows), name


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, data, name):
    check(spark, con, data, name, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
