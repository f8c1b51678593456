"""Every pN query against its SQL, or, where SQL can't express it, that it runs on the smallest tables."""

import duckdb
import pytest

from scourline.llm.oracle import ORACLE
from scourline.llm.queries import queries

TABLES = "demo_city ref_places ref_countries feeds eval_items subjects doc_labels documents".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, data, name):
    got, want = queries()[name](spark, data), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(str, map(tuple, got.select(*columns).collect())))
    assert rows == sorted(map(str, want.select(*columns).fetchall()))
    assert len(rows) > 0


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLE)))
def test_query_without_sql(spark, data, name):
    assert queries()[name](spark, data).count() > 0


def test_found_columns(spark, data):
    # The columns asked for.
    columns = {
        "p1_found": ["first_row_id", "copy_row_id"], "p2_found": ["field_name", "term", "mark"], "p3_found": ["row_id", "place_id"],
        "p4_found": ["country", "batch_no"], "p5_found": ["entry_no", "city_row_id", "country_row_id", "population_row_id"],
        "p6_found": ["row_id", "field_name", "ref_id"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"],
    }
    for name, wanted in columns.items():
        assert queries()[name](spark, data).columns == wanted
