"""Every query runs on the test tables; those with SQL give its rows."""

import os

import duckdb
import pytest

from gradeline.llm import queries as Q
from tests.test_registry import FOLDER, normal

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p1_found": ["source_table", "record_id"], "p2_found": ["id_a", "id_b"], "p3_found": ["field", "id_a", "id_b"], "p4_found": ["field", "id_a", "id_b"],
    "p5_found": ["transcript_id", "field"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, name):
    df = Q.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(tuple, rows))) == len(rows)
        assert all(None not in tuple(r) for r in rows) and ("id_a" not in df.columns or all(r.id_a < r.id_b for r in rows))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    assert normal(Q.queries()[name](spark, FOLDER).toPandas()) == normal(c.execute(Q.oracle_sql()[name]).df())
