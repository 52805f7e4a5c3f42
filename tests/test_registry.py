"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gradeline.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "NULL"
        return f"{x:.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert normal(registry.queries()[name](spark, FOLDER).toPandas()) == normal(duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    rows = registry.queries()[name](spark, FOLDER).collect()
    assert rows and len({len(r) for r in rows}) == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, tmp_path, capsys):
    from gradeline.__main__ import main

    assert main(["no_such_query", FOLDER], spark) == 2 and "current_grades" in capsys.readouterr().err
    assert main(["halted", FOLDER], spark) == 1
    assert main(["current_grades", FOLDER, str(tmp_path / "o"), "--booklets", "b00000000, x"], spark) == 0
    assert {r.booklet_id for r in spark.read.parquet(str(tmp_path / "o")).select("booklet_id").distinct().collect()} == {"b00000000"}
