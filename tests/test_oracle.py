"""Every query with a SQL equivalent, against DuckDB on the same tables."""

import os

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import __spark_entry__ as contract
from seqcast.plans.oracle import ORACLE
from seqcast.plans.queries import REGISTRY

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def _kind(field_type):
    return "bigint" if pa.types.is_integer(field_type) else "string" if pa.types.is_large_string(field_type) else str(field_type)


def _sorted(table):
    """Columns by name, whole numbers as 64 bits, rows in a fixed order."""
    names = sorted(table.column_names)
    columns = {}
    for name in names:
        column = table.column(name).combine_chunks()
        columns[name] = column.cast(pa.int64()) if pa.types.is_integer(column.type) else column
    out = pa.table(columns)
    keys = [n for n in names if not pa.types.is_floating(out.schema.field(n).type)]
    keys += [n for n in names if n not in keys]
    return out.sort_by([(name, "ascending") for name in keys])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = _sorted(REGISTRY[name](spark, SF_DIR).toArrow())
    want = _sorted(duck.sql(ORACLE[name]).to_arrow_table())
    assert [(f.name, _kind(f.type)) for f in got.schema] == [(f.name, _kind(f.type)) for f in want.schema]
    assert got.num_rows == want.num_rows > 0
    for column in got.column_names:
        assert got.column(column).equals(want.column(column)), column


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLE)))
def test_trained_forecasts_are_finite(spark, name):
    rows = REGISTRY[name](spark, "/root/testdata/sf0.01").toArrow()
    assert rows.num_rows == 3262
    for column in rows.columns:
        assert not column.null_count
        if pa.types.is_floating(column.type):
            assert pc.all(pc.is_finite(column)).as_py()


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["symbol", "window", "date", "category", "prediction", "actual"]
    assert out.count() == 303


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
