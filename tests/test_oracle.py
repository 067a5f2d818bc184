"""Every registered key with SQL against DuckDB at sf0.01 (the driver's gate);
keys without SQL must at least run and keep a stable schema."""

import pytest

from conftest import SF_ORACLE
from oracle import compare

import __spark_entry__ as E
from renewlens.catalog import ORACLES, QUERIES

ORACLE_KEYS = sorted(ORACLES)
ROWS_ONLY_KEYS = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_ORACLE)
    ok, msg = compare(df, duck, E.oracle_sql()[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


@pytest.mark.parametrize("key", ROWS_ONLY_KEYS)
def test_rows_only_keys_run(spark, key):
    from conftest import SF_SMALL

    df = E.queries()[key](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) >= 1
    assert E.queries()[key](spark, SF_SMALL).columns == df.columns
