"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tidepool.plans import registry
from oracle import compare

KEYS = sorted(registry.queries())


def test_every_query_has_an_oracle_or_is_known_rows_only():
    rows_only = set(KEYS) - set(E.oracle_sql())
    assert not rows_only, rows_only


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    r = compare(spark, key, SF_SMALL, duck)
    assert r["status"] in ("match", "rows-only"), r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "score"]
    assert len(df.collect()) <= 10
